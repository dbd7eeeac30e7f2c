"""Toxicity: noisy-channel restoration of disguised words, then scoring of what was restored.

1. **Character model.** Letter trigrams are counted over all documents (each task counts
   its own texts, Spark adds the counts up) and smoothed with bigrams and unigrams.
   Letters outside a-z share ``CLASSES`` symbols by code point, so the model has at most
   ``SYMBOLS`` ** 3 numbers, whatever the corpus.
2. **Restoration.** A token with digits or signs among its letters, with a letter repeated, or
   a row of single letters set apart by any blanks is a lattice: a sign may be a letter
   that it looks like, a gap, or nothing; a repeated letter may be dropped.  Viterbi over
   pairs of symbols finds the cheapest reading under the character model and the channel
   costs.  A word of letters of which none stands three times in a row is kept beside its reading.
3. **Lexicon.** On a sample of labelled rows (``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` at most, taken by
   hash order, near copies once) whole words and word beginnings are counted by label.
   The feature that explains most of the toxic texts still unexplained is taken, until
   none explains enough; whole words that are toxic beyond doubt join it.  Either kind needs
   a share of toxic texts whose lower bound (``SURE`` deviations) is above ``LEAST_SHARE``.  A score is
   one minus the chance that neither the ground rate nor any feature that is present
   makes the text toxic.

Cases: null and empty texts get the ground rate; texts are read whole, of any length;
rows without a label or with a null id teach nothing; ids labelled twice count with
their higher label; without toxic examples every text gets the ground rate.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandwork.llm.texts import pieces, weight
from strandwork.session import materialize

CLASSES = 37
SYMBOLS = 27 + CLASSES
#: Most labelled ids that are learned from: toxic ones, and clean ones.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Features of the sample that compete for the lexicon.
CANDIDATES = 4000
PREFIXES = range(3, 9)
TOXIC_FROM = 0.3
#: Deviations, and the share of toxic texts behind a feature that has to be passed by so many.
SURE, LEAST_SHARE = 1.64, 0.6
#: Bytes of tokens that a worker remembers; a full memory is emptied, and each at the end of a task.
REMEMBERED = 40 << 20
#: Features that a task counts before it hands them on.
COUNTED = 200_000
# Letters that digits and signs stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "aeiou"}
# Costs of the channel, in nats: a sign as a letter, as a gap, as nothing; a letter dropped; the unlikely reading of a separator.
LOOK_COST, GAP_COST, NOTHING_COST, REPEAT_COST, ODD_COST = 2.0, 7.0, 9.0, 1.0, 6.0


@functools.cache
def symbol_table() -> np.ndarray:
    """Symbol of every code point: 0 for what is no letter, 1 to 26 for a to z, the classes for other letters."""
    codes = np.arange(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    out = np.where(letter, 27 + codes % CLASSES, 0).astype(np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


def count_trigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all texts; a gram is three symbols as one number."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for _, texts in pieces(batches):
            s = symbol_table()[np.frombuffer(("  " + "  ".join(texts).lower() + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def character_costs(grams: DataFrame) -> np.ndarray:
    """Cost of a symbol after two others; the counts collected are bounded by the alphabet."""
    n = np.zeros(SYMBOLS**3)
    for gram, count in grams.collect():
        n[gram] = count
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    share = lambda x, below: (x + 2 * below) / (x.sum(-1, keepdims=True) + 2)
    one = share(n.sum((0, 1)), np.full(SYMBOLS, 1 / SYMBOLS))
    two = share(n.sum(0), one[None])
    return -np.log(share(n, two[None])).astype(np.float32)


_REPEATED = re.compile(r"(.)\1\1")
_CHUNK = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
#: Single characters in a row, set apart by blanks of any kind and number.
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_TWICE, _RUN = re.compile(r"(.)\1"), re.compile(r"(.)\1+")


class Reader:
    """Restores the words of tokens under a character model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs

    def _options(self, text: str, i: int) -> list[tuple[str, float]]:
        c = text[i]
        if c.isalpha():
            return [(c, 0.0), ("", REPEAT_COST)] if i > 0 and text[i - 1] == c else [(c, 0.0)]
        looks = [(x, LOOK_COST) for x in LOOKS.get(c, "")]
        if looks:
            return [*looks, (" ", GAP_COST), ("", NOTHING_COST)]
        # Between single letters a separator spells a word out; between longer parts it is a gap.
        lone = not (text[i - 2 : i - 1] if i > 1 else " ").isalnum() and not (text[i + 2 : i + 3] or " ").isalnum()
        return [(" ", ODD_COST if lone else 0.5), ("", 0.5 if lone else ODD_COST)]

    def viterbi(self, text: str) -> str:
        """The cheapest reading of a lattice; ties go to the option named first."""
        symbols, costs = symbol_table(), self.costs
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i in range(len(text)):
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for out, channel in self._options(text, i):
                sym = int(symbols[ord(out)]) if out else -1
                for (a, b), (cost, path) in beam.items():
                    if sym < 0:
                        state, total, way = (a, b), cost + channel, path
                    else:
                        state, total, way = (b, sym), cost + channel + float(costs[a, b, sym]), (out, path)
                    if state not in step or total < step[state][0]:
                        step[state] = (total, way)
            beam = step
        _, path = min(((cost + float(costs[a, b, 0]), k) for k, ((a, b), (cost, _)) in enumerate(beam.items())))
        way, out = list(beam.values())[path][1], []
        while way:
            out.append(way[0])
            way = way[1]
        return "".join(reversed(out))

    def words(self, token: str) -> list[str]:
        """The words that a lower-case token holds."""
        if token.isalpha():
            return self._letters(token)
        core = _CHUNK.search(token)
        if not core:
            return []
        begin, end = core.span()
        # A sign right before the first letter may be its first letter; signs behind the last one are none.
        if begin and token[begin - 1] in LOOKS and token[:begin].count(token[begin - 1]) == 1:
            begin -= 1
        text = token[begin:end]
        if text.isalpha():
            return self._letters(text)
        if not any(c.isalpha() for c in text):
            return []
        return [w for w in self.viterbi(text).split() if w.isalpha()]

    def _letters(self, word: str) -> list[str]:
        """Three of a letter in a row are a disguise; two may be one, so the word stands beside its cheapest reading."""
        if _REPEATED.search(word):
            return self.viterbi(word).split()
        return sorted({word, *self.viterbi(word).split()}) if _TWICE.search(word) else [word]

    def spaced(self, text: str) -> list[str]:
        """Words spelled out letter by letter in a lower-case text."""
        out = []
        for m in SPACED.finditer(text):
            if sum(c.isalpha() for c in m[0]) >= 3:
                out += [w for w in self.viterbi(" ".join(m[0].split())).split() if len(w) > 1]
        return out


def folded(word: str) -> str:
    """The word with one letter for each run of a letter."""
    return _RUN.sub(r"\1", word)


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if n < len(word))]


class Lexicon(dict):
    """Tokens to the features they hold; remembers what it has read."""

    def __init__(self, reader: Reader, weights: dict[str, float]):
        self.reader, self.weights, self.bytes = reader, weights, 0
        self.sizes = sorted({len(f) for f in weights if f[0] != "="})
        # Every reading of a word of letters has the same letters when repeats are folded, so most words are settled by that.
        self.folded = {f"={folded(f[1:])}" if f[0] == "=" else folded(f) for f in weights}
        self.folded_sizes = sorted({len(f) for f in self.folded if f[0] != "="})

    def held(self, words: list[str]) -> frozenset[str]:
        w = self.weights
        return frozenset(f for x in words for f in (f"={x}", *(x[:n] for n in self.sizes if n < len(x))) if f in w)

    def __missing__(self, token: str) -> frozenset[str] | None:
        if token.isalpha() and _TWICE.search(token) and not self.reachable(folded(token)):
            words = [] if _REPEATED.search(token) else [token]
        else:
            words = self.reader.words(token)
        found = self[token] = self.held(words) or None
        self.bytes += weight(token)
        return found

    def reachable(self, word: str) -> bool:
        return f"={word}" in self.folded or any(word[:n] in self.folded for n in self.folded_sizes)

    def clear(self) -> None:
        super().clear()
        self.bytes = 0

    def of(self, text: str) -> set[str]:
        if self.bytes > REMEMBERED:
            self.clear()
        text = text.lower()
        hits = set(map(self.__getitem__, text.split()))
        hits.discard(None)
        out = set().union(*hits)
        if spelled := self.reader.spaced(text):
            out |= self.held(spelled)
        return out


class Model:
    """Character costs, the lexicon with the share of toxic texts behind each feature, and the ground rate."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], ground: float):
        self.costs, self.weights, self.ground = costs, weights, ground

    @functools.cached_property
    def lexicon(self) -> Lexicon:
        return Lexicon(Reader(self.costs), self.weights)

    def __getstate__(self):
        return self.costs, self.weights, self.ground

    def __setstate__(self, state):
        self.costs, self.weights, self.ground = state

    def score(self, text: str) -> float:
        clean = 1 - self.ground
        for f in sorted(self.lexicon.of(text)):
            clean *= 1 - self.weights[f]
        return 1 - clean


def labelled_sample(docs: DataFrame, labels: DataFrame, learn_from, key: str, text: str, label: str) -> DataFrame:
    """(text, toxic) of ids of both labels by hash order; of texts that share a least word triple, one is kept."""
    known = labels.where(F.col(label).isNotNull() & learn_from(F.col(key))).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    order = F.xxhash64(key, F.lit("sample"))
    ids = [known.where(F.col("toxic") == y).orderBy(order, key).limit(n) for y, n in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC))]
    # SAMPLE_CLEAN + SAMPLE_TOXIC ids at most are broadcast.
    sample = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(ids[0].unionAll(ids[1])), key).where("text IS NOT NULL")
    for seed in (1, 2):
        words = F.split(F.lower("text"), r"\s+")
        # The three arrays are made once a row; inside the lambda they would be made once a word.
        zipped = F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"), F.slice(words, 3, F.size(words)).alias("c"))
        triples = F.transform(zipped, lambda t: F.xxhash64(t, F.lit(seed)))
        sample = materialize(sample.select("text", "toxic", F.array_min(triples).alias("least")).groupBy("least").agg(
            F.max_by(F.struct("text", "toxic"), F.struct("toxic", "text")).alias("kept")).select("kept.*"))
    return sample


def _counted(sample: DataFrame, costs) -> DataFrame:
    """(feature, toxic, clean): in how many texts of either label a feature is."""

    def run(batches):
        reader = Reader(costs.value)
        words = functools.lru_cache(COUNTED)(reader.words)
        seen: Counter = Counter()

        def told():
            names = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array([f for f, _ in names]), pa.array([seen[k] * (k[1] == 1) for k in names], pa.int64()),
                                              pa.array([seen[k] * (k[1] != 1) for k in names], pa.int64())], ["feature", "toxic", "clean"])
            seen.clear()
            return out

        for part, texts in pieces(batches):
            for t, y in zip(texts, part.column(1).to_pylist()):
                low = t.lower()
                own = {w for token in set(low.split()) for w in words(token)} | set(reader.spaced(low))
                seen.update((f, y) for f in {f for w in own for f in features(w)})
                if len(seen) > COUNTED:
                    yield told()
        if seen:
            yield told()

    return sample.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _held(sample: DataFrame, costs, names: list[str]) -> list[tuple[list[int], int]]:
    """Which of the candidates each text of the sample has; bounded by the sample."""

    def run(batches):
        lexicon = Lexicon(Reader(costs.value), {f: i for i, f in enumerate(names)})
        for part, texts in pieces(batches):
            rows = [sorted(lexicon.weights[f] for f in lexicon.of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), part.column(1)], ["held", "toxic"])

    return [tuple(r) for r in sample.select("text", "toxic").mapInArrow(run, "held array<long>, toxic int").collect()]


def choose(names: list[str], rows: list[tuple[list[int], int]], scale: float) -> tuple[dict[str, float], float]:
    """The lexicon by covering, and the ground rate; ``scale`` is how many clean texts each sampled one stands for."""
    toxic = [set(held) for held, y in rows if y == 1]
    clean = np.zeros(len(names))
    for held, y in rows:
        if y != 1:
            clean[held] += 1
    total = np.bincount(list(itertools.chain(*toxic)), minlength=len(names)).astype(float)
    # One more clean text than was seen: what the sample never shows clean is not thereby certain.
    share = total / (total + scale * (clean + 1))
    # Wilson's lower bound: a few toxic texts that share a chance word prove nothing.
    seen = total + scale * clean
    with np.errstate(invalid="ignore"):
        raw = np.where(seen > 0, total / np.maximum(seen, 1e-9), 0)
    bound = (raw + SURE**2 / (2 * np.maximum(seen, 1)) - SURE * np.sqrt(raw * (1 - raw) / np.maximum(seen, 1) + SURE**2 / (4 * np.maximum(seen, 1) ** 2))) / (
        1 + SURE**2 / np.maximum(seen, 1))
    least = max(3, len(toxic) // 400)
    length = np.array([len(f) for f in names])
    chosen: dict[str, float] = {}
    left = toxic
    while left and len(names):
        open_ = np.bincount(list(itertools.chain(*left)), minlength=len(names)).astype(float)
        gain = np.where((open_ >= least) & (share >= 0.7) & (bound > LEAST_SHARE), open_ * (share - 0.5), 0)
        best = np.lexsort((np.arange(len(names)), -length, -gain))[0]
        if gain[best] <= 0:
            break
        chosen[names[best]] = float(share[best])
        left = [held for held in left if best not in held]
    sure = (share >= 0.9) & (bound > LEAST_SHARE) & (total >= max(5, len(toxic) // 100))
    chosen.update((f, float(share[i])) for i, f in enumerate(names) if sure[i] and f[0] == "=" and f not in chosen)
    found = {names.index(f) for f in chosen}
    missed_clean = sum(1 for held, y in rows if y != 1 and not found & set(held))
    ground = (len(left) + 0.5) / (len(left) + scale * missed_clean + 1) if rows else 0.0
    return chosen, min(float(ground), TOXIC_FROM / 2)


def learn(docs: DataFrame, labels: DataFrame, learn_from, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model; ``learn_from`` maps the id column to whether its label may be used."""
    context = docs.sparkSession.sparkContext
    costs = context.broadcast(character_costs(count_trigrams(docs, text)))
    sample = labelled_sample(docs, labels, learn_from, key, text, label)
    sizes = dict(sample.groupBy("toxic").count().collect())
    everyone = dict(labels.where(F.col(label).isNotNull() & learn_from(F.col(key))).groupBy(F.col(label).cast("int")).count().collect())
    rate = lambda y: sizes.get(y, 0) / max(everyone.get(y, 0), 1)
    scale = rate(1) / rate(0) if rate(0) and rate(1) else 1.0
    counted = _counted(sample, costs).where("toxic >= 3").withColumn(
        "share", F.col("toxic") / (F.col("toxic") + scale * (F.col("clean") + 1)))
    names = [r[0] for r in counted.where("share >= 0.7").orderBy(
        F.desc(F.col("toxic") * (F.col("share") - 0.5)), F.desc(F.length("feature")), "feature").limit(CANDIDATES).select("feature").collect()]
    weights, ground = choose(names, _held(sample, costs, names), scale)
    model = Model(costs.value, weights, ground)
    costs.destroy()
    return model


def _scores(docs: DataFrame, model: Model, text: str, run_text):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, texts in pieces(batches, text):
            yield from run_text(part, np.array([shared.value.score(t) for t in texts]))
        shared.value.lexicon.clear()

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row."""

    def out(part, scores):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= TOXIC_FROM).astype(np.int32))],
                                         ["key", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(
        _scores(docs, model, "text", out), f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model does not reject."""

    def out(part, scores):
        yield part.filter(pa.array(scores < TOXIC_FROM))

    return docs.mapInArrow(_scores(docs, model, text, out), docs.schema)
