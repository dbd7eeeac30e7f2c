"""Near duplicates by SuperMinHash signatures, banding, verification on full sets and grouping.

**Signatures.**  Every element (shingle) draws a random permutation of the ``SLOTS`` slots
by Fisher-Yates, and step j offers slot p(j) the value j + r with r uniform; a slot
keeps its least offer.  All texts of a batch take step j at once, and a text leaves as
soon as all its slots hold values below j + 1, which no later step can beat: long texts
stop after a step or two.

**Bands.**  ``bands_for`` takes the widest bands whose chance to miss a pair at the threshold
is below ``MISS``.  Texts with equal shingle sets are one class from the start (copies,
however many, are one row from here on).

**Links.**  A bucket of n classes is not turned into pairs.  First each bucket names one
pivot, which is compared with the members whose size admits a link: n - 1 pairs, verified
by joining their full sets, and grouped.  In buckets of near copies that leaves one large
group and some outsiders.  Then whatever is outside the largest group of its bucket is
compared, on full sets and inside tasks, with all of the bucket that is not of its group;
a task holds two chunks of bounded size and hands on a link only where it brings two
groups together.  Members of one group are not compared again.

**Grouping.**  Links are united inside partitions by union-find first, which leaves a
forest; the forests are then joined by rounds of least labels with pointer jumping.

Nothing that grows with the corpus passes through the driver, and each round is written
to the shared folder.

Cases: null and empty texts have no shingles and stand alone; texts shorter than a
shingle have one, made of all their words; equal texts are one group; a repeated or null
id is a row like any other, and a group is named by its least id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandwork.llm.texts import pieces, spread, weight
from strandwork.session import materialize, measured

SLOTS = 128
MISS = 1e-6
#: Members of a bucket that a task holds, twice (as asking and as told).
CHUNK = 2048
#: Shingles of all their sets that a chunk holds, about.
CHUNK_SHINGLES = 2_000_000
#: Bytes of words that a task remembers the hashes of.
REMEMBERED = 40 << 20
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


@dataclass(frozen=True)
class Rule:
    """``size`` words a shingle, linked if 100 * intersection >= ``percent`` * union."""

    size: int = 5
    percent: int = 80

    def bands(self) -> tuple[int, int]:
        """(bands, rows): the widest that miss a pair at the threshold with a chance below ``MISS``."""
        s = self.percent / 100
        rows = max(r for r in range(1, SLOTS + 1) if (1 - s**r) ** (SLOTS // r) < MISS or r == 1)
        return SLOTS // rows, rows


class _Hashes(dict):
    held = 0

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        self.held += weight(word)
        return h

    def clear(self) -> None:
        super().clear()
        self.held = 0


def shingle_sets(texts: list[str], size: int, known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes) of all texts in a row, sorted within each text, and how many each text has."""
    if known.held > REMEMBERED:
        known.clear()
    get = known.__getitem__
    rows = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sets = []
    for row in rows:
        h = np.fromiter(map(get, row), np.uint64, len(row))
        k = min(size, len(h))
        if not k:
            sets.append(h)
            continue
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * _GOLD + h[i : len(h) - k + 1 + i])
        sets.append(np.unique(out))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)


def set_names(elements: np.ndarray, sizes: np.ndarray) -> list[str | None]:
    """A 128-bit name of each set; null for empty ones."""
    ends = np.cumsum(sizes)
    return [xxhash.xxh3_128_hexdigest(elements[e - s : e].tobytes()) if s else None for e, s in zip(ends.tolist(), sizes.tolist())]


def signatures(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SuperMinHash of each set: SLOTS values, the step in the whole part and the draw in the rest; infinite for empty sets."""
    out = np.full((len(sizes), SLOTS), np.inf)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ranks = first = None
    for step in range(SLOTS):
        if not len(owner):
            break
        draw = mix(elements + np.uint64((2 * step + 1) * int(_GOLD) % 2**64))
        offer = step + (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        place = step + (mix(draw ^ _M2) % np.uint64(SLOTS - step)).astype(np.int64)
        if step == 0:
            slot = place
        else:
            if ranks is None:
                # Few elements are left by now; the first swap is made good.
                ranks = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(owner), 1))
                ranks[np.arange(len(owner)), first] = 0
            every = np.arange(len(owner))
            slot = ranks[every, place].astype(np.int64)
            ranks[every, place] = ranks[every, step]
        flat = owner * SLOTS + slot
        np.minimum.at(out.reshape(-1), flat, offer)
        open_ = out.max(1) >= step + 1
        keep = open_[owner]
        first = place[keep] if step == 0 else None
        owner, elements = owner[keep], elements[keep]
        ranks = ranks[keep] if ranks is not None else None
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(values).view(np.uint64)
    keys = np.zeros((len(values), bands), np.uint64)
    for i in range(rows):
        keys = mix(keys * _GOLD + bits[:, i : bands * rows : rows])
    return mix(keys + np.arange(bands, dtype=np.uint64) * _GOLD).view(np.int64)


def sketches(docs: DataFrame, rule: Rule, key: str, text: str) -> DataFrame:
    """(id, n, same, bands): set size, a 128-bit name of the set (null if empty), and its band keys."""
    bands, rows = rule.bands()

    def run(batches):
        known = _Hashes()
        for part, texts in pieces(batches):
            elements, sizes = shingle_sets(texts, rule.size, known)
            keys = band_keys(signatures(elements, sizes), bands, rows)
            same = set_names(elements, sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) * bands + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(same, pa.string()), lists], ["id", "n", "same", "bands"])

    return docs.selectExpr(f"`{key}` AS id", f"`{text}` AS text").mapInArrow(
        run, f"id {docs.schema[key].dataType.simpleString()}, n long, same string, bands array<long>")


def _class_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """(same, elements) of the classes among ``members``, made anew from one text each.

    The texts are found by the least id of a class; as ids may repeat, the name of a set
    is made anew too, and other texts of that id drop out by it.
    """

    def run(batches):
        known = _Hashes()
        for part, texts in pieces(batches):
            elements, sizes = shingle_sets(texts, rule.size, known)
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(set_names(elements, sizes), pa.string()),
                                              pa.ListArray.from_arrays(offsets, pa.array(elements.view(np.int64)))], ["same", "elements"])

    wanted = members.select("same").distinct()
    ids = classes.join(wanted, "same", "left_semi").select(F.col("least").alias("wanted")).distinct()
    texts = docs.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    return texts.mapInArrow(run, "same string, elements array<long>").join(wanted, "same", "left_semi").groupBy("same").agg(
        F.first("elements").alias("elements"))


def _forest(links: DataFrame) -> DataFrame:
    """Union-find inside each partition: the same groups by fewer links, each node to its least mate there."""

    def run(batches):
        parent: dict = {}

        def root(x):
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for part in batches:
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in parent if root(x) != x]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs]), pa.array([y for _, y in pairs])], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, links.select("a", "b").schema)


def groups(links: DataFrame) -> DataFrame:
    """(node, label) of every node that ``links(a, b)`` names; the label is the least node of its group.

    Each round hangs every node with its neighbours on the least of them, and turns the
    rest into links among those (alternating both directions of the star), until nothing moves.
    """
    figures = {"n": F.count("*"), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    edges, size = measured(_forest(links).distinct(), **figures)
    if not size["n"]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours above a node go to the least of the node and its neighbours.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # Small star: a node and its neighbours below it go to the least of those.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        small = small.where("a <> b").distinct()
        new, seen = measured(small, **figures)
        if (seen["n"], seen["h"]) == (size["n"], size["h"]):
            return new.select(F.col("a").alias("node"), F.col("b").alias("label"))
        edges, size = new, seen


def _linked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs of classes whose full sets are linked; each pair is looked at once."""
    left = sets.select(F.col("same").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("same").alias("b"), F.col("elements").alias("eb"))
    common = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(left, "a").join(right, "b").where(
        100 * common >= rule.percent * (F.size("ea") + F.size("eb") - common)).select("a", "b")


def _compared(rule: Rule):
    def run(group: pa.Table) -> pa.Table:
        """The links of the rows that ask with the other rows, one for each two groups that they bring together."""
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        same, label = group.column("same").to_pylist(), group.column("label").to_pylist()
        lists = group.column("elements").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        others = np.flatnonzero(~asks)
        here = code[spread(starts[others], sizes[others])]
        cuts = np.cumsum(sizes[others]) - sizes[others]
        parent = {x: x for x in label}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        number = {x: i for i, x in enumerate(parent)}
        mine = np.array([number[label[i]] for i in others])
        mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
        a, b = [], []
        for i in np.flatnonzero(asks).tolist() if len(others) else []:
            own = code[starts[i] : starts[i] + sizes[i]]
            mark[own] = True
            common = np.add.reduceat(mark[here].astype(np.int64), cuts)
            mark[own] = False
            near = np.flatnonzero((100 * common >= rule.percent * (sizes[i] + sizes[others] - common)) & (mine != number[label[i]]))
            for k in near[np.unique(mine[near], return_index=True)[1]].tolist():
                x, y = root(label[i]), root(label[others[k]])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(same[i])
                    b.append(same[others[k]])
        return pa.table([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    return run


def _chunks(now: DataFrame) -> DataFrame:
    """(bucket, main, asking, told) of ``now(bucket, same, n, label)``: its largest group, and the chunks of what is outside it and of all."""
    per = now.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    main = per.groupBy("bucket").agg(F.max(F.struct("k", "label", "n")).alias("main"), F.sum("k").alias("k"), F.sum("n").alias("n")).where("k > main.k")
    chunks = lambda k, n: F.ceil(F.greatest(k / CHUNK, n / CHUNK_SHINGLES)).cast("int")
    return main.select("bucket", F.col("main.label").alias("main"), chunks(F.col("k") - F.col("main.k"), F.col("n") - F.col("main.n")).alias("asking"),
                       chunks(F.col("k"), F.col("n")).alias("told"))


def _settled(members: DataFrame, label: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The links (a, b) still missing: in each bucket, of whatever is outside its largest group with all else there.

    Outsiders and members are dealt into chunks of about ``CHUNK`` sets and
    ``CHUNK_SHINGLES`` shingles at most, and each chunk of outsiders meets each chunk of
    members in a task of its own.
    """
    now = members.join(label, F.col("same") == F.col("node"), "left").select("bucket", "same", "n", F.coalesce("label", "same").alias("label"))
    main = _chunks(now)
    mixed = now.join(main, "bucket")
    deal = lambda chunks: F.pmod(F.xxhash64("same"), F.col(chunks)).cast("int")
    every = lambda chunks: F.explode(F.sequence(F.lit(0), F.col(chunks) - 1))
    told = mixed.select("bucket", "same", "label", F.lit(False).alias("asks"), every("asking").alias("i"), deal("told").alias("j"))
    asking = mixed.where("label <> main").select("bucket", "same", "label", F.lit(True).alias("asks"), deal("asking").alias("i"), every("told").alias("j"))
    return told.unionAll(asking).join(sets, "same").groupBy("bucket", "i", "j").applyInArrow(_compared(rule), "a string, b string").distinct()


def components(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", names: bool = False) -> DataFrame:
    """(id, n, component) of every row: the size of its set and the least id of its group (its own if its set is empty).

    With ``names`` the name of the set as well, as ``same``, and the least such name of the group, as ``label`` (null
    for empty sets).
    """
    own = docs.selectExpr(f"`{key}` AS id", f"`{text}` AS text")
    rows = materialize(sketches(own, rule, "id", "text"))
    classes = rows.where("same IS NOT NULL").groupBy("same").agg(
        F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    members = classes.select("same", "n", F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    members = materialize(members.join(crowded, "bucket", "left_semi"))
    sets = materialize(_class_sets(own, classes, members, rule))
    pivots = members.groupBy("bucket").agg(F.min(F.struct("same", "n")).alias("p")).select(
        "bucket", F.col("p.same").alias("pivot"), F.col("p.n").alias("pn"))
    fits = (100 * F.least("n", "pn") >= rule.percent * F.greatest("n", "pn")) & (F.col("same") != F.col("pivot"))
    pairs = members.join(pivots, "bucket").where(fits).select(
        F.least("same", "pivot").alias("a"), F.greatest("same", "pivot").alias("b")).distinct()
    found = materialize(_linked(pairs, sets, rule))
    label = groups(found)
    more = materialize(_settled(members, label, sets, rule))
    label = groups(more.unionAll(label.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    named = classes.select("same", "least")
    named = named.join(label.withColumnRenamed("node", "same"), "same", "left").withColumn("label", F.coalesce("label", "same"))
    first = named.groupBy("label").agg(F.min("least").alias("component"))
    named = named.join(first, "label").select("same", "component", "label")
    return rows.select("id", "n", "same").join(named, "same", "left").select(
        "id", "n", F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"), *["same", "label"] * names)


def representatives(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with all its columns: that of the least id (null after all others), and of several
    rows of that id the least text.

    Documents without shingles stay, each row of them.  Groups are told apart by their label, not
    by an id: of unrelated texts under one id, or without an id, each group keeps its row.
    """
    found = materialize(components(docs, rule, key, text, names=True))
    own_group = F.col("same").isNull() | F.col("id").eqNullSafe(F.col("component"))
    # A single row goes by its id alone; of a null or repeated id the texts are looked at.
    fate = found.groupBy("id").agg((F.count("*") > 1).alias("repeated"), F.max(own_group).alias("stays")).select(
        F.struct("id").alias("who"), "repeated", "stays")
    fate, seen = measured(fate.where("repeated OR NOT stays"), repeated=F.count_if("repeated"))
    records = docs.select(F.struct(F.col(key).alias("id")).alias("who"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
                          F.col(text).alias("text"))
    # The key stands in a struct, so that a null id finds its fate as well.
    told = records.join(fate, "who", "left")
    kept = told.where("repeated IS NULL").select("record.*")
    if not seen["repeated"]:
        return kept

    def named(batches):
        known = _Hashes()
        for part, texts in pieces(batches):
            elements, sizes = shingle_sets(texts, rule.size, known)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(set_names(elements, sizes), pa.string())], [*part.schema.names, "same"])

    # An id none of whose rows is the least of its group or empty is gone as a whole.
    several = told.where("repeated AND stays").select("who", "record", "text")
    schema = StructType([*several.schema.fields, StructField("same", StringType())])
    several = several.mapInArrow(named, schema)
    own = found.where("same IS NOT NULL").select("same", "label", "component").distinct()
    several = several.join(own, "same", "left")
    bare = several.where("same IS NULL").select("record.*")
    first = several.where(F.col("same").isNotNull() & F.col("who.id").eqNullSafe(F.col("component"))).groupBy("label").agg(
        F.min_by("record", "text").alias("record"))
    return kept.unionAll(bare).unionAll(first.select("record.*"))
