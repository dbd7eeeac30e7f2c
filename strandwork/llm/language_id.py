"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read in windows of ``WINDOW`` bytes, all of them; the network runs over a window
in both directions from an empty state, gives every position a distribution over the
languages, and the positions of a text are averaged.  Thousands of windows take each
step together, so the work is a few numpy calls a position.

Training is backpropagation through time in numpy on the driver, over a bounded sample:
``DOCS`` texts of a language in the mean, taken by a hash of the id, one stretch of
``STRETCH`` characters from a hashed place of each.  Every language that has a text with a
letter to learn from can be predicted; the output layer is as wide.  Only the text and its
label enter; labels are never input.

Cases: null, empty and letterless texts (letters are those of Unicode; digits, number forms
and signs are none) are ``und`` with score 0, and so is every text if no labelled row can be
learned from; rows with a null id or language teach nothing; texts are read whole, of any
length; repeated rows are predicted one by one; other columns are not read, also if they are
called like those made here; an empty table has no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from strandwork.llm.texts import pieces

WINDOW = 96
HIDDEN = 8
DOCS = 300
STRETCH = 400
EPOCHS, BATCH, RATE = 8, 128, 0.02
#: Windows that take a step together.
ABREAST = 2048
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as (position, window), the lengths of the windows, and the text of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + number * WINDOW
    length = np.minimum(WINDOW, np.repeat(sizes, counts) - number * WINDOW)
    data = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    return data[start[None, :] + np.arange(WINDOW)[:, None]], length, owner


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters: for each direction the gate inputs of every byte and the recurrent weights; then the output layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.languages = languages
        self.p = {}
        for way in "fb":
            self.p[f"x{way}"] = draw(256, 3 * HIDDEN, s=0.3)
            self.p[f"u{way}"] = draw(HIDDEN, 3 * HIDDEN, s=0.35)
            self.p[f"v{way}"] = draw(HIDDEN, len(languages), s=0.3)
        self.p["c"] = np.zeros(len(languages), np.float32)

    def _forward(self, way: str, x: np.ndarray, inside: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after every position; with ``keep`` what the way back needs is kept."""
        gates, u = self.p[f"x{way}"], self.p[f"u{way}"]
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            a = gates[x[t]]
            b = h @ u
            zr = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
            z, r, q = zr[:, :HIDDEN], zr[:, HIDDEN:], b[:, 2 * HIDDEN :]
            n = np.tanh(a[:, 2 * HIDDEN :] + r * q)
            if keep is not None:
                keep.append((t, h, z, r, q, n))
            h = (n + z * (h - n)) * inside[t]
            out[t] = h
        return out

    def _states(self, way: str, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """What ``_forward`` gives, into buffers made once; the sigmoids are halved hyperbolic tangents."""
        two = 2 * HIDDEN
        gates, u = self.p[f"x{way}"].copy(), self.p[f"u{way}"].copy()
        gates[:, :two] *= 0.5
        u[:, :two] *= 0.5
        wide = x.shape[1]
        a, b = np.empty((wide, 3 * HIDDEN), np.float32), np.empty((wide, 3 * HIDDEN), np.float32)
        zr, q, n = np.empty((wide, two), np.float32), np.empty((wide, HIDDEN), np.float32), np.empty((wide, HIDDEN), np.float32)
        h = np.zeros((wide, HIDDEN), np.float32)
        out = np.empty((len(x), wide, HIDDEN), np.float32)
        full = bool(inside.all())
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            np.take(gates, x[t], axis=0, out=a, mode="clip")
            np.matmul(h, u, out=b)
            np.add(a[:, :two], b[:, :two], out=zr)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(zr[:, HIDDEN:], b[:, two:], out=q)
            np.add(q, a[:, two:], out=n)
            np.tanh(n, out=n)
            np.subtract(h, n, out=q)
            q *= zr[:, :HIDDEN]
            h = out[t]
            np.add(n, q, out=h)
            if not full:
                h *= inside[t]
        return out

    def positions(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Distributions over the languages: (position, window, language), zero behind the end of a window."""
        inside = (np.arange(len(x))[:, None] < length)[:, :, None].astype(np.float32)
        scores = self._states("f", x, inside).reshape(-1, HIDDEN) @ self.p["vf"]
        scores += self._states("b", x, inside).reshape(-1, HIDDEN) @ self.p["vb"]
        scores += self.p["c"]
        # Scores are bounded by the weights (states lie in [-1, 1]), so they need no shift before exp.
        np.exp(scores, out=scores)
        scores /= scores @ np.ones((scores.shape[1], 1), np.float32)
        return scores.reshape(len(x), x.shape[1], -1) * inside

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution of each text; zeros for empty ones."""
        x, length, owner = windows(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(owner), ABREAST):
            part = slice(at, at + ABREAST)
            np.add.at(total, owner[part], self.positions(x[:, part], length[part]).sum(0))
        return total / np.maximum([[len(t)] for t in texts], 1)

    def gradients(self, x: np.ndarray, length: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        inside = (np.arange(len(x))[:, None] < length)[:, :, None].astype(np.float32)
        kept: dict[str, list] = {"f": [], "b": []}
        states = {way: self._forward(way, x, inside, kept[way]) for way in "fb"}
        scores = states["f"] @ self.p["vf"] + states["b"] @ self.p["vb"] + self.p["c"]
        scores = np.exp(scores - scores.max(2, keepdims=True))
        share = scores / scores.sum(2, keepdims=True)
        every = np.arange(x.shape[1])
        total = float(inside.sum())
        loss = float((-np.log(share[:, every, target] + 1e-9) * inside[:, :, 0]).sum()) / total
        share[:, every, target] -= 1
        d_out = share * inside / total
        grad = {"c": d_out.sum((0, 1))}
        for way in "fb":
            u, v = self.p[f"u{way}"], self.p[f"v{way}"]
            grad[f"v{way}"] = np.einsum("tbh,tbk->hk", states[way], d_out)
            d_states = d_out @ v.T
            gx, gu = np.zeros_like(self.p[f"x{way}"]), np.zeros_like(u)
            carry = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, z, r, q, n in reversed(kept[way]):
                d = (d_states[t] + carry) * inside[t]
                dn = d * (1 - z) * (1 - n * n)
                dz = d * (h - n) * z * (1 - z)
                dr = dn * q * r * (1 - r)
                into = np.concatenate([dz, dr, dn * r], 1)
                gu += h.T @ into
                carry = d * z + into @ u.T
                np.add.at(gx, x[t], np.concatenate([dz, dr, dn], 1))
            grad[f"x{way}"], grad[f"u{way}"] = gx, gu
        return loss, grad


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Network:
    """Adam over shuffled windows; every language weighs as much as its windows, repeated to even numbers."""
    network = Network(sorted(set(labels)), seed)
    x, length, owner = windows(texts)
    target = np.array([network.languages.index(labels[i]) for i in owner], np.int64)
    rng = np.random.default_rng(seed)
    share = np.bincount(target, minlength=len(network.languages))
    even = np.concatenate([rng.choice(np.flatnonzero(target == k), share.max(), replace=share[k] < share.max())
                           for k in range(len(share)) if share[k]]) if len(target) else target
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        rng.shuffle(even)
        for at in range(0, len(even), BATCH):
            pick = even[at : at + BATCH]
            _, grad = network.gradients(x[:, pick], length[pick], target[pick])
            norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grad.values()))))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for k, g in grad.items():
                g = g / norm
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                network.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return network


def sample(docs: DataFrame, may_learn: Column, key: str, text: str, lang: str) -> list[tuple[str, str]]:
    """(stretch, language) of about ``DOCS`` texts of each language; bounded by DOCS and the number of languages."""
    known = docs.where(may_learn & F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return []
    draw = F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 30)) / (1 << 30)
    chance = functools.reduce(lambda c, r: c.when(F.col("lang") == r["lang"], min(1.0, DOCS / r["count"])), counts, F.when(F.lit(False), 0.0))
    place = F.pmod(F.xxhash64("key", F.lit("place")), F.greatest(F.length("text") - STRETCH, F.lit(1))) + 1
    stretch = F.substring(F.col("text"), place.cast("int"), F.lit(STRETCH))
    picked = known.where(draw < chance).select(stretch.alias("stretch"), "lang", "key").orderBy(
        F.xxhash64("key"), "stretch", "lang").limit(2 * DOCS * len(counts)).collect()
    return [(r["stretch"], r["lang"]) for r in picked if _LETTER.search(r["stretch"])]


def learn(docs: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    rows = sample(docs, may_learn, key, text, lang)
    return train([t.encode() for t, _ in rows], [y for _, y in rows]) if rows else None


def predict(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = shared.value
        for part, texts in pieces(batches):
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if net is not None:
                share = net.texts([t.encode() for t in texts])
                best = share.argmax(1)
                for i, t in enumerate(texts):
                    if _LETTER.search(t):
                        names[i], scores[i] = net.languages[best[i]], min(1.0, share[i, best[i]])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(scores)], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(
        run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
