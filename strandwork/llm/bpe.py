"""Byte-level BPE encoding by backtracking, decoding by an offset table.

Encoding: one Aho-Corasick pass over a pre-token gives the tokens that begin at every
byte, the longest first.  The encoder takes the longest that is compatible with the
token before it; where none is, it steps back over that token.  Two tokens are
compatible if the merges, run over their bytes, would keep the cut between them; this
is read off the merge tree and remembered in a pair table.  A bit per position marks
ends that proved impossible, so every (position, token) is tried once: linear time, and
exactly the tokens that merging in rank order gives.

A task remembers the tokens of the pre-tokens it has met, up to ``REMEMBERED`` bytes, as ragged
arrays; texts are then rows of indices into them.  Decoding copies the bytes of each token out of one
blob by an offset table; the list of decimal ids is made by the same copy.

Cases: null and empty texts have no tokens; the strings of added tokens become those
tokens, as the library does; texts are encoded whole, of any length, and bytes that are
no UTF-8 after decoding (never after encoding) become replacement characters.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandwork.llm.texts import pieces, spread, weight

# Fixed value: how the vocabulary's published pre-tokenizer cuts text.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LATIN = [chr(c) for c in range(256)]
#: The same cuts for texts of Latin-1 characters alone, whose classes are written out: far quicker to match.
LATIN_CUT = re.compile(CUT.pattern.replace(r"[^\s\p{L}\p{N}]", "[^\\s%L%N]").replace(r"\p{L}", "[%L]").replace(r"\p{N}", "[%N]").replace(
    "%L", "".join(c for c in LATIN if regex.match(r"\p{L}", c))).replace(
    "%N", "".join(c for c in LATIN if regex.match(r"\p{N}", c))).replace(
    r"\s+", "[%S]+").replace(r"\S", "[^%S]").replace(r"\s", "%S").replace(
    "%S", re.escape("".join(c for c in LATIN if regex.match(r"\s", c)))))
#: Bytes of pre-tokens that a worker remembers, and pairs of tokens; a full memory is emptied, and each at the end of a task.
REMEMBERED, PAIRS = 40 << 20, 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def cuts(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return CUT.findall(text)
    return LATIN_CUT.findall(text)


class Blob:
    """Byte strings by number, one after the other, copied out by offsets."""

    def __init__(self, parts: Iterable[bytes]):
        parts = list(parts)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def copy(self, numbers: np.ndarray) -> bytes:
        return self.data[spread(self.starts[numbers], self.lengths[numbers])].tobytes()


class _Numbers(dict):
    """Words by number; a new one is numbered by ``make``.  ``held`` is about what they take."""

    def __init__(self, make):
        self.make, self.held = make, 0

    def __missing__(self, word: str) -> int:
        number = self[word] = self.make(word)
        self.held += weight(word)
        return number


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        # Tokens are numbered by rank here: bytes first, then merges in order.
        names = [*letters, *(a + b for a, b in merges)]
        if len(set(names)) != len(names):
            raise ValueError("two merges make the same token")
        rank = {name: i for i, name in enumerate(names)}
        self.halves = [(i, i) for i in range(256)] + [(rank[a], rank[b]) for a, b in merges]
        self.join = {pair: i for i, pair in enumerate(self.halves) if i >= 256}
        self.raw = [bytes(byte_of[c] for c in name) for name in names]
        self.public = np.array([vocab[name] for name in names], np.int64)
        self.single = {raw: i for i, raw in enumerate(self.raw)}
        self.finder = ahocorasick.Automaton()
        for i, raw in enumerate(self.raw):
            if len(raw) > 1:
                self.finder.add_word(raw.decode("latin-1"), i)
        self.finder.make_automaton()
        self.fits: dict[int, bool] = {}
        self.sizes = [len(raw) for raw in self.raw]
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        shown = {i: t for t, i in vocab.items()}
        of_id = [bytes(byte_of[c] for c in shown[i]) if i in shown else b"" for i in range(max([*vocab.values(), *self.added.values()]) + 1)]
        for content, i in self.added.items():
            of_id[i] = content.encode()
        self.bytes_of, self.decimal_of = Blob(of_id), Blob(b"%d," % i for i in range(len(of_id)))
        self.forget()

    def forget(self) -> None:
        self.fits.clear()
        self.index = _Numbers(self._number)
        self.flat, self.ends = array("q"), array("q", [0])

    def compatible(self, a: int, b: int) -> bool:
        """Would merging the bytes of ``a`` and ``b`` keep the cut between them?

        Walk down the right edge of ``a`` and the left edge of ``b``, always into the
        token made later; a join of two edge tokens that comes before both of the
        merges that hide them would have been made first.
        """
        key = a << 32 | b
        if (known := self.fits.get(key)) is not None:
            return known
        bound = len(self.halves)
        while True:
            if (joined := self.join.get((a, b), bound)) < bound:
                fits = False
                break
            later_left = a > b
            if later_left:
                bound, a = a, self.halves[a][1]
                stuck = a == bound
            else:
                bound, b = b + 1, self.halves[b][0]
                stuck = b + 1 == bound
            if stuck:
                # That edge is down to a byte; go on with the other one.
                if later_left:
                    bound, b = b + 1, self.halves[b][0]
                    stuck = b + 1 == bound
                else:
                    bound, a = a, self.halves[a][1]
                    stuck = a == bound
                if stuck:
                    fits = True
                    break
        if len(self.fits) > PAIRS:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def encode_word(self, raw: bytes) -> list[int]:
        """Ranks of the tokens of one pre-token."""
        if (whole := self.single.get(raw)) is not None:
            return [whole]
        # Single bytes are always at hand; the automaton adds what is longer, and by the order of ends from short to long.
        at: list[list[int]] = [[b] for b in raw]
        size, fits, compatible = self.sizes, self.fits, self.compatible
        for last, token in self.finder.iter(raw.decode("latin-1")):
            at[last + 1 - size[token]].append(token)
        n = len(raw)
        tokens: list[int] = [-1]
        dead: set[int] = set()
        position = 0
        while position < n:
            before = tokens[-1]
            left = at[position]
            while left:
                token = left[-1]
                if position + size[token] not in dead:
                    ok = before < 0 or fits.get(before << 32 | token)
                    if ok or (ok is None and compatible(before, token)):
                        break
                left.pop()
            if left:
                tokens.append(token)
                position += size[token]
            else:
                # Nothing fits behind the last token: no encoding of what is before ends so; try a shorter one there.
                dead.add(position)
                at[position] = [0]
                position -= size[tokens.pop()]
                at[position].pop()
        return tokens[1:]

    def _number(self, word: str) -> int:
        if word in self.added:
            self.flat.append(self.added[word])
        else:
            self.flat.extend(self.public[self.encode_word(word.encode())].tolist())
        self.ends.append(len(self.flat))
        return len(self.ends) - 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if self.index.held > REMEMBERED:
            self.forget()
        index, rows = self.index, []
        for text in texts:
            words: list[str] = []
            parts = self.split_added.split(text) if self.split_added and any(a in text for a in self.added) else [text]
            for k, part in enumerate(parts):
                words += [part] if k % 2 else cuts(part)
            rows.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        ends, flat = np.array(self.ends), np.array(self.flat)
        sizes = np.diff(ends)
        words = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        lengths = sizes[words]
        counts = np.bincount(owner, weights=lengths, minlength=len(rows)).astype(np.int64)
        return flat[spread(ends[words], lengths)], counts

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of.copy(ids).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    """One per worker and vocabulary."""
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", digests: bool = True, ids: bool = False) -> DataFrame:
    """One row per document: key, n_tokens, with ``digests`` those of the ids and of the decoded text, with ``ids`` the ids."""

    def run(batches):
        coder = codec(vocabulary)
        for part, texts in pieces(batches):
            flat, counts = coder.encode(texts)
            ends = np.cumsum(counts)
            columns = {"key": part.column(0), "n_tokens": pa.array(counts)}
            if digests:
                numbers, decoded = [], []
                for a, b in zip((ends - counts).tolist(), ends.tolist()):
                    own = flat[a:b]
                    numbers.append(hashlib.sha256(coder.decimal_of.copy(own)[:-1]).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(own).encode()).hexdigest())
                columns |= {"ids_sha256": pa.array(numbers, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if ids:
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                columns["ids"] = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        coder.forget()

    schema = f"key {docs.schema[key].dataType.simpleString()}, n_tokens long"
    schema += ", ids_sha256 string, decoded_sha256 string" * digests + ", ids array<int>" * ids
    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """The same rows with their ids replaced by ``text``; null ids give null, numbers outside the vocabulary are an error."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def texts(column):
        coder = codec(vocabulary)
        return column.map(lambda x: None if x is None else coder.decode(np.asarray(x, np.int64)))

    return encoded.withColumn("text", texts(ids)).drop(ids)
