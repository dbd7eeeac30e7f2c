"""Benchmark decontamination by a broadcast hash set of test windows.

A window is ``n`` consecutive words of a benchmark item; an item with fewer words is
one window.  The benchmark is dealt by hash into blocks of about ``BLOCK_BYTES`` of
text, equal rows as one with a count; each block's windows are broadcast as a sorted array
of 64-bit hashes with the words behind them.  Documents are read as word numbers of the block's vocabulary; only
positions whose words all lie in it are hashed and looked up, and a hit counts if the
word numbers agree.  A small benchmark is one block and one pass over the documents
without a shuffle; a larger one takes a pass per block, of which only what it found is
written and added up by row, so what is broadcast never grows beyond the block.  (An item
larger than a block is a block of its own.)

Cases: null and empty texts and items have no words; items that are equal are all
reported; repeated documents are judged one by one; a null item id has its words
matched, counts as an item and is left out of the list of ids; without benchmark
nothing is hit.  Other columns of the documents stay as they are.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandwork.llm.texts import pieces
from strandwork.session import materialize

WINDOW = 10
BLOCK_BYTES = 16 << 20
# Fixed value: what makes a word, as a table from UTF-8 bytes to lower-case word bytes or blanks.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
FACTOR = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def _hashes(numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * np.uint64(FACTOR) + numbers[at + k].astype(np.uint64) + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


class Windows:
    """The windows of a block of items, by length; built once on the driver and broadcast."""

    def __init__(self, items: list[tuple], n: int):
        """``items``: (id, text), or (id, text, how many such rows there are)."""
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.times = [i for i, *_ in items], [t[0] if t else 1 for _, _, *t in items]
        by_length: dict[int, dict[bytes, list[int]]] = {}
        for item, (_, text, *_) in enumerate(items):
            row = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], np.int32)
            if len(row):
                size = min(n, len(row))
                for at in range(len(row) - size + 1):
                    own = by_length.setdefault(size, {}).setdefault(row[at : at + size].tobytes(), [])
                    if not own or own[-1] != item:
                        own.append(item)
        self.exact = by_length
        self.sorted = {size: np.unique(_hashes(np.frombuffer(b"".join(w), np.int32), np.arange(len(w)) * size, size))
                       for size, w in by_length.items()}

    def search(self, texts: list[str]) -> tuple[list[int], list[tuple[np.ndarray, set[int]]]]:
        """Words of each text, and of each the places of words that are hit and the items that hit them."""
        get, rows = self.vocabulary.get, [words(t) for t in texts]
        counts = [len(r) for r in rows]
        # A stranger stands between two texts, so that no window spans both.
        numbers = np.full(sum(counts) + len(rows), -1, np.int32)
        begin = np.cumsum([c + 1 for c in counts]) - [c + 1 for c in counts] if rows else np.zeros(0, np.int64)
        for at, row, c in zip(begin.tolist(), rows, counts):
            numbers[at : at + c] = [get(w, -1) for w in row]
        strange = np.append(0, np.cumsum(numbers < 0))
        found: list[tuple[np.ndarray, set[int]]] = [(np.zeros(0, np.int64), set())] * len(texts)
        hits: dict[int, list[tuple[int, int, list[int]]]] = {}
        for size, known in self.sorted.items():
            at = np.flatnonzero(strange[size:] == strange[: len(strange) - size]) if len(numbers) >= size else np.zeros(0, np.int64)
            if len(at):
                h = _hashes(numbers, at, size)
                at = at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
            for place in at.tolist():
                if items := self.exact[size].get(numbers[place : place + size].tobytes()):
                    doc = int(np.searchsorted(begin, place, "right")) - 1
                    hits.setdefault(doc, []).append((place - int(begin[doc]), size, items))
        for doc, windows in hits.items():
            hit = np.zeros(counts[doc], bool)
            for at, size, _ in windows:
                hit[at : at + size] = True
            found[doc] = np.flatnonzero(hit), {i for *_, items in windows for i in items}
        return counts, found


def _blocks(benchmark: DataFrame, n: int, key: str, text: str, block_bytes: int):
    """How many blocks there are, and their broadcast windows one by one; a block is collected only while it is built.

    Equal rows are one with a count before they are dealt, so a row that is repeated a million times fills no block.
    """
    spark = benchmark.sparkSession
    items = benchmark.groupBy(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).agg(F.count("*").alias("times"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    own = lambda b: items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
    return blocks, (spark.sparkContext.broadcast(Windows([tuple(r) for r in own(b).collect()], n)) for b in range(blocks))


def _searched(rows: DataFrame, windows, every: bool) -> DataFrame:
    """(row, words, hit, items) of ``rows(row, text)``: all of them, or those that are hit."""

    def run(batches):
        for part, texts in pieces(batches):
            counts, found = windows.value.search(texts)
            own = [i for i, (h, _) in enumerate(found) if every or len(h)]
            items = [[{"id": windows.value.ids[k], "times": windows.value.times[k]} for k in found[i][1]] for i in own]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(own, pa.int64())), pa.array([counts[i] for i in own], pa.int64()),
                 pa.array([found[i][0] for i in own], pa.list_(pa.int32())),
                 pa.array(items, pa.list_(pa.struct([("id", pa.string()), ("times", pa.int64())])))], ["row", "words", "hit", "items"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, words long, hit array<int>, items array<struct<id: string, times: long>>")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, words, hit, items) of every row: its number of words, the places of hit words, and the items with their counts.

    Of several blocks the first reports every row, the others those that they hit; the reports are added up by
    the number of the row, and no text travels from block to block.
    """
    blocks, every = _blocks(benchmark, n, item, item_text, block_bytes)
    if blocks == 1:
        return _searched(docs.select(F.col(f"`{key}`").alias("row"), F.col(f"`{text}`").alias("text")), next(every), True).withColumnRenamed("row", "key")
    # Numbered and written once, so that every block sees the same numbers.
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")))
    parts = []
    for windows in every:
        parts.append(materialize(_searched(rows.select("row", "text"), windows, not parts)))
        windows.destroy()
    found = functools.reduce(DataFrame.unionAll, parts).groupBy("row").agg(
        F.max("words").alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
        F.flatten(F.collect_list("items")).alias("items"))
    return rows.select("row", "key").join(found, "row").drop("row")


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", n: int = WINDOW, **options) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    found = scan(docs, benchmark, n, key, text, **options)
    named = F.flatten(F.transform(F.filter("items", lambda i: i["id"].isNotNull()), lambda i: F.array_repeat(i["id"], i["times"].cast("int"))))
    return found.select(
        F.col("key").alias(key), F.col("words").alias("n_words"), F.size("hit").cast("long").alias("n_hit"),
        F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["times"]).alias("n_items"),
        F.sha2(F.array_join(F.array_sort(named), ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def without_hits(text: str, hit: list[int]) -> str:
    """The text without each stretch from the first to the last word of neighbouring hit words."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(WORD_BYTES))]
    out, at, marked = [], 0, set(hit)
    for i in hit:
        if i - 1 not in marked:
            out.append(raw[at : places[i][0]])
        at = places[i][1]
    return b"".join(out + [raw[at:]]).decode()


def cleaned(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", n: int = WINDOW, item: str = "item_id",
            item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, same columns, without those that are hit, or (``mode='spans'``) without the stretches that are hit.

    Each block takes its own away, so what a later block reads is what is left.  (Cutting a stretch out brings
    words together that were apart; what is hit only then is a matter of the order of blocks, and is cut as well.)
    """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    blocks, every = _blocks(benchmark, n, item, item_text, block_bytes)
    for windows in every:

        def run(batches, windows=windows):
            for part, texts in pieces(batches, text):
                _, found = windows.value.search(texts)
                hit = [len(h) > 0 for h, _ in found]
                if mode == "documents":
                    part = part.filter(pa.array([not h for h in hit], pa.bool_()))
                elif any(hit):
                    at = part.schema.get_field_index(text)
                    # Texts that are not hit stay as they are, null or empty.
                    cut = [without_hits(t, h.tolist()) if len(h) else old for t, (h, _), old in zip(texts, found, part.column(at).to_pylist())]
                    part = part.set_column(at, part.schema.field(at), pa.array(cut, part.schema.field(at).type))
                yield part

        docs = docs.mapInArrow(run, docs.schema)
        if blocks > 1:
            docs = materialize(docs)
            windows.destroy()
    return docs
