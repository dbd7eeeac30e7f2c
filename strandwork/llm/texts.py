"""Helpers that several operators share: Arrow passes over texts in pieces of bounded size, ragged arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that are Python strings at once inside a task; one longer text is a piece of its own.
PIECE_BYTES = 1_000_000
#: Bytes that an entry of a worker's memory takes besides its word.
ENTRY = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into pieces of about ``PIECE_BYTES``, each with its texts (null: empty).

    Cuts are made by the lengths alone; only the texts of one piece are ever strings.  At the
    end of the task Arrow gives back what it holds, for the next stage in the same worker.
    """
    for batch in batches:
        at = batch.schema.get_field_index(text)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(sizes):
            before = int(ends[begin] - sizes[begin])
            end = max(begin + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
            part = batch.slice(begin, end - begin)
            yield part, [t or "" for t in part.column(at).to_pylist()]
            begin = end
    pa.default_memory_pool().release_unused()


def weight(word: str | bytes) -> int:
    """About what a remembered word takes: itself, its entry, and a number or two."""
    return len(word) + ENTRY


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start, start + 1, ...`` of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def learns(doc_id: Column, parts: int, out: int) -> Column:
    """True where crc32 of the id as text leaves another remainder than ``out``; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts != out, F.lit(False))


def held_out(doc_id: Column, parts: int, out: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == out, F.lit(False))
