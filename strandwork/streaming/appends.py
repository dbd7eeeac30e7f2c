"""Chunked files, idempotent appends and compare-and-swap publication."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandwork.streaming.common import drain, drain_each, folder, part_of

FILE_OUT = "file long, chunks long, status string"


def _take(held: tuple, rows) -> tuple:
    """(want, chunks seen, clash) of a file after more ``rows`` of (chunk index, chunk count)."""
    want, have, clash = held
    for index, count in rows:
        clash = clash or (want not in (0, count)) or str(index) in have
        want = want or count
        have.add(str(index))
    return want, have, clash


def _gather(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    want, seen, clash, sent = state.get if state.exists else (0, "", False, False)
    held = (want, set(filter(None, seen.split(","))), clash)
    for rows in batches:
        held = _take(held, zip(rows["chunk_index"], rows["chunk_count"]))
    want, have, clash = held
    if have and len(have) == want and not sent:
        sent = True
        yield pd.DataFrame([(key[0], want, "disagrees" if clash else "complete")], columns=["file", "chunks", "status"])
    state.update((int(want), ",".join(sorted(have)), bool(clash), sent))


def _gather_part(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """``_gather`` for all files of a part; of a file that was sent only its name is left."""
    known = json.loads(state.get[0]) if state.exists else {}
    new: dict[str | None, list] = {}
    for rows in batches:
        for file, index, count in zip(rows["file"], rows["chunk_index"], rows["chunk_count"]):
            new.setdefault(file, []).append((index, count))
    out = []
    for file, rows in new.items():
        name = file or ""
        if known.get(name) is True:
            continue
        want, have, clash = known.get(name, (0, (), False))
        want, have, clash = _take((want, set(have), clash), rows)
        done = bool(have) and len(have) == want
        if done:
            out.append((int(file) if file else None, want, "disagrees" if clash else "complete"))
        known[name] = True if done else (int(want), sorted(have), bool(clash))
    state.update((json.dumps(known),))
    if out:
        yield pd.DataFrame(out, columns=["file", "chunks", "status"]).astype({"file": "Int64"})


def complete_files(chunks: DataFrame) -> DataFrame:
    """Emit a file once all its chunks are in: ``chunks(file, chunk_index, chunk_count)``."""
    # As texts, so that a null in a part does not turn the numbers of its other files into floats.
    rows = chunks.select(part_of("file"), F.col("file").cast("string").alias("file"), F.col("chunk_index").cast("string").alias("chunk_index"),
                         F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    return rows.groupBy("part").applyInPandasWithState(_gather_part, FILE_OUT, "files string", "append", GroupStateTimeout.NoTimeout)


def append_once(stream: DataFrame, key: str, name: str, place: str | None = None) -> DataFrame:
    """Append every key once, within a batch, across batches and, given a ``place``, across restarts.

    The keys that were seen are the stream's state, which is dealt over the executors and kept beside the
    checkpoint; earlier rows are never read again.  A null key is a key.
    """
    return drain(stream.dropDuplicates([key]), name, place=place)


def publish_if_current(stream: DataFrame, name: str, place: str | None = None) -> DataFrame:
    """Compare-and-swap: per slot the lowest request on the current base wins the batch; others are stale.

    ``stream(slot, seq, base)``.  The current base of a slot is the number of batches that
    it was published in before, kept as a written table per batch.
    """
    spark = stream.sparkSession
    place = place or folder(spark, name)
    log, heads = f"{place}/judged", f"{place}/heads"
    head_schema = "slot long, head long, batch long"

    def step(batch: DataFrame, batch_id: int) -> None:
        old = spark.read.schema(head_schema).parquet(f"{heads}/{batch_id - 1:09d}") if batch_id else spark.createDataFrame([], head_schema)
        met = batch.join(old.select("slot", "head"), "slot", "left").withColumn("head", F.coalesce("head", F.lit(0)))
        fits = met.where("base = head").groupBy("slot").agg(F.min("seq").alias("winner"))
        judged = met.join(fits, "slot", "left").select("slot", "seq", F.when(F.col("seq") == F.col("winner"), "published").otherwise("stale_base").alias("outcome"))
        judged.write.mode("overwrite").parquet(f"{log}/{batch_id:09d}")
        heads_now = old.select("slot", "head").join(fits, "slot", "full").select(
            "slot", (F.coalesce("head", F.lit(0)) + F.col("winner").isNotNull().cast("long")).alias("head"), F.lit(batch_id).cast("long").alias("batch"))
        heads_now.write.mode("overwrite").parquet(f"{heads}/{batch_id:09d}")

    drain_each(stream, name, step, place=place)
    return spark.read.schema("slot long, seq long, outcome string").option("recursiveFileLookup", True).parquet(log)
