"""Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets of about ``BUCKET_BYTES`` (more for inputs of
terabytes) by a seeded hash
of their key, text and place in the input, so that neither equal ids nor equal texts
meet in one bucket.  Pass two holds one bucket in a task, brings it into an order
that does not depend on how the pieces arrived, applies a Fisher-Yates permutation
seeded by the bucket, and writes it.  A record's position is its place in the bucket
plus the sizes of the buckets before it.

Law ``rows``: position p goes to shard p mod n as its slot p div n, so counts differ
by at most one and slots have no gaps.  Copies are not kept together: a group of
copies may hold a third of all rows, which no law of even counts could honour.

Cases: a null text has no bytes and the checksum of the empty text; repeated rows are
separate records; a record larger than a bucket is held alone with what its bucket
drew; an empty table has no rows; other columns travel along under their own names,
also if they are called like the columns made here.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandwork.session import materialize

#: Bytes of a bucket: the least, and the most, of which a task holds some three copies while it permutes.
BUCKET_BYTES, LARGEST_BUCKET = 32 << 20, 256 << 20
#: Buckets that an input is aimed at before buckets grow; their sizes are summed up in one task, as a few numbers each.
AIM_BUCKETS = 1 << 15
#: Buckets of small inputs; more only if the bytes ask for it.
LEAST_BUCKETS = 32
#: The table of bucket sizes (16 bytes a bucket) is broadcast up to so many buckets, and joined by shuffle beyond.
BROADCAST_BUCKETS = 1 << 19
#: Rows that a task hands on at once.
OUT_ROWS = 4096


def _permuted(seed: int):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        bucket = pa.Table.from_batches(held)
        number = bucket.column("bucket")[0].as_py()
        order = np.random.Generator(np.random.PCG64([seed, number])).permutation(bucket.num_rows)
        for begin in range(0, len(order), OUT_ROWS):
            part = bucket.take(pa.array(order[begin : begin + OUT_ROWS])).combine_chunks()
            place = pa.array(np.arange(begin, begin + part.num_rows, dtype=np.int64))
            out = pa.table([part.column("bucket").cast(pa.int64()), place, part.column("record")], ["bucket", "place", "record"])
            yield from out.to_batches()

    return run


def buckets_for(total: int) -> int:
    """Buckets grow with the input from ``BUCKET_BYTES`` to ``LARGEST_BUCKET``; only then does their number (100 TB: 390,000)."""
    each = min(LARGEST_BUCKET, max(BUCKET_BYTES, total // AIM_BUCKETS))
    return max(LEAST_BUCKETS, math.ceil(total / each))


def shuffled(records: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """The records in random order: (position, record), written to the shared folder."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    total = records.agg(F.sum(size)).first()[0] or 0
    buckets = buckets_for(total)
    whole = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    order = F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.col(text).cast("binary")), F.monotonically_increasing_id())
    scattered = records.select(whole.alias("record"), order.alias("order")).withColumn(
        "bucket", F.pmod(F.xxhash64("order", F.lit(seed)), F.lit(buckets)).cast("int")).repartitionById(
        buckets, F.col("bucket")).sortWithinPartitions("order").select("bucket", "record")
    out = StructType([StructField("bucket", LongType()), StructField("place", LongType()), scattered.schema["record"]])
    written = materialize(scattered.mapInArrow(_permuted(seed), out))
    counts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    before = counts.select("bucket", F.coalesce(F.sum("n").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if buckets <= BROADCAST_BUCKETS:
        before = F.broadcast(before)
    return written.join(before, "bucket").select((F.col("before") + F.col("place")).alias("position"), "record")


def sharded(records: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """(shard, slot, record): whole records, evenly dealt in random order."""
    return shuffled(records, key, text, seed).select(
        (F.col("position") % shards).cast("int").alias("shard"), F.floor(F.col("position") / shards).cast("long").alias("slot"), "record")
