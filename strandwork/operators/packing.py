"""Greedy packing of ordered items under a count and a size cap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strandwork.operators.order_stats import positions, running
from strandwork.session import materialize


def pack(df: DataFrame, keys: Sequence[str], order: str, size: str, max_count: int, max_size: int) -> DataFrame:
    """Add ``batch``: fill each batch in order until the next item would break a cap.

    Where the batch that starts at an item ends depends only on that item, so every
    item gets a pointer to the start of the following batch: the first position
    after it whose running total passes the cap.  Batches are the items on the
    pointer walk from position 0, found by doubling the pointers; a group of any
    length takes a logarithmic number of joins.  An item above the size cap fills a
    batch of its own.
    """
    placed = materialize(positions(df, keys, [order], "pos"))
    total = materialize(running(placed, keys, ["pos"], {"upto": F.col(size).cast("long")}))
    # Reach of each start: the running total before it plus the cap, looked up among all running totals.
    events = total.select(*keys, (F.col("upto") - F.col(size) + max_size).alias("mark"), F.lit(1).alias("ask"), F.col("pos").alias("p")).unionAll(
        total.select(*keys, "upto", F.lit(0), "pos"))
    passed = running(events, keys, ["mark", "ask", "p"], {"within": F.when(F.col("ask") == 0, 1).otherwise(0).cast("long")})
    ends = passed.where("ask = 1").select(*keys, F.col("p").alias("pos"), F.col("within").alias("by_size"))
    count = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    step = materialize(ends.join(count, list(keys)).select(
        *keys, "pos", F.least(F.greatest(F.col("by_size"), F.col("pos") + 1), F.col("pos") + max_count, F.col("n")).alias("next"), "n"))
    # Mark batch starts: position 0, then everything 1, 2, 4, ... pointer steps away from a marked one.
    starts = materialize(step.where("pos = 0").select(*keys, "pos"))
    hop = step.select(*keys, "pos", "next")
    while True:
        ahead = starts.join(hop, [*keys, "pos"]).select(*keys, F.col("next").alias("pos"))
        grown = materialize(starts.unionAll(ahead.join(count, list(keys)).where("pos < n").select(*keys, "pos")).distinct())
        if grown.count() == starts.count():
            break
        starts = grown
        far = hop.select(*keys, F.col("pos").alias("next"), F.col("next").alias("beyond"))
        hop = materialize(hop.join(far, [*keys, "next"], "left").select(*keys, "pos", F.coalesce("beyond", "next").alias("next")))
    flagged = placed.join(starts.withColumn("first", F.lit(1).cast("long")), [*keys, "pos"], "left").fillna(0, ["first"])
    return running(flagged, keys, ["pos"], {"batch": F.col("first")}).select(*df.columns, (F.col("batch") - 1).alias("batch"))
