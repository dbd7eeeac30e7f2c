"""Reader actions: expansion sets, optimistic views, exposure windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What an event means as a reader action.
ACTIONS = {"view": "expand", "click": "collapse", "purchase": "set_budget", "signup": "reset", "error": "switch_locale"}


def actions(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for p in ACTIONS.items() for x in p])
    return events.select(F.col("user_id").alias("reader"), F.col("event_id").alias("seq"), "ts", kind[F.col("event_type")].alias("action"),
                         F.concat(F.lit("n:"), F.col("event_id") % 25).alias("target"), F.col("value"))


def last_touch(acts: DataFrame) -> DataFrame:
    """Latest sequence number per reader, action and target.

    All that an expansion set needs is a maximum, so the stream folds on the map
    side and a reader of any activity is spread over its targets.
    """
    target = F.when(F.col("action").isin("expand", "collapse"), F.col("target")).otherwise(F.lit("*"))
    return acts.groupBy("reader", "action", target.alias("target")).agg(F.max("seq").alias("seq"))


def expansion_sets(touch: DataFrame, closure: DataFrame) -> DataFrame:
    """(reader, node) expanded now: expanded after the last collapse of it or anything above it and after the last reset."""
    opened = touch.where("action = 'expand'").select("reader", F.col("target").alias("node"), F.col("seq").alias("at"))
    shut = touch.where("action = 'collapse'").select("reader", F.col("target").alias("ancestor"), F.col("seq").alias("shut"))
    closed = opened.join(closure, "node").join(shut, ["reader", "ancestor"]).where("shut > at").select("reader", "node").distinct()
    reset = touch.where("action = 'reset'").select("reader", F.col("seq").alias("reset_at"))
    return opened.join(closed, ["reader", "node"], "left_anti").join(reset, "reader", "left").where(
        "reset_at IS NULL OR reset_at < at").select("reader", "node")


def exposure_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.count("*").alias("exposures"), F.sum("value").alias("amount")).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "exposures", F.round("amount", 2).alias("amount"))


VIEW_OUT = "reader long, seq long, status string, view long"


def _apply(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    view = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for r in rows.itertuples(index=False):
        fresh = r.expected == view
        view += int(fresh)
        out.append((key[0], r.seq, "applied" if fresh else "stale_view", view))
    state.update((view,))
    yield pd.DataFrame(out, columns=["reader", "seq", "status", "view"])


def optimistic(acts: DataFrame) -> DataFrame:
    """Apply an action only if it expects the reader's current view; each applied action makes the next view.

    The order of one reader's actions matters, so a reader is a key with a counter
    as its state; a micro-batch bounds what a task sees of it.
    """
    return acts.select("reader", "seq", "expected").groupBy("reader").applyInPandasWithState(
        _apply, VIEW_OUT, "view long", "append", GroupStateTimeout.NoTimeout)
