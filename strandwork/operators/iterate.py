"""Loops over graph tables: each round is a Spark job, cut by a written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandwork.session import dealt, materialize, measured


def _empty(df: DataFrame) -> bool:
    return not df.limit(1).take(1)


def reach(edges: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All nodes reachable from ``seeds(node)`` along provider -> consumer edges, with hop count.

    With ``keys`` every key combination is its own search (semi-naive): only the
    pairs found in the last round are extended.
    """
    cols = [*keys, "node"]
    frontier = materialize(seeds.select(*cols).distinct().withColumn("hops", F.lit(0)))
    seen, parts = frontier, 0
    while True:
        # The hop number travels as data: a literal would make every round a newly compiled plan.
        step = frontier.join(dealt(edges), F.col("node") == F.col("provider")).groupBy(
            *keys, F.col("consumer").alias("node")).agg((F.first("hops") + 1).alias("hops"))
        frontier, new = measured(step.join(dealt(seen.select(*cols)), cols, "left_anti"), n=F.count("*"))
        if not new["n"]:
            return seen
        seen = seen.unionAll(frontier)
        parts += 1
        if parts % 8 == 0:
            seen = materialize(seen)


def ancestors(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """Ancestor closure (node, ancestor, depth >= 0) of a parent-pointer forest.

    Pairs at distance up to 2^k give those up to 2^(k+1), so a forest of depth d
    takes log2(d) joins.  A node above itself is a cycle and an error; see
    ``parent_cycles`` for a report.
    """
    known = nodes.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).where("ancestor IS NOT NULL")
    known = known.join(dealt(nodes.select(F.col(node).alias("ancestor"))), "ancestor", "left_semi").select(
        "node", "ancestor", F.lit(1).cast("long").alias("depth"))
    figures = {"longest": F.max("depth"), "loops": F.count_if(F.col("node") == F.col("ancestor"))}
    known, seen = measured(known, **figures)
    reachd = 1
    while seen["longest"] == reachd:
        longest = known.where(F.col("depth") == reachd)
        more = longest.alias("a").join(dealt(known).alias("b"), F.col("a.ancestor") == F.col("b.node")).select(
            F.col("a.node"), F.col("b.ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        known, seen = measured(known.unionAll(more), **figures)
        if seen["loops"]:
            raise ValueError("parent pointers run in a circle")
        reachd *= 2
    own = nodes.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    return own.unionAll(known)


def parent_cycles(nodes: DataFrame) -> DataFrame:
    """Nodes of ``nodes(node, parent)`` on a parent cycle or below one."""
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("k"))
    ends = jump_to_root(nodes.join(dealt(known), "parent", "left").select("node", F.when(F.col("k"), F.col("parent")).alias("target")))
    return ends.where("root IS NULL").select("node")


def jump_to_root(nodes: DataFrame) -> DataFrame:
    """Follow ``target`` pointers to the end: (node, root, hops); root is null for rows on or under a cycle."""
    state = materialize(nodes.select("node", F.col("target").alias("root"),
                                     F.when(F.col("target").isNull(), 0).otherwise(1).cast("long").alias("hops")))
    limit = max(1, state.count())
    span = 1
    while True:
        ahead = state.select(F.col("node").alias("root"), F.col("root").alias("beyond"), F.col("hops").alias("more"))
        state = materialize(
            state.join(dealt(ahead), "root", "left").select(
                "node", F.coalesce("beyond", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
        span *= 2
        live = state.join(dealt(ahead.where("beyond IS NOT NULL").select("root")), "root", "left_semi")
        if _empty(live) or span > 2 * limit:
            break
    ends = nodes.where("target IS NULL").select(F.col("node").alias("root"))
    settled = state.where("root IS NOT NULL").join(dealt(ends), "root", "left_semi").select("node", "root", "hops")
    own = nodes.where("target IS NULL").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("hops"))
    done = settled.unionAll(own)
    rest = nodes.join(dealt(done), "node", "left_anti").select(
        "node", F.lit(None).cast(nodes.schema["node"].dataType).alias("root"), F.lit(None).cast("long").alias("hops"))
    return done.unionAll(rest)


def waves(nodes: DataFrame, edges: DataFrame, carry: Column | None = None) -> DataFrame:
    """Release nodes whose providers are all released, one wave per round.

    ``nodes`` has ``node`` and, when ``carry`` is used, ``rank`` (distinct within
    whatever is to be ordered).  Result: (node, level, left, trail); ``level`` is
    the longest path from a source, null for nodes on or behind a cycle.

    ``trail`` decides the exact order in which a ready queue that always takes the
    smallest rank would emit the nodes.  A node leaves the queue right after the
    largest rank among its ancestors has left; what is still undecided is again
    decided by the largest rank behind that one, and so on.  So the trail of a
    node is the greatest trail of its providers, cut to the entries above its own
    rank, followed by its own rank, and the queue order is the order of trails.
    """
    with_trail = carry is not None
    live = edges.select("provider", "consumer").where(F.col("provider") != F.col("consumer"))
    loops = edges.where(F.col("provider") == F.col("consumer")).groupBy(F.col("consumer").alias("node")).agg(
        F.count("*").alias("self"))
    live = materialize(live)
    degree = live.groupBy(F.col("consumer").alias("node")).agg(F.count("*").alias("left"))
    rank = carry if with_trail else F.lit(0)
    none = F.lit(None).cast("array<bigint>")
    state = nodes.join(dealt(degree), "node", "left").join(dealt(loops), "node", "left").select(
        "node", rank.cast("long").alias("rank"),
        (F.coalesce("left", F.lit(0)) + F.coalesce("self", F.lit(0))).cast("long").alias("left"), none.alias("best"), F.lit(0).alias("round"))
    own = F.array(F.col("rank"))

    def released(df: DataFrame) -> DataFrame:
        kept = F.filter("best", lambda x: x > F.col("rank"))
        trail = F.when(F.col("best").isNull(), own).otherwise(F.concat(kept, own)) if with_trail else none
        ready = F.col("left") == 0
        # The round number travels as data: a literal would make every round a newly compiled plan.
        return df.select("node", "rank", "left", F.when(~ready, F.col("best")).alias("best"), "round",
                         F.when(ready, F.col("round")).alias("level"), F.when(ready, trail).alias("trail"))

    figures = {"size": F.count_if(F.col("level").isNotNull()), "rest": F.count_if(F.col("level").isNull())}
    waiting, seen = measured(released(state), **figures)
    done: list[DataFrame] = []
    total, gone = seen["size"] + seen["rest"], 0
    while seen["size"]:
        wave = waiting.where("level IS NOT NULL")
        done.append(wave)
        if len(done) % 16 == 0:
            merged = done[0]
            for d in done[1:]:
                merged = merged.unionAll(d)
            done = [materialize(merged)]
        gone += seen["size"]
        if gone * 2 > total:
            # Most of what was live is released: rewrite only the edges still needed.
            live = materialize(live.join(dealt(waiting.select(F.col("node").alias("provider"))), "provider", "left_semi"))
            total, gone = total - gone, 0
        if not seen["rest"]:
            waiting = waiting.where("level IS NULL")
            break
        told = wave.select(F.col("node").alias("provider"), "trail").join(dealt(live), "provider").groupBy(
            F.col("consumer").alias("node")).agg(F.count("*").alias("hits"), F.max("trail").alias("offer"))
        moved = waiting.where("level IS NULL").join(dealt(told), "node", "left").select(
            "node", "rank", (F.col("left") - F.coalesce("hits", F.lit(0))).alias("left"),
            _greater("best", "offer").alias("best"), (F.col("round") + 1).alias("round"))
        waiting, seen = measured(released(moved), **figures)
    out = waiting.where("level IS NULL")
    for d in done:
        out = out.unionAll(d)
    return out.select("node", "level", "left", "trail")


def _greater(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    return F.when(x.isNull() | (y > x), y).otherwise(x)
