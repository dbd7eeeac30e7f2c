"""Ready queues that soft relations steer, for all parents at once.

Of the atoms that may come next, those go first that no soft relation asks to wait for
another one of them, and of these the one with the smallest rank.  Only where every atom
that may come next is asked to wait (soft relations run in a circle) are all of them
taken into account.

What an atom waits for lies in its own bundle: the atoms that ties and soft relations
connect with it.  So bundles are emitted on their own and merged afterwards: a merge that
always takes the smallest head is the order of the largest rank that each bundle has
emitted so far.  Bundles without soft relations take the ``waves`` engine.  Those with
soft relations in a circle can come to stand still, and then go on only when nothing else
of their parent can; such bundles of a parent are emitted together, and what they emit
after standing still comes last.

Relations of an atom to itself or to atoms that are not in the table are ignored,
repeated ones count once; ``ties`` must be free of cycles.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandwork.operators.iterate import waves
from strandwork.operators.order_stats import positions, running
from strandwork.session import dealt, materialize, measured

# Rows (atoms and relations) of a bundle that one task emits; larger bundles are emitted in rounds over tables.
TASK_ROWS = 200_000

GROUP = ["parent", "knot", "bundle"]


def bundles(links: DataFrame) -> DataFrame:
    """(parent, atom, bundle): linked atoms under the smallest name of all that are linked with them, however far.

    Every round an atom and the atom it is named after take the smallest name across
    each link, and names of names replace names, so chains shorten to half.
    """
    both = materialize(links.select("parent", F.col("provider").alias("atom"), F.col("consumer").alias("other")).unionAll(
        links.select("parent", "consumer", "provider")).where("atom <> other").distinct())
    state = materialize(both.select("parent", "atom").distinct().withColumn("bundle", F.col("atom")))
    while True:
        other = state.select("parent", F.col("atom").alias("other"), F.col("bundle").alias("offer"))
        offers = both.join(dealt(state), ["parent", "atom"]).join(dealt(other), ["parent", "other"]).select("parent", "atom", "bundle", "offer")
        offers = offers.select("parent", F.explode(F.array("atom", "bundle")).alias("atom"), "offer").groupBy("parent", "atom").agg(
            F.min("offer").alias("offer"))
        hooked = materialize(state.join(dealt(offers), ["parent", "atom"], "left").select(
            "parent", "atom", F.col("bundle").alias("before"), F.least("bundle", "offer").alias("bundle")))
        names = hooked.select("parent", F.col("atom").alias("bundle"), F.col("bundle").alias("name"))
        state, seen = measured(hooked.join(dealt(names), ["parent", "bundle"]).select(
            "parent", "atom", F.col("name").alias("bundle"), (F.col("name") != F.col("before")).alias("moved")), moved=F.count_if("moved"))
        state = state.select("parent", "atom", "bundle")
        if not seen["moved"]:
            return state


def emit(rank: dict, ties: list[tuple], soft: list[tuple]) -> list[tuple]:
    """(atom, late) of one bundle in the order of emission; late from where the bundle stood still."""
    after: dict = {x: [] for x in rank}
    asks: dict = {x: [] for x in rank}
    left, held = dict.fromkeys(rank, 0), dict.fromkeys(rank, 0)
    for a, b in ties:
        after[a].append(b)
        left[b] += 1
    for a, b in soft:
        asks[a].append(b)
    ready: set = set()
    free: list = []
    every: list = []

    def enter(atoms: list) -> None:
        for x in atoms:
            ready.add(x)
            for y in asks[x]:
                held[y] += 1
        for x in atoms:
            heapq.heappush(every, (rank[x], x))
            if not held[x]:
                heapq.heappush(free, (rank[x], x))

    enter([x for x in rank if not left[x]])
    out, late = [], False
    while ready:
        # Entries are never taken back: one that has left or has to wait by now is passed over.
        while free and (free[0][1] not in ready or held[free[0][1]]):
            heapq.heappop(free)
        if free:
            x = heapq.heappop(free)[1]
        else:
            late = True
            while every[0][1] not in ready:
                heapq.heappop(every)
            x = heapq.heappop(every)[1]
        ready.remove(x)
        out.append((x, late))
        for y in asks[x]:
            held[y] -= 1
            if not held[y] and y in ready:
                heapq.heappush(free, (rank[y], y))
        freed = []
        for y in after[x]:
            left[y] -= 1
            if not left[y]:
                freed.append(y)
        enter(freed)
    if len(out) != len(rank):
        raise ValueError("ties run in a circle")
    return out


def _emit_bundle(key, atoms: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    hard = links["hard"].to_numpy(bool)
    pairs = list(zip(links["provider"], links["consumer"]))
    out = emit(dict(zip(atoms["atom"], atoms["rank"])), [p for p, h in zip(pairs, hard) if h], [p for p, h in zip(pairs, hard) if not h])
    told = pd.DataFrame(out, columns=["atom", "late"])
    told["rank"] = told["atom"].map(dict(zip(atoms["atom"], atoms["rank"])))
    told["step"] = range(len(told))
    return told.assign(parent=key[0], knot=key[1], bundle=key[2])[[*GROUP, "atom", "rank", "step", "late"]]


def _emit_in_rounds(atoms: DataFrame, links: DataFrame) -> DataFrame:
    """The same as ``_emit_bundle`` over tables.

    A round emits, by rank, the free atoms of each bundle up to and with the first one
    whose leaving can change what is ready or has to wait.
    """
    ties, soft = (materialize(links.where(w).select(*GROUP, "provider", "consumer")) for w in ("hard", "NOT hard"))
    end = lambda df, name, *more: df.select(*GROUP, F.col("atom").alias(name), *more)
    left = ties.groupBy(*GROUP, F.col("consumer").alias("atom")).agg(F.count("*").alias("left"))
    waiting, seen = measured(atoms.join(dealt(left), [*GROUP, "atom"], "left").select(
        *GROUP, "atom", "rank", F.coalesce("left", F.lit(0)).alias("left"), F.lit(0).cast("long").alias("round")), rows=F.count("*"))
    done: list[DataFrame] = []
    while seen["rows"]:
        ready = waiting.where("left = 0")
        met = soft.join(dealt(end(ready, "provider")), [*GROUP, "provider"], "left_semi").join(dealt(end(ready, "consumer")), [*GROUP, "consumer"], "left_semi")
        met = materialize(met)
        held = end(met.select(*GROUP, F.col("consumer").alias("atom")).distinct(), "atom", F.lit(True).alias("held"))
        state = materialize(ready.join(dealt(held), [*GROUP, "atom"], "left").withColumn("held", F.coalesce("held", F.lit(False))))
        free = state.where("NOT held")
        # An atom comes to be ready in this round only if all that it still waits for is free.
        from_free = ties.join(dealt(end(free, "provider")), [*GROUP, "provider"], "left_semi")
        opened = from_free.groupBy(*GROUP, "consumer").agg(F.count("*").alias("hits")).join(
            dealt(end(waiting, "consumer", "left")), [*GROUP, "consumer"]).where("hits = left")
        openers = from_free.join(dealt(opened), [*GROUP, "consumer"], "left_semi").select(*GROUP, F.col("provider").alias("atom"))
        event = openers.unionAll(met.select(*GROUP, F.col("provider").alias("atom"))).distinct()
        until = free.join(dealt(event), [*GROUP, "atom"], "left_semi").groupBy(*GROUP).agg(F.min("rank").alias("until"))
        still = state.groupBy(*GROUP).agg(F.bool_and("held").alias("still"), F.min("rank").alias("least"))
        gone = materialize(state.join(dealt(still), GROUP).join(dealt(until), GROUP, "left").where(
            "(still AND rank = least) OR (NOT held AND rank <= coalesce(until, rank))").select(
            *GROUP, "atom", "rank", F.col("round").alias("step"), "still"))
        if not gone.take(1):
            raise ValueError("ties run in a circle")
        done.append(gone)
        if len(done) % 16 == 0:
            done = [materialize(_all(done))]
        hits = ties.join(dealt(end(gone, "provider")), [*GROUP, "provider"], "left_semi").groupBy(
            *GROUP, F.col("consumer").alias("atom")).agg(F.count("*").alias("hits"))
        waiting, seen = measured(waiting.join(dealt(gone), [*GROUP, "atom"], "left_anti").join(dealt(hits), [*GROUP, "atom"], "left").select(
            *GROUP, "atom", "rank", (F.col("left") - F.coalesce("hits", F.lit(0))).alias("left"), (F.col("round") + 1).alias("round")),
            rows=F.count("*"))
    out = _all(done)
    since = out.where("still").groupBy(*GROUP).agg(F.min("step").alias("since"))
    return out.join(dealt(since), GROUP, "left").select(*GROUP, "atom", "rank", "step", F.coalesce(F.col("step") >= F.col("since"), F.lit(False)).alias("late"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def soft_queue(atoms: DataFrame, ties: DataFrame, soft: DataFrame, rank: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """(parent, atom, pos): the order in which the queue emits ``atoms(parent, atom, <rank>)``; ranks differ within a parent."""
    nodes = materialize(atoms.select("parent", "atom", F.col(rank).cast("long").alias("rank")))

    def among(pairs: DataFrame, hard: bool) -> DataFrame:
        pairs = pairs.select("parent", "provider", "consumer").where("provider <> consumer").distinct()
        for side in ("provider", "consumer"):
            pairs = pairs.join(dealt(nodes.select("parent", F.col("atom").alias(side))), ["parent", side], "left_semi")
        return pairs.select("parent", "provider", "consumer", F.lit(hard).alias("hard"))

    links = materialize(among(ties, True).unionAll(among(soft, False)))
    wishes = links.where("NOT hard")
    named = bundles(links)
    steered = materialize(named.join(dealt(wishes.select("parent", F.col("provider").alias("atom"))), ["parent", "atom"], "left_semi").select(
        "parent", "bundle").distinct())
    members = materialize(named.join(dealt(steered), ["parent", "bundle"], "left_semi"))
    node = lambda end: F.struct("parent", F.col(end).alias("atom"))
    pairs = lambda df: df.select(node("provider").alias("provider"), node("consumer").alias("consumer"))
    asked = members.join(dealt(wishes.select("parent", F.explode(F.array("provider", "consumer")).alias("atom"))), ["parent", "atom"], "left_semi")
    circles = waves(asked.select(node("atom").alias("node")), pairs(wishes)).where("level IS NULL").select("node.parent", "node.atom")
    knots = materialize(members.join(dealt(circles), ["parent", "atom"], "left_semi").select("parent", "bundle").distinct()).withColumn("knot", F.lit(True))
    members = materialize(members.join(dealt(knots), ["parent", "bundle"], "left").select(
        "parent", "atom", F.coalesce("knot", F.lit(False)).alias("knot"), F.when(F.col("knot"), "").otherwise(F.col("bundle")).alias("bundle")))

    inner = materialize(nodes.join(dealt(members), ["parent", "atom"]).select(*GROUP, "atom", "rank"))
    bound = materialize(links.join(dealt(members.withColumnRenamed("atom", "provider")), ["parent", "provider"]).select(*GROUP, "provider", "consumer", "hard"))
    sizes = materialize(inner.select(*GROUP).unionAll(bound.select(*GROUP)).groupBy(*GROUP).agg(F.count("*").alias("rows")))
    small, large = sizes.where(F.col("rows") <= task_rows), sizes.where(F.col("rows") > task_rows)
    told = inner.join(dealt(small), GROUP, "left_semi").groupBy(*GROUP).cogroup(bound.join(dealt(small), GROUP, "left_semi").groupBy(*GROUP)).applyInPandas(
        _emit_bundle, "parent string, knot boolean, bundle string, atom string, rank long, step long, late boolean")
    if large.take(1):
        told = told.unionAll(_emit_in_rounds(inner.join(dealt(large), GROUP, "left_semi"), bound.join(dealt(large), GROUP, "left_semi")))
    told = running(materialize(told), GROUP, ["step", "rank"], {"top": F.col("rank")}, fold="max")

    alone = nodes.join(dealt(members), ["parent", "atom"], "left_anti")
    apart = links.where("hard").join(dealt(members.withColumnRenamed("atom", "provider")), ["parent", "provider"], "left_anti")
    plain = waves(alone.select(node("atom").alias("node"), "rank"), pairs(apart), F.col("rank"))
    none, zero = F.lit(None).cast("array<bigint>"), F.lit(0).cast("long")
    merged = told.select("parent", "atom", "late", F.when(F.col("late"), zero).otherwise(F.col("top")).alias("top"), "step", "rank", none.alias("trail"))
    merged = merged.unionAll(plain.select("node.parent", "node.atom", F.lit(False), F.col("trail")[0], zero, zero, "trail"))
    return positions(merged, ["parent"], ["late", "top", "step", "rank", "trail"], "pos").select("parent", "atom", "pos")
