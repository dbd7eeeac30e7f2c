"""Absorption of exclusive helpers into the one group of their scope that uses them."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandwork.operators.order_stats import positions
from strandwork.session import dealt, materialize

# Capacity of one group.
MAX_DECLARATIONS, MAX_CODEPOINTS = 8, 12_000
# Scopes up to this many rows are worked through inside one task; larger ones in table rounds.
TASK_ROWS = 200_000


def protected_refs(decls: DataFrame, owner: DataFrame, edges: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Outcomes, kept-apart refs, unmerged compiler-only refs, and providers used outside their scope or repository."""
    named = decls.where("outcome").select("ref")
    if keep is not None:
        named = named.unionAll(keep.select("ref"))
    alone = decls.where("technical").select("ref").join(dealt(owner.where("ref = owner").select("ref")), "ref", "left_semi")
    place = decls.select("ref", "repo_key", "scope_id")
    used = edges.join(dealt(place.toDF("provider", "r1", "s1")), "provider").join(dealt(place.toDF("consumer", "r2", "s2")), "consumer", "left").where(
        "s2 IS NULL OR s1 <> s2 OR r1 <> r2").select(F.col("provider").alias("ref"))
    return named.unionAll(alone).unionAll(used).distinct()


def group_tables(decls: DataFrame, owner: DataFrame, edges: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scope_id, grp, rank, members, size, protected) and the use edges between groups of one scope."""
    shield = protected_refs(decls, owner, edges, keep).withColumn("shield", F.lit(True))
    sized = decls.join(dealt(owner), "ref").join(dealt(shield), "ref", "left")
    groups = sized.groupBy(F.col("owner").alias("grp")).agg(
        F.count("*").alias("members"), F.sum("size").alias("size"), F.count("shield").alias("s")).join(
        dealt(decls.select(F.col("ref").alias("grp"), "scope_id", "source_key")), "grp")
    ranked = positions(groups, ["scope_id"], ["source_key", "grp"], "rank").select(
        "scope_id", "grp", "rank", "members", "size", (F.col("s") > 0).alias("protected"))
    at = owner.join(dealt(decls.select(F.col("ref").alias("owner"), "scope_id")), "owner")
    uses = edges.join(dealt(at.toDF("g1", "provider", "s1")), "provider").join(dealt(at.toDF("g2", "consumer", "s2")), "consumer").where(
        "s1 = s2 AND g1 <> g2").select(F.col("s1").alias("scope_id"), F.col("g1").alias("provider"), F.col("g2").alias("consumer")).distinct()
    return ranked, uses


def _absorb(groups: pd.DataFrame, uses: pd.DataFrame, max_members: int, max_size: int):
    """Absorb inside one scope, always the first eligible helper in rank order."""
    g = groups.sort_values("rank")
    rank = dict(zip(g.grp, g["rank"])) if len(g) else {}
    count, size = dict(zip(g.grp, g.members)), dict(zip(g.grp, g["size"]))
    shield, into = dict(zip(g.grp, g.protected)), {}
    users, sources = {x: set() for x in rank}, {x: set() for x in rank}
    for p, c in zip(uses.provider, uses.consumer):
        users[p].add(c)
        sources[c].add(p)

    def verdict(x):
        if shield[x]:
            return "protected"
        if len(users[x]) != 1:
            return "shared" if users[x] else "unused"
        (t,) = users[x]
        return "capacity" if count[x] + count[t] > max_members or size[x] + size[t] > max_size else None

    notes, picked, since = set(), [], dict.fromkeys(rank, 0)

    def remember(x, why):
        # The reason counts if a scan that went past x happened while it held.
        if why is not None and any(r > rank[x] for r in picked[since[x]:]):
            notes.add((x, why))

    ready = [(rank[x], x) for x in rank]
    heapq.heapify(ready)
    while ready:
        _, h = heapq.heappop(ready)
        if h not in rank or h in into or verdict(h) is not None:
            continue
        (t,) = users[h]
        touched = ({t} | sources[h] | sources[t]) - {h}
        before = {x: verdict(x) for x in touched}
        picked.append(rank[h])
        for x in touched:
            remember(x, before[x])
        into[h] = t
        count[t] += count[h]
        size[t] += size[h]
        shield[t] = shield[t] or shield[h]
        for x in sources[h]:
            users[x].discard(h)
            if x != t:
                users[x].add(t)
                sources[t].add(x)
        users[t].discard(h)
        sources[t].discard(h)
        for x in touched:
            since[x] = len(picked)
            heapq.heappush(ready, (rank[x], x))
    for x in rank:
        if x not in into:
            why = verdict(x)
            notes.add((x, why))
    return into, notes


def absorb(groups: DataFrame, uses: DataFrame, max_members: int = MAX_DECLARATIONS, max_size: int = MAX_CODEPOINTS,
           task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(grp, target) of absorbed groups, the target being a survivor, and (grp, reason) of refusals.

    Scopes do not influence each other, so scopes of bounded size run as grouped
    tasks; a larger scope is worked through in table rounds, one absorption each.
    """
    groups, uses = materialize(groups), materialize(uses)
    sizes = groups.select("scope_id").unionAll(uses.select("scope_id")).groupBy("scope_id").agg(F.count("*").alias("rows"))
    sizes = materialize(sizes.withColumn("large", F.col("rows") > task_rows))
    small, large = sizes.where("NOT large").select("scope_id"), sizes.where("large").select("scope_id")

    def job(key, g: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        into, notes = _absorb(g, u, max_members, max_size)
        rows = []
        for x in into:
            t = into[x]
            while t in into:
                t = into[t]
            rows.append((x, t, None))
        rows += [(x, None, why) for x, why in notes]
        return pd.DataFrame(rows, columns=["grp", "target", "reason"])

    out = materialize(groups.join(dealt(small), "scope_id", "left_semi").groupBy("scope_id").cogroup(
        uses.join(dealt(small), "scope_id", "left_semi").groupBy("scope_id")).applyInPandas(job, "grp long, target long, reason string"))
    merged, notes = out.where("target IS NOT NULL").select("grp", "target"), out.where("reason IS NOT NULL").select("grp", "reason")
    if large.take(1):
        m, n = _absorb_rounds(groups.join(dealt(large), "scope_id", "left_semi"), uses.join(dealt(large), "scope_id", "left_semi"), max_members, max_size)
        merged, notes = merged.unionAll(m), notes.unionAll(n)
    return merged, notes


def _absorb_rounds(groups: DataFrame, uses: DataFrame, max_members: int, max_size: int) -> tuple[DataFrame, DataFrame]:
    groups, uses = materialize(groups), materialize(uses)
    merged, notes = None, None
    while True:
        single = uses.groupBy(F.col("provider").alias("grp")).agg(F.count("*").alias("users"), F.min("consumer").alias("target"))
        judged = groups.join(dealt(single), "grp", "left").join(
            dealt(groups.select(F.col("grp").alias("target"), F.col("members").alias("tm"), F.col("size").alias("ts"))), "target", "left").select(
            "scope_id", "grp", "rank", "members", "size", "protected", "target",
            F.when(F.col("protected"), "protected").when(F.col("users").isNull(), "unused").when(F.col("users") > 1, "shared")
            .when((F.col("members") + F.col("tm") > max_members) | (F.col("size") + F.col("ts") > max_size), "capacity").alias("reason"))
        judged = materialize(judged)
        first = materialize(judged.where("reason IS NULL").groupBy("scope_id").agg(F.min(F.struct("rank", "grp", "target", "members", "size")).alias("m")))
        passed = materialize(judged.join(dealt(first), "scope_id", "left").where(
            "reason IS NOT NULL AND (m IS NULL OR rank < m.rank)").select("grp", "reason"))
        notes = passed if notes is None else materialize(notes.unionAll(passed).distinct())
        if not first.take(1):
            gone = merged if merged is not None else groups.select("grp", F.col("grp").alias("target")).limit(0)
            return gone, notes.distinct()
        step = first.select(F.col("m.grp").alias("grp"), F.col("m.target").alias("target"))
        if merged is None:
            merged = materialize(step)
        else:
            moved = merged.join(dealt(step.select(F.col("grp").alias("target"), F.col("target").alias("later"))), "target", "left").select(
                "grp", F.coalesce("later", "target").alias("target"))
            merged = materialize(moved.unionAll(step))
        grown = first.select(F.col("m.target").alias("grp"), F.col("m.members").alias("am"), F.col("m.size").alias("asz"))
        groups = materialize(groups.join(dealt(step.select("grp")), "grp", "left_anti").join(dealt(grown), "grp", "left").select(
            "scope_id", "grp", "rank", (F.col("members") + F.coalesce("am", F.lit(0))).alias("members"),
            (F.col("size") + F.coalesce("asz", F.lit(0))).alias("size"), "protected"))
        to = lambda end: step.select(F.col("grp").alias(end), F.col("target").alias(f"{end}_to"))
        uses = materialize(uses.join(dealt(to("provider")), "provider", "left").join(dealt(to("consumer")), "consumer", "left").select(
            "scope_id", F.coalesce("provider_to", "provider").alias("provider"), F.coalesce("consumer_to", "consumer").alias("consumer")).where(
            "provider <> consumer").distinct())
