"""Edges, boundaries and quotient graphs over (provider, consumer) tables.

Node ids may be of any orderable type, a struct of repository and local id
included.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

# The evidence kinds that count as mathematical dependencies.
EVIDENCE_KINDS = ("lc_declared", "lean_type", "lean_value", "text_reference", "published")


def select_evidence(occurrences: DataFrame, kinds: Iterable[str] = EVIDENCE_KINDS) -> DataFrame:
    kinds = list(kinds) if not isinstance(kinds, str) else None
    if kinds is None or any(not isinstance(k, str) or not k.strip() for k in kinds):
        raise ValueError("evidence kinds must be non-empty strings in an iterable")
    return occurrences.where(F.col("evidence_kind").isin(kinds))


def distinct_evidence(occurrences: DataFrame) -> DataFrame:
    """One row per pair, part, kind and provider module with its number of occurrences.

    Kept long: a pair may have any number of occurrences, so they are never
    collected into one value.
    """
    return occurrences.groupBy("provider", "consumer", "part", "evidence_kind", "provider_module").agg(
        F.sum("n").cast("long").alias("n"))


def edges(occurrences: DataFrame) -> DataFrame:
    """Distinct pairs with occurrence count, parts and kinds (both sets are small by definition)."""
    return occurrences.groupBy("provider", "consumer").agg(
        F.sum("n").cast("long").alias("occurrences"),
        F.array_sort(F.collect_set("part")).alias("parts"),
        F.array_sort(F.collect_set("evidence_kind")).alias("kinds"))


def pairs(occurrences: DataFrame) -> DataFrame:
    return occurrences.select("provider", "consumer").distinct()


def unloaded(edge: DataFrame, decls: DataFrame) -> DataFrame:
    """Providers named by an edge that have no declaration."""
    return edge.select(F.col("provider").alias("ref")).distinct().join(decls.select("ref"), "ref", "left_anti")


def boundary(edge: DataFrame, members: DataFrame) -> DataFrame:
    """Class of every edge that touches a group, for all groups at once.

    ``members(grp, ref)`` may overlap.  Both endpoint memberships are stacked and
    folded per (group, edge), so no group is ever collected.
    """
    sides = [
        edge.select("provider", "consumer").join(members.select("grp", F.col("ref").alias(end)), end).select(
            "grp", "provider", "consumer", F.lit(end == "provider").alias("p"), F.lit(end == "consumer").alias("c"))
        for end in ("provider", "consumer")]
    return sides[0].unionAll(sides[1]).groupBy("grp", "provider", "consumer").agg(
        F.bool_or("p").alias("p"), F.bool_or("c").alias("c")).select(
        "grp", "provider", "consumer",
        F.when(F.col("p") & F.col("c"), "internal").when(F.col("p"), "outgoing").otherwise("incoming").alias("side"))


def boundary_counts(classes: DataFrame) -> DataFrame:
    """Pair counts and distinct provider counts per group."""
    one = classes.groupBy("grp", "side", "provider").agg(F.count("*").alias("n"))
    n = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"{s}_pairs")
    p = lambda s: F.count_if(F.col("side") == s).alias(f"{s}_providers")
    return one.groupBy("grp").agg(*[n(s) for s in ("incoming", "outgoing", "internal")],
                                  *[p(s) for s in ("incoming", "outgoing")])


def boundary_declarations(classes: DataFrame, members: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Input and output declarations of every group; outcomes inside a group are outputs too."""
    used = classes.where("side <> 'internal'").select(
        "grp", F.when(F.col("side") == "incoming", "input").otherwise("output").alias("role"),
        F.col("provider").alias("ref"))
    own = members.join(outcomes.select("ref"), "ref", "left_semi").select("grp", F.lit("output").alias("role"), "ref")
    return used.unionAll(own).distinct()


def owned(edge: DataFrame, owner: DataFrame) -> DataFrame:
    """Edges with the owner of either end (inner: both ends covered)."""
    return edge.join(owner.select(F.col("ref").alias("provider"), F.col("grp").alias("from_grp")), "provider").join(
        owner.select(F.col("ref").alias("consumer"), F.col("grp").alias("to_grp")), "consumer")


def quotient(edge: DataFrame, owner: DataFrame) -> DataFrame:
    """Edges between groups with pair and distinct provider counts; each ref has one owner."""
    return owned(edge, owner).where("from_grp <> to_grp").groupBy("from_grp", "to_grp", "provider").agg(
        F.count("*").alias("n")).groupBy("from_grp", "to_grp").agg(
        F.sum("n").alias("pair_count"), F.count("*").alias("provider_count"))


def internal_edges(edge: DataFrame, owner: DataFrame) -> DataFrame:
    return owned(edge, owner).where("from_grp = to_grp").select(F.col("from_grp").alias("grp"), "provider", "consumer")


def overlapping(members: DataFrame) -> DataFrame:
    """Refs claimed by more than one group."""
    return members.select("grp", "ref").distinct().groupBy("ref").agg(F.count("*").alias("groups")).where("groups > 1")
