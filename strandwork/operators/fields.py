"""Merging what several sources say about the fields of a declaration.

``contributions(ref, field, authority, backend, method, state, value)`` has a row for each field a
source speaks about; what has several members stands beside it, one row a member:
``members(ref, field, authority, backend, method, item)`` of union fields, and
``deps(ref, field, authority, provider, evidence_kind, provider_module, source)`` of dependency
fields.  A present row without members is a confirmed empty list.  Everything is folded by
(ref, field), so a field with any number of sources is small before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwork.operators.merge import authority_rank

# Fields that hold dependencies, and those whose members are united.
DEPENDENCIES = ("statement.deps", "proof.deps")
UNIONS = ("source_refs", "diagnostics", "attributes")
_KEY = ["ref", "field"]


def _spoken(contributions: DataFrame) -> DataFrame:
    """Present scalar values with their rank; a missing text counts only if no source has one."""
    rows = contributions.where((F.col("state") == "present") & ~F.col("field").isin(*DEPENDENCIES, *UNIONS)).withColumn("rank", authority_rank())
    told = rows.groupBy(*_KEY).agg(F.count("value").alias("told"))
    return rows.join(told, _KEY).where("value IS NOT NULL OR told = 0").drop("told")


def scalars(contributions: DataFrame) -> DataFrame:
    """(ref, field, value, backend): of the highest authority the first by backend, method and value."""
    first = F.struct((-F.col("rank")).alias("rank"), "backend", "method", "value")
    return _spoken(contributions).groupBy(*_KEY).agg(F.min(first).alias("b")).select(*_KEY, "b.value", "b.backend")


def conflicts(contributions: DataFrame) -> DataFrame:
    """(ref, field, reason, selected, alternative): sources of equal authority that differ, and fields both present and not applicable."""
    spoken = _spoken(contributions)
    best = spoken.groupBy(*_KEY).agg(F.max("rank").alias("rank"))
    won = scalars(contributions).select(*_KEY, F.col("value").alias("selected"))
    equal = spoken.join(best, [*_KEY, "rank"]).join(won, _KEY).where(~F.col("value").eqNullSafe(F.col("selected"))).select(
        *_KEY, F.lit("equal_authority").alias("reason"), "selected", F.concat_ws(":", "backend", "value").alias("alternative")).distinct()
    states = contributions.groupBy(*_KEY).agg(F.bool_or(F.col("state") == "present").alias("present"), F.bool_or(F.col("state") == "not_applicable").alias("none"))
    nothing = F.lit(None).cast("string")
    return equal.unionAll(states.where("present AND none").select(
        *_KEY, F.lit("present_vs_not_applicable"), nothing.alias("selected"), nothing.alias("alternative")))


def unions(contributions: DataFrame, members: DataFrame) -> DataFrame:
    """(ref, field, items): the different members of all sources, sorted; empty where sources name none."""
    fields = contributions.where((F.col("state") == "present") & F.col("field").isin(*UNIONS)).select(*_KEY).distinct()
    items = members.select(*_KEY, "item").distinct().groupBy(*_KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))
    return fields.join(items, _KEY, "left").select(*_KEY, F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def exact_authorities(contributions: DataFrame, complete: DataFrame) -> DataFrame:
    """(ref, field, authority) of dependency contributions that are complete where ``complete(ref, part, domain)`` says so.

    A catalog is exact where it is declared complete for the part; the compiler is exact if all domains of the
    part are: types and, where nothing is said about a proof, values of a statement; values of a proof.
    """
    said = complete.groupBy("ref", "part").agg(*[F.bool_or(F.col("domain") == d).alias(d) for d in ("lc_declared", "lean_type", "lean_value")])
    proof = contributions.where(F.col("field").startswith("proof.")).select("ref", F.lit(True).alias("has_proof")).distinct()
    rows = contributions.where((F.col("state") == "present") & F.col("field").isin(*DEPENDENCIES)).select(*_KEY, "authority").distinct()
    rows = rows.withColumn("part", F.substring_index("field", ".", 1)).join(said, ["ref", "part"]).join(proof, "ref", "left")
    compiled = F.when(F.col("part") == "statement", F.col("lean_type") & (F.col("lean_value") | F.coalesce("has_proof", F.lit(False)))).otherwise(F.col("lean_value"))
    return rows.where(((F.col("authority") == "lc_catalog") & F.col("lc_declared")) | ((F.col("authority") == "lean_environment") & compiled)).select(*_KEY, "authority")


def dependencies(contributions: DataFrame, deps: DataFrame, complete: DataFrame) -> DataFrame:
    """(ref, field, provider, evidence_kind, provider_module, sources): exact sources replace approximate ones, also if they name nothing.

    The same provider, kind and module from several sources is one dependency with all of them.
    """
    exact = exact_authorities(contributions, complete)
    settled = exact.select(*_KEY).distinct()
    spoken = contributions.where((F.col("state") == "present") & F.col("field").isin(*DEPENDENCIES)).select(*_KEY, "authority").distinct()
    own = deps.join(spoken, [*_KEY, "authority"], "left_semi")
    kept = own.join(exact, [*_KEY, "authority"], "left_semi").unionAll(own.join(settled, _KEY, "left_anti"))
    return kept.groupBy(*_KEY, "provider", "evidence_kind", "provider_module").agg(F.array_sort(F.collect_set("source")).alias("sources"))
