"""Measurements with explicit coverage: missing is not zero, and not applicable is neither."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def text_observation(text: str, status: str) -> Column:
    """Code points of a text: null when missing, 0 when not applicable."""
    return F.when(F.col(status) == "not_applicable", F.lit(0)).otherwise(F.length(text)).cast("double")


def unpivot(df: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """One row per entity and metric."""
    wide = df.select(*keys, *[c.cast("double").alias(n) for n, c in metrics.items()])
    return wide.unpivot(keys, list(metrics), "metric", "value")


def aggregate(observations: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Sum that is null when any member is null, next to the observed sum, counts, coverage and bounds.

    A group of no rows cannot appear here; ``empty_as_covered`` adds it with coverage 1.
    """
    v = F.col(value)
    seen, total = F.count(v), F.count("*")
    return observations.groupBy(*keys).agg(
        F.when(seen == total, F.sum(v)).alias("value"), F.coalesce(F.sum(v), F.lit(0.0)).alias("observed_sum"),
        F.when(seen == total, "present").when(seen > 0, "partial").otherwise("missing").alias("status"),
        seen.alias("observed_count"), total.alias("total_count"), F.round(seen / total, 6).alias("coverage"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"))


def empty_as_covered(groups: DataFrame, aggregated: DataFrame, keys: list[str]) -> DataFrame:
    """Give groups without any member a complete, empty observation: sum 0, coverage 1."""
    out = groups.join(aggregated, keys, "left")
    none = F.col("total_count").isNull()
    fill = {"value": F.lit(0.0), "observed_sum": F.lit(0.0), "status": F.lit("present"), "observed_count": F.lit(0),
            "total_count": F.lit(0), "coverage": F.lit(1.0)}
    return out.select(*keys, *[F.when(none, fill[c]).otherwise(F.col(c)).alias(c) if c in fill else F.col(c)
                               for c in aggregated.columns if c not in keys])


def parted_edges(edge: DataFrame, ref_paths: DataFrame) -> DataFrame:
    """Edges with both root paths and ``k``, the number of ancestors the two ends share."""
    return edge.select("provider", "consumer").join(
        ref_paths.select(F.col("ref").alias("provider"), F.col("path").alias("pp")), "provider").join(
        ref_paths.select(F.col("ref").alias("consumer"), F.col("path").alias("cp")), "consumer").withColumn(
        "k", F.size(F.array_intersect("pp", "cp")))


def node_interface_counts(parted: DataFrame) -> DataFrame:
    """Internal, incoming, outgoing and cross-child pair counts of every tree node.

    An edge is internal to the ancestors both ends share, leaves those only its
    provider has, enters those only its consumer has, and crosses children only
    at the last shared one.
    """
    rest = lambda p: F.slice(F.col(p), F.col("k") + 1, F.size(p))
    tag = lambda arr, s: F.transform(arr, lambda n: F.struct(n.alias("node"), F.lit(s).alias("side")))
    cross = F.when((F.col("k") > 0) & (F.col("k") < F.size("pp")) & (F.col("k") < F.size("cp")),
                   F.array(F.element_at("pp", F.greatest("k", F.lit(1))))).otherwise(F.array().cast("array<string>"))
    marks = F.concat(tag(F.slice("pp", F.lit(1), F.col("k")), "internal"), tag(rest("pp"), "outgoing"),
                     tag(rest("cp"), "incoming"), tag(cross, "cross_child"))
    rows = parted.select(F.explode(marks).alias("m")).select("m.node", "m.side")
    return rows.groupBy("node").agg(*[F.count_if(F.col("side") == s).alias(f"{s}_pairs")
                                      for s in ("internal", "incoming", "outgoing", "cross_child")])


def node_interfaces(parted: DataFrame, ref_paths: DataFrame, outcomes: DataFrame, public: DataFrame) -> DataFrame:
    """(node, ref) of every node's interface.

    Inputs, outputs, contained outcomes and both ends of child-crossing edges; a
    node with none of these shows its public members, else the members that
    nothing inside consumes, else all of them.
    """
    rest = lambda p: F.slice(F.col(p), F.col("k") + 1, F.size(p))
    split = (F.col("k") > 0) & (F.col("k") < F.size("pp")) & (F.col("k") < F.size("cp"))
    at = F.element_at("pp", F.greatest("k", F.lit(1)))
    used = parted.select(F.explode(F.array_union(rest("cp"), rest("pp"))).alias("node"), F.col("provider").alias("ref"))
    crossing = parted.where(split).select(at.alias("node"), F.explode(F.array("provider", "consumer")).alias("ref"))
    members = ref_paths.select("ref", F.explode("path").alias("node"))
    shown = members.join(outcomes.select("ref"), "ref", "left_semi").select("node", "ref")
    main = used.unionAll(crossing).unionAll(shown).distinct()
    bare = members.join(main.select("node").distinct(), "node", "left_anti")
    consumed = parted.select(F.explode(F.slice("pp", F.lit(1), F.col("k"))).alias("node"), F.col("provider").alias("ref")).distinct()
    ranked = bare.join(public.select("ref", F.lit(1).alias("pub")), "ref", "left").join(
        consumed.withColumn("eaten", F.lit(1)), ["node", "ref"], "left").withColumn(
        "tier", F.when(F.col("pub") == 1, 1).when(F.col("eaten").isNull(), 2).otherwise(3))
    best = ranked.groupBy("node").agg(F.min("tier").alias("tier"))
    return main.unionAll(ranked.join(best, ["node", "tier"]).select("node", "ref"))
