"""Agreement, correlation, inversion and cross-tab statistics over label and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strandwork.operators.order_stats import average_ranks, positions, quantiles, running
from strandwork.session import materialize, measured


def inversions(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Pairs in which the earlier row has the larger value, per group.

    Counted bit by bit from the top: rows that agree on the higher bits of the
    value form a block, and inside a block each row with a clear bit counts the
    set-bit rows before it.  No pair is ever formed.
    """
    rows, seen = measured(df.select(*keys, F.col(order).alias("__o"), F.col(value).cast("long").alias("__v")),
                          low=F.min("__v"), high=F.max("__v"))
    low = seen["low"] or 0
    # Counted from the least value on, so that negative values have no sign bit.
    rows = rows.withColumn("__v", F.col("__v") - F.lit(low))
    top = (seen["high"] or 0) - low
    total = None
    for bit in range(int(top).bit_length() - 1, -1, -1):
        high = F.shiftright("__v", bit + 1)
        one = F.shiftright("__v", bit).bitwiseAND(F.lit(1))
        run = running(rows.withColumn("__h", high), [*keys, "__h"], ["__o"], {"__ones": one})
        part = run.where(one == 0).groupBy(*keys).agg(F.sum("__ones").alias("n"))
        total = part if total is None else total.unionAll(part)
    if total is None:
        return rows.select(*keys).distinct().withColumn("inversions", F.lit(0).cast("long"))
    counted = total.groupBy(*keys).agg(F.sum("n").cast("long").alias("inversions"))
    return rows.select(*keys).distinct().join(counted, list(keys), "left").fillna(0, ["inversions"])


def agreement(pairs: DataFrame, first: str = "first", second: str = "second", keys: Sequence[str] = ()) -> DataFrame:
    """Observed and expected agreement and Cohen's kappa; kappa is null for certain or empty expectations."""
    says = ("no", "uncertain", "yes")
    a, b = F.col(first), F.col(second)
    counts = [F.count_if(c == s).alias(f"{n}_{s}") for n, c in (("a", a), ("b", b)) for s in says]
    base = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(a == b).alias("same"),
        F.count_if((a != "uncertain") & (b != "uncertain")).alias("definite"),
        F.count_if((a != "uncertain") & (a == b)).alias("definite_same"), *counts)
    return kappa_of(base, keys)


def kappa_of(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    says = ("no", "uncertain", "yes")
    n = F.col("n").cast("double")
    expected = sum(((F.col(f"a_{s}") / n) * (F.col(f"b_{s}") / n) for s in says), F.lit(0.0))
    observed = F.col("same") / n
    kappa = F.when((F.col("n") > 0) & (F.abs(expected - 1) > 1e-12), (observed - expected) / (1 - expected))
    return base.select(
        *keys, "n", F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(kappa, 6).alias("kappa"),
        F.when(F.col("definite") > 0, F.round(F.col("definite_same") / F.col("definite"), 6)).alias("definite_agreement"),
        F.round(F.col("a_uncertain") / n, 6).alias("uncertain_first"), F.round(F.col("b_uncertain") / n, 6).alias("uncertain_second"))


def grouped_agreement(pairs: DataFrame) -> DataFrame:
    """Agreement for all rows, per stratum, per project and per project and stratum, in one pass."""
    says = ("no", "uncertain", "yes")
    a, b = F.col("first"), F.col("second")
    counts = [F.count_if(c == s).alias(f"{n}_{s}") for n, c in (("a", a), ("b", b)) for s in says]
    base = pairs.groupingSets([[], [F.col("stratum")], [F.col("project")], [F.col("project"), F.col("stratum")]], F.col("project"), F.col("stratum")).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(a == b).alias("same"),
        F.count_if((a != "uncertain") & (b != "uncertain")).alias("definite"),
        F.count_if((a != "uncertain") & (a == b)).alias("definite_same"), *counts)
    return kappa_of(base, ["project", "stratum", "level"])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """Correlation of average ranks per group; null where one side is constant."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(materialize(average_ranks(rows, keys, x, "__rx")), keys, y, "__ry")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("__rx", "__ry").alias(name))


def quartile_table(df: DataFrame, keys: Sequence[str], value: str, label: str, cuts_from: DataFrame | None = None) -> DataFrame:
    """Rows per quartile bucket and label; the cuts may come from another sample of the same groups."""
    cuts = quantiles(df if cuts_from is None else cuts_from, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    v = F.col(value)
    bucket = (1 + (v > F.col("q1")).cast("int") + (v > F.col("q2")).cast("int") + (v > F.col("q3")).cast("int")).alias("quartile")
    return df.where(v.isNotNull()).join(cuts, list(keys)).select(*keys, bucket, label).groupBy(*keys, "quartile").pivot(
        label, ["no", "uncertain", "yes"]).agg(F.count(F.lit(1))).fillna(0, ["no", "uncertain", "yes"])


def stratified_sample(df: DataFrame, key: str, node: str, size: str, seed: str, per_group: int) -> DataFrame:
    """Named extremes of every group plus its first rows in seeded hash order."""
    lowest, highest = F.min(F.struct(size, node)), F.max(F.struct(F.col(size), (-F.col(node)).alias("neg")))
    ends = df.groupBy(key).agg(lowest.alias("a"), highest.alias("b"))
    named = ends.select(key, F.col(f"a.{node}").alias(node), F.lit("shortest").alias("stratum")).unionAll(
        ends.select(key, (-F.col("b.neg")).alias(node), F.lit("longest")))
    rest = df.join(named.select(node), node, "left_anti").select(
        key, node, F.sha2(F.concat_ws(":", F.lit(seed), F.col(node).cast("string")), 256).alias("h"))
    from pyspark.sql import Window

    # The row limit is applied before the shuffle as well, so a large group ships only its candidates.
    drawn = rest.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("h", node))).where(F.col("rn") <= per_group)
    return named.unionAll(drawn.select(key, node, F.lit("random")))


def even_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], largest: int) -> DataFrame:
    """Split each ordered group into the fewest batches of at most ``largest``, sizes differing by one at most."""
    placed = materialize(positions(df, keys, order, "pos"))
    size = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    met = placed.join(size, list(keys)).withColumn("batches", F.ceil(F.col("n") / F.lit(largest)))
    base, extra = F.floor(F.col("n") / F.col("batches")), F.col("n") % F.col("batches")
    edge = extra * (base + 1)
    batch = F.when(F.col("pos") < edge, F.floor(F.col("pos") / (base + 1))).otherwise(extra + F.floor((F.col("pos") - edge) / base))
    return met.withColumn("batch", batch.cast("long")).drop("n", "batches")
