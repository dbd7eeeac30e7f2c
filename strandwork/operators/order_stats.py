"""Running totals, positions and exact quantiles for groups of any size.

A plain window sends a whole group to one task.  Here rows are range-partitioned
on (keys, order), so a group that holds a third of the data is spread over many
slabs; each slab is summed on its own and shifted by the totals of the slabs
before it (at most one row per slab and group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwork.session import dealt, materialize


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
            sums: dict[str, Column], fold: str | dict[str, str] = "sum") -> DataFrame:
    """Add inclusive running totals (or running maxima) inside ``keys`` along ``order``.

    ``order`` must be a total order inside each group for the result to be
    repeatable.  ``fold`` may name the fold of each figure, so that totals and maxima
    along one order share the work.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    key_cols = [F.col(k) for k in keys]
    folds = fold if isinstance(fold, dict) else dict.fromkeys(sums, fold)
    agg = lambda n, c: F.sum(c) if folds[n] == "sum" else F.max(c)
    zero = lambda n: F.lit(0) if folds[n] == "sum" else F.lit(None)
    staged = df.select("*", *[c.alias(f"__v_{n}") for n, c in sums.items()])
    staged = materialize(
        staged.repartitionByRange(*key_cols, *order).withColumn("__slab", F.spark_partition_id())
    )
    inner = Window.partitionBy(*key_cols, "__slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*[F.col(f"__k_{k}") for k in keys] or [F.lit(1)]).orderBy("__s").rowsBetween(
        Window.unboundedPreceding, -1)
    totals = (
        staged.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slab").alias("__s"))
        .agg(*[agg(n, f"__v_{n}").alias(f"__t_{n}") for n in sums])
        .select(*[f"__k_{k}" for k in keys], "__s",
                *[F.coalesce(agg(n, f"__t_{n}").over(outer), zero(n)).alias(f"__o_{n}") for n in sums])
    )
    match = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__slab") == F.col("__s")]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    local = staged.select("*", *[agg(n, f"__v_{n}").over(inner).alias(f"__l_{n}") for n in sums])
    both = lambda n: F.col(f"__l_{n}") + F.col(f"__o_{n}") if folds[n] == "sum" else F.greatest(f"__l_{n}", f"__o_{n}")
    return local.join(dealt(totals), cond).select(*df.columns, *[both(n).alias(n) for n in sums])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
              name: str = "pos", start: int = 0) -> DataFrame:
    """Add the position of every row inside its group."""
    out = running(df, keys, order, {name: F.lit(1).cast("long")})
    return out.withColumn(name, F.col(name) - 1 + start)


def adjacent_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                   member: str) -> DataFrame:
    """Every two neighbours of each ordered sequence: (keys, pos, before, after)."""
    placed = materialize(positions(df.select(*keys, *_needed(df, keys, order, member)), keys, order, "pos"))
    left = placed.select(*keys, "pos", F.col(member).alias("before"))
    right = placed.select(*keys, (F.col("pos") - 1).alias("pos"), F.col(member).alias("after"))
    return left.join(dealt(right), [*keys, "pos"])


def _needed(df: DataFrame, keys, order, member) -> list[str]:
    names = [o for o in order if isinstance(o, str)]
    if len(names) < len(order):
        return [c for c in df.columns if c not in keys]
    return list(dict.fromkeys(c for c in (*names, member) if c not in keys))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float],
              weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group, exact for groups of any size."""
    if not keys:
        return quantiles(df.withColumn("__all", F.lit(1)), ["__all"], value, points, weight).drop("__all")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.sum(weight) if weight else F.count("*")).cast("long").alias("n"))
    run = materialize(running(counted, keys, [value], {"upto": F.col("n")}))
    total = run.groupBy(*keys).agg(F.max("upto").alias("total"))
    spots = total.select(*keys, *[((F.col("total") - 1) * F.lit(q)).alias(f"__h_{n}") for n, q in points.items()])
    joined = run.join(dealt(spots), list(keys))
    picks = []
    for n in points:
        for edge, at in (("lo", F.floor(f"__h_{n}")), ("hi", F.ceil(f"__h_{n}"))):
            inside = (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
            picks.append(F.max(F.when(inside, F.col(value))).cast("double").alias(f"__{edge}_{n}"))
        picks.append(F.max(F.col(f"__h_{n}") - F.floor(f"__h_{n}")).alias(f"__f_{n}"))
    return joined.groupBy(*keys).agg(*picks).select(
        *keys, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}")).alias(n)
                 for n in points])


def weighted_quantile(df: DataFrame, keys: Sequence[str], value: str, weight: str,
                      points: dict[str, float]) -> DataFrame:
    """The first value whose cumulative weight reaches max(1, ceil(total * q))."""
    counted = df.groupBy(*keys, value).agg(F.sum(weight).cast("long").alias("w"))
    run = materialize(running(counted, keys, [value], {"upto": F.col("w")}))
    total = run.groupBy(*keys).agg(F.max("upto").alias("total"))
    return run.join(dealt(total), list(keys)).groupBy(*keys).agg(*[
        F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(q))), F.col(value))).alias(n)
        for n, q in points.items()])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks in which equal values share the mean of the places they fill."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    run = running(counted, keys, [value], {"__upto": F.col("__n")})
    ranks = run.select(*keys, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(dealt(ranks), [*keys, value])
