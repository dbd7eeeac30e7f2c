"""Violation reports: rules are columns, reports are long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def row_rules(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(keys, rule) for every rule whose condition names a violation."""
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def missing_refs(df: DataFrame, column: str, known: DataFrame, rule: str) -> DataFrame:
    """(ref, rule, n): values of ``column`` that the first column of ``known`` lacks."""
    used = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("ref")).agg(F.count("*").alias("n"))
    return used.join(known.select(F.col(known.columns[0]).cast("string").alias("ref")), "ref", "left_anti").select("ref", F.lit(rule).alias("rule"), "n")


def set_difference(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side) of rows on one side only, in one pass over both."""
    both = expected.select(*keys, F.lit(1).alias("__e"), F.lit(0).alias("__a")).unionAll(actual.select(*keys, F.lit(0), F.lit(1)))
    return both.groupBy(*keys).agg(F.max("__e").alias("__e"), F.max("__a").alias("__a")).where("__e <> __a").select(
        *keys, F.when(F.col("__e") == 1, "missing").otherwise("unexpected").alias("side"))


def chunk_report(chunks: DataFrame, key: str, index: str, count: str, meta: Sequence[str]) -> DataFrame:
    """Files whose chunks are incomplete, repeated or disagree."""
    seen = chunks.groupBy(key, index).agg(F.count("*").alias("copies"), F.min(count).alias("c0"), F.max(count).alias("c1"),
                                          *[f(m).alias(f"{n}_{m}") for m in meta for n, f in (("lo", F.min), ("hi", F.max))])
    agree = F.lit(True)
    for m in meta:
        agree = agree & (F.min(f"lo_{m}") == F.max(f"hi_{m}"))
    return seen.groupBy(key).agg(
        (F.count("*") != F.max("c1")).alias("incomplete"), (F.max("copies") > 1).alias("repeated"),
        ((F.min("c0") != F.max("c1")) | ~agree).alias("disagrees"), (F.min(index) != 0).alias("no_first"))
