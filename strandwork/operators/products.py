"""Pairs of rows that share a key, where one key may have most rows of both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strandwork.session import dealt, materialize

#: Rows of a key that are worked on together, and partners of a key that are sent to them as one array.
BLOCK, PACK = 8192, 4096


def _sizes(df: DataFrame, key: Column, most: int) -> DataFrame:
    """(__k, __n): into how many parts of some ``most`` rows the rows of a key are cut."""
    return df.groupBy(key.alias("__k")).agg(F.ceil(F.count("*") / F.lit(most)).cast("long").alias("__n"))


def every_pair(rows: DataFrame, many: DataFrame, keys: Sequence[str], chunk: str | None = None) -> DataFrame:
    """Each row of ``rows`` beside each row of ``many`` with the same ``keys``: the columns of ``rows``, then the others of ``many``.

    A null key is a key like any other.  Rows go to their block of a key, its partners go to each of its blocks,
    packed into arrays, so that nothing is shuffled, sorted or kept for single pairs.  A key with more packs than
    blocks has several lanes, each with some of the packs, to which its few rows are sent.  ``many`` may tell the
    packs of a key in its column ``chunk`` (from 0).  ``rows`` is read twice and should be a written table.
    """
    # One struct as the key: it is equal to itself with nulls in it, and both sides are hashed by it as it stands.
    key = F.struct(*keys)
    rest = [c for c in many.columns if c not in (*keys, chunk)]
    packs = many.select(key.alias("__k"), F.struct(*rest).alias("__m"), *([F.col(chunk).alias("__c")] if chunk else []))
    if not chunk:
        packs = packs.join(_sizes(many, key, PACK), "__k").withColumn("__c", F.pmod(F.xxhash64("__m"), F.col("__n"))).drop("__n")
    packs = packs.groupBy("__k", "__c").agg(F.collect_list("__m").alias("__all"))
    # A single column is handed on as an array of plain values.
    alone = len(rest) == 1
    if alone:
        packs = packs.withColumn("__all", F.transform("__all", lambda x: x[rest[0]]))
    packs = materialize(packs)
    lanes = packs.groupBy("__k").agg((F.max("__c") + 1).alias("__packs")).join(_sizes(rows, key, BLOCK), "__k").select(
        "__k", "__n", F.ceil(F.col("__packs") / F.col("__n")).cast("long").alias("__lanes"))
    lanes = materialize(lanes)
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    cut = rows.withColumn("__k", key).join(lanes, "__k").withColumn("__b", F.pmod(F.xxhash64(*rows.columns), F.col("__n"))).withColumn(
        "__l", upto("__lanes")).drop("__n", "__lanes")
    sent = packs.join(lanes, "__k").select("__k", upto("__n").alias("__b"), F.pmod("__c", "__lanes").alias("__l"), "__all")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A fixed number of parts: what is still small here is large behind the join.
    wide = lambda df: dealt(df.repartition(parts, "__k", "__b", "__l"))
    met = wide(cut).join(wide(sent), ["__k", "__b", "__l"]).select(*rows.columns, F.explode("__all").alias("__m"))
    return met.select(*rows.columns, *([F.col("__m").alias(rest[0])] if alone else [F.col(f"__m.{c}").alias(c) for c in rest]))
