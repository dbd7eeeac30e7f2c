"""Nested JSON values as flat (path, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwork.session import materialize


def flatten(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per leaf with its dotted path; each round opens one more level of what is still nested."""
    spark = df.sparkSession
    todo, done = df.select(key, F.lit("").alias("path"), F.col(value).alias("v")), None
    while True:
        opened = spark.sql(
            f"SELECT t.{key}, concat_ws('.', nullif(t.path, ''), coalesce(e.key, cast(e.pos AS string))) AS path, e.value AS v "
            "FROM {t} t, LATERAL variant_explode(t.v) e", t=todo)
        shape = F.schema_of_variant("v")
        nested = shape.startswith("OBJECT<") | (shape.startswith("ARRAY<") & (shape != "ARRAY<VOID>"))
        level = materialize(opened.select(key, "path", F.to_json("v").alias("text"), nested.alias("nested"), F.variant_get("v", "$", "string").alias("leaf")))
        leaves = level.where("NOT nested").select(key, "path", F.col("leaf").alias("value"))
        done = leaves if done is None else done.unionAll(leaves)
        rest = level.where("nested")
        if not rest.take(1):
            return done
        todo = rest.select(key, "path", F.parse_json("text").alias("v"))
