"""Readers for published site data: CSR graphs and callback shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def csr_edges(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, node, target) from ``window.NAME={off:[...],dst:[...]};``."""
    form = rf"window\.{name}=\{{off:\[([0-9,]*)\],dst:\[([0-9,]*)\]\}};?\s*"
    nums = lambda i: F.transform(F.filter(F.split(F.regexp_extract(text, form, i), ","), lambda x: x != ""), lambda x: x.cast("long"))
    arrays = df.where(F.col(text).rlike(f"^{form}$")).select(key, nums(1).alias("off"), nums(2).alias("dst"))
    return arrays.select(key, "dst", F.posexplode(F.arrays_zip(
        F.slice("off", F.lit(1), F.size("off") - 1).alias("a"), F.slice("off", F.lit(2), F.size("off") - 1).alias("b"))).alias("node", "span")).select(
        key, "node", F.explode(F.slice("dst", (F.col("span.a") + 1).cast("int"), (F.col("span.b") - F.col("span.a")).cast("int"))).alias("target"))


def csr_violations(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, code): malformed text, offsets that fall, a last offset that misses the targets, targets out of bounds."""
    form = rf"window\.{name}=\{{off:\[([0-9,]*)\],dst:\[([0-9,]*)\]\}};?\s*"
    nums = lambda i: F.transform(F.filter(F.split(F.regexp_extract(text, form, i), ","), lambda x: x != ""), lambda x: x.cast("long"))
    rows = df.select(key, F.col(text).rlike(f"^{form}$").alias("ok"), nums(1).alias("off"), nums(2).alias("dst"))
    n = F.size("off")
    falls = F.exists(F.arrays_zip(F.slice("off", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("off", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b")), lambda p: p["b"] < p["a"])
    codes = F.array(F.when(~F.col("ok"), "malformed"), F.when(F.col("ok") & falls, "falling_offsets"),
                    F.when(F.col("ok") & (F.coalesce(F.element_at("off", -1), F.lit(0)) != F.size("dst")), "length_mismatch"),
                    F.when(F.col("ok") & F.exists("dst", lambda t: t < 0), "target_out_of_bounds"))
    return rows.select(key, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def shard_records(df: DataFrame, text: str, callback: str) -> DataFrame:
    """(shard, name, record) from ``CALLBACK("007",{...});``."""
    form = rf'(?s)^{callback}\("([0-9]{{3}})",(\{{.*\}})\);?\s*$'
    return df.where(F.col(text).rlike(form)).select(
        F.regexp_extract(text, form, 1).cast("int").alias("shard"),
        F.explode(F.from_json(F.regexp_extract(text, form, 2), "map<string,string>")).alias("name", "record"))
