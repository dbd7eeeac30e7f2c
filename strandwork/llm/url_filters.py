"""URL filters by host suffix and path prefix, joined on short hash prefixes; DataFrame functions only.

A URL is expanded into expressions ``host suffix + path prefix``, but only with the
label counts and path lengths that occur among the rules, so a host of a thousand
labels or a path of a megabyte stays a handful of expressions.  The expressions meet
the rules by equi-join on the first ``PREFIX`` hexadecimal digits of their SHA-256;
a match counts only if the full digests agree.  Among the rules that fit, the longest
wins, and ``block`` wins over ``allow`` between equal rules.

Neither side is hinted: Spark broadcasts the rules if their size permits, and
otherwise splits skewed expressions itself.  All rows of a page are made in one
task, so the aggregation that picks the rule shrinks them before its shuffle.

Cases: a null URL, or one without ``://``, has an empty host and path and no rule; a
host without path has the empty path, which no rule path but the empty one begins;
repeated pages are judged one by one; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a page gets that no rule fits.
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules ``(host, path, verdict)`` with the text and the digests that URLs are matched by; incomplete ones go."""
    text = F.concat(F.translate("host", UPPER, LOWER), "path")
    digest = F.sha2(F.concat(F.translate("host", UPPER, LOWER), F.lit("\n"), "path").cast("binary"), 256)
    return rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        text.alias("rule"), F.length(text).alias("rule_length"), F.col("verdict").alias("rule_verdict"),
        F.substring(digest, 1, PREFIX).alias("rule_prefix"), digest.alias("rule_digest"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """One row per page: (key, host, path, rule, verdict)."""
    shape = rules.where("host IS NOT NULL AND path IS NOT NULL").agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    numbers = {k: f"CAST(array({', '.join(map(str, sorted(shape[k])))}) AS array<int>)" for k in ("labels", "lengths")}
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")).withColumn(
        "row", F.monotonically_increasing_id())
    expressions = F.expr(f"""
        flatten(transform(filter({numbers["labels"]}, n -> n <= size(split(host, '[.]'))), n ->
            transform(filter({numbers["lengths"]}, m -> m <= length(path)), m ->
                concat(substring_index(host, '.', -n), '\n', substring(path, 1, m)))))""")
    looked = parts.withColumn("expression", F.explode_outer(expressions)).withColumn(
        "digest", F.sha2(F.col("expression").cast("binary"), 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))
    met = looked.join(rule_table(rules), F.col("prefix") == F.col("rule_prefix"), "left")
    fits = F.when(F.col("digest") == F.col("rule_digest"), F.struct(
        F.col("rule_length").alias("n"), (F.col("rule_verdict") == "block").alias("block"), F.col("rule").alias("rule"),
        F.col("rule_verdict").alias("verdict")))
    return met.groupBy("row").agg(F.first("key").alias("key"), F.first("host").alias("host"), F.first("path").alias("path"),
                                  F.max(fits).alias("best")).select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
