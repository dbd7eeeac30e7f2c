"""The registered queries of the operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from strandwork.llm import bpe, decontamination, divergence, filter_audit, language_id, near_dedup, nearest, packing, secrets, sharding, token_counts, toxicity, url_filters
from strandwork.llm.texts import held_out, learns, table

#: Where public vocabularies lie; every executor has them at the same path.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

# The rules of the URL filter.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def bpe_codec(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE)


def languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    network = language_id.learn(docs, learns(F.col("doc_id"), 3, 1))
    return language_id.predict(docs, network).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def benchmark_leaks(spark, sf_dir):
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def nearest_vectors(spark, sf_dir):
    return nearest.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


#: Three words a shingle, linked at a Jaccard similarity of 0.85.
NEAR = near_dedup.Rule(size=3, percent=85)


def near_groups(spark, sf_dir):
    groups = near_dedup.components(table(spark, sf_dir, "documents"), NEAR)
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                         F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def piece_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECE_BPE)


def shuffled_shards(spark, sf_dir):
    text = F.coalesce("record.text", F.lit(""))
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def toxic_from(doc_id):
    """Whether the label of this id may be learned from."""
    return learns(doc_id, 4, 2)


def toxic_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), toxic_from)
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def url_verdicts(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def filter_orders(spark, sf_dir):
    return filter_audit.audit(filter_audit.decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def packed_windows(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_BPE)


def source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe_codec": bpe_codec,
    "op2_languages": languages,
    "op3_secret_scan": secret_scan,
    "op4_benchmark_leaks": benchmark_leaks,
    "op5_nearest_vectors": nearest_vectors,
    "op6_near_groups": near_groups,
    "op7_piece_counts": piece_counts,
    "op8_shuffled_shards": shuffled_shards,
    "op9_toxic_scores": toxic_scores,
    "op10_url_verdicts": url_verdicts,
    "op11_filter_orders": filter_orders,
    "op12_packed_windows": packed_windows,
    "op13_source_divergence": source_divergence,
}
