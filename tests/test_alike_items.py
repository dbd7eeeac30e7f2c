"""Tokens of documents that are alike are resolved once."""

import pytest
from pyspark.sql import functions as F

from strandwork.operators import merge as M, names as N
from strandwork.plans import load_all
from strandwork.plans.registry import QUERIES


@pytest.mark.parametrize("counts, edges, module, asked", [
    ("d16_resolution_counts", "d16_text_references", M, "resolve_tokens"), ("d16_scoped_outcomes", "d16_scoped_references", N, "resolve")])
def test_tokens_of_alike_documents_are_asked_for_once(spark, tmp_path, monkeypatch, counts, edges, module, asked):
    load_all()
    d = str(tmp_path)
    texts = ["oak elm ash fir bay", "yew oak elm ivy box", "ash fir Bay yew oak"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = [(i, f"{texts[i % 3]} w{'abc'[i % 3]} oak") for i in range(120)] + [(120, None), (121, "1 2"), (7, "ivy"), (None, "oak elm")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    seen = []

    def ask(tokens, *rest, real=getattr(module, asked)):
        seen.append(tokens.count())
        return real(tokens, *rest)

    monkeypatch.setattr(module, asked, ask)
    rows = {r["item"]: r.asDict() for r in QUERIES[counts](spark, d).collect()}
    met = QUERIES[edges](spark, d).groupBy("item").agg(F.count("*").alias("n"), F.countDistinct("token").alias("k")).collect()
    # 15 kinds of a module and a remainder (6 of a module and a parity), with at most nine words, in three tiers.
    assert len(seen) == 1 and seen[0] <= (15 * 3 * 9 + 6 if module is M else 6 * 9 + 2)
    assert set(rows) == {*range(120), None} and {r["item"]: r["n"] for r in met} == {i: r["edges"] for i, r in rows.items() if r["edges"]}
    assert all(r["n"] == r["k"] for r in met)
    words = {i: len({w for j, t in docs if j == i for w in t.split()}) for i in rows}
    assert {i: r["edges"] + r["ambiguous"] + r["unresolved"] for i, r in rows.items()} == words
    # Documents 30 apart are alike and have the same text.
    assert all({**rows[i], "item": 0} == {**rows[i + 30], "item": 0} for i in range(8, 90))
    assert rows[None]["unresolved"] == 2
