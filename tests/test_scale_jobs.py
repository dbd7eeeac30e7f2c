"""Sizes instead of lists, streams of short files, and neighbouring lines dealt by blocks."""

import random

import pytest
from pyspark.sql import functions as F

from strandwork.operators import iterate as I, scopes as S, tree as T
from strandwork.sources import derived as D


def test_neighbourhood_sizes_are_those_of_the_lists(spark):
    r = random.Random(3)
    rows = [(0, None, 0)] + [(n, r.randrange(n), r.randrange(6)) for n in range(1, 60)]
    rows += rows[7:12]
    for more in ([], [(59, 0, 9)]):
        nodes = spark.createDataFrame(rows + more, "node long, parent long, child_pos long")
        closure = I.ancestors(nodes.select("node", "parent"))
        jobs = nodes.select(F.col("node").alias("job"), "node")
        told = T.neighbourhood_sizes(nodes, closure, jobs).collect()
        wanted = T.neighbourhood(nodes, closure, jobs).groupBy("job").agg(F.count("*").alias("seen")).collect()
        assert sorted(map(tuple, told)) == sorted(map(tuple, wanted))


def test_neighbours_are_not_listed(spark, monkeypatch):
    """A parent of many children is counted by its places alone."""
    monkeypatch.setattr(T, "neighbourhood", lambda *a: pytest.fail("listed"))
    nodes = spark.range(1, 2001).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("parent"), (F.col("id") - 1).alias("child_pos")).unionAll(
        spark.sql("SELECT 0L, CAST(NULL AS BIGINT), 0L"))
    closure = nodes.select("node", F.col("node").alias("ancestor")).unionAll(nodes.where("node > 0").select("node", F.lit(0).cast("long")))
    told = T.neighbourhood_sizes(nodes, closure, nodes.select(F.col("node").alias("job"), "node"))
    assert {r["job"]: r["seen"] for r in told.collect()} == {0: 2001, **{n: n + 1 for n in range(1, 2001)}}


def test_contexts_of_many_files_need_no_call_each(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    text = ["namespace A", "open B", "x", "section s", "x", "x", "x", "end s", "x", "end A", "x"]
    rows = [(k, n, t) for k in [*range(30), None] for n, t in enumerate(text, 1)]
    out = S.contexts(spark.createDataFrame(rows, "doc_id long, line_no int, line string"))
    assert "FlatMapGroupsIn" not in out._jdf.queryExecution().toString() and "FlatMapCoGroups" not in out._jdf.queryExecution().toString()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["line_no"], r["namespace"], len(r["opens"])) for r in out.collect())
    assert got == sorted((k is None, k or 0, n, "A" if n < 10 else "", 1 if 2 <= n < 10 else 0) for k, n, _ in rows)


def test_neighbouring_lines_meet_across_blocks(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.randrange(3), r.randrange(-2, 40), r.randrange(30), r.randrange(4), r.choice("NRA"), r.choice("OF")) for _ in range(300)]
    rows += rows[:20] + [(None, 1, 1, 1, "N", "O"), (1, None, 2, 1, "N", "O"), (1, 8, None, 1, "N", "O")]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    full = [x for x in rows if None not in x[:3]]
    met = [(a, b) for a in full for b in full if a[0] == b[0] and a[1] + 1 == b[1] and a[2] != b[2]]
    pairs = {(a[2], b[2]) for a, b in met}
    got = D.edge_pairs(spark, str(tmp_path), directed=True)
    assert sorted(map(tuple, got.collect())) == sorted(pairs)
    assert sorted(map(tuple, D.edge_pairs(spark, str(tmp_path)).collect())) == sorted({(min(p), max(p)) for p in pairs})
    assert D.occurrences(spark, str(tmp_path)).agg(F.sum("n")).first()[0] == len(met)
    # Both sides of the join read one shuffle of lines.
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 2 and plan.count("ReusedExchange") == 1
