"""Pairs of rows of one key beside a plain loop."""

from strandwork.operators import products, tree as T


def test_every_pair_of_a_key_once(spark, monkeypatch):
    monkeypatch.setattr(products, "BLOCK", 4)
    monkeypatch.setattr(products, "PACK", 3)
    rows = [(1, f"r{i}") for i in range(30)] + [(2, "x"), (2, "x"), (None, "n"), (None, None), (3, "alone")]
    many = [(i, 1) for i in range(20)] + [(i, 2) for i in range(40)] + [(5, None), (None, None), (5, None), (6, 4)]
    out = products.every_pair(spark.createDataFrame(rows, "k long, a string"), spark.createDataFrame(many, "b long, k long"), ["k"])
    assert out.columns == ["k", "a", "b"]
    got = out.selectExpr("k", "a", "b", "spark_partition_id() AS p").collect()
    assert sorted(((r["k"], r["a"], r["b"]) for r in got), key=repr) == sorted(((k, a, b) for k, a in rows for b, j in many if j == k), key=repr)
    # Neither a key of many rows nor one of few rows and many partners is one task's.
    for key in (1, 2):
        assert len({r["p"] for r in got if r["k"] == key}) > 1


def test_several_columns_and_given_packs(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "k long, a string")
    many = spark.createDataFrame([(1, c, c % 2, f"t{c}") for c in range(6)], "k long, c long, pack long, t string")
    got = products.every_pair(rows, many, ["k"], "pack")
    assert got.columns == ["k", "a", "c", "t"]
    assert sorted(map(tuple, got.collect())) == sorted((1, a, c, f"t{c}") for a in "ab" for c in range(6))


def test_views_of_a_kind_come_as_arrays(spark):
    """Rows of a reader meet packs of views, not single ones."""
    readers = T.alike(spark.createDataFrame([(i, str(i % 2)) for i in range(50)], "view long, kind string"))
    out = T.for_alike(spark.createDataFrame([(0, "x"), (1, "y"), (1, "z")], "view long, node string"), readers)
    assert "Generate explode(__all" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted((i, n) for i in range(50) for n in ("x" if i % 2 == 0 else "yz"))
