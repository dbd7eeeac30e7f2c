"""Readers that are alike are worked out once, and each gets its own rows."""

import pytest
from pyspark.sql import functions as F

from strandwork.operators import ranking as K, tree as T
from strandwork.plans import load_all, q_sources, q_tree
from strandwork.plans.registry import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two nations, six suppliers, 24 parts and readers with repeated, null and several rows."""
    place = tmp_path_factory.mktemp("readers")
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{place}/{name}.parquet")
    put([(0, "EAST"), (1, "WEST")], "r_regionkey long, r_name string", "region")
    put([(0, "A", 0), (1, "B", 0), (2, "C", 1)], "n_nationkey long, n_name string, n_regionkey long", "nation")
    put([(i, f"S{i}", i % 3) for i in range(6)], "s_suppkey long, s_name string, s_nationkey long", "supplier")
    put([(i, f"red {i}", "X", "B1", i % 5) for i in range(24)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int", "part")
    readers = [(i, i % 3) for i in range(1, 61)] + [(7, 1), (8, 0), (None, 0), (61, None), (62, 9)]
    put(readers, "c_custkey long, c_nationkey long", "customer")
    return str(place)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_readers_see_what_they_would_alone(spark, folder):
    load_all()
    nodes, closure = q_tree.full_closure(spark, folder)
    views, expanded = q_tree.reader_views(spark, folder)
    shown = T.visible(nodes, closure, views, expanded)
    front = T.frontier(shown, nodes, expanded)
    shut = views.where("view % 2 = 0").select("view").join(
        expanded.where("node LIKE 'n:%'"), "view").distinct()
    assert rows(QUERIES["i23_visible"](spark, folder)) == rows(shown)
    assert rows(QUERIES["i23_frontier"](spark, folder)) == rows(front)
    assert rows(QUERIES["i24_path_to_hidden"](spark, folder)) == rows(T.path_to(nodes, closure, expanded, expanded))
    assert rows(QUERIES["i24_collapse"](spark, folder)) == rows(T.collapse(expanded, closure, shut))


def test_expansion_sets_do_not_grow_with_readers(spark, folder):
    """One set a kind of reader: nations, and what the key leaves by 2, 3 and 5."""
    readers, _, expanded = q_tree.standing_views(spark, folder)
    assert readers.count() == 63 and readers.select("view").distinct().count() == 63
    assert expanded.select("view").distinct().count() < 20


def test_many_readers_of_a_kind_are_dealt_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "TOGETHER", 10)
    kinds = spark.range(100).select(F.col("id").alias("view"), (F.col("id") % 2).cast("string").alias("kind"))
    readers = T.alike(kinds)
    assert readers.select("reader", "chunk").distinct().count() > 4
    out = T.for_alike(spark.createDataFrame([(0, "x"), (0, "y"), (1, "z")], "view long, node string"), readers)
    assert sorted(tuple(r) for r in out.collect()) == sorted([(i, n) for i in range(100) for n in (("x", "y") if i % 2 == 0 else ("z",))])


@pytest.mark.parametrize("limit", [2, 100])
def test_each_reader_draws_anew(spark, monkeypatch, limit):
    from strandwork.operators.order_stats import positions

    monkeypatch.setattr(K, "ROW_DRAWS", limit)
    readers = T.alike(spark.createDataFrame([(i, str(i % 2)) for i in range(8)] + [(None, "n")], "view long, kind string"))
    standing = spark.createDataFrame([(0, c) for c in "abcd"] + [(1, "e"), (None, "f"), (None, "g")], "view long, candidate string")
    every = T.for_alike(standing, readers)
    want = positions(K.seeded_order(every, "7"), ["view"], ["draw"], "rank", 1).select("view", "candidate", "rank")
    got = K.seeded_ranks(standing, readers, "7")
    assert got.schema == want.schema or [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert rows(got) == rows(want)


def test_a_policy_answers_once_for_readers_that_are_alike(spark, folder, monkeypatch):
    load_all()
    answers = []
    true = q_sources.materialize
    monkeypatch.setattr(q_sources, "materialize", lambda df: answers.append(true(df)) or answers[-1])
    got = QUERIES["o3_custom_policy"](spark, folder)
    customer, supplier = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("customer", "supplier"))
    want = customer.join(supplier, F.col("s_nationkey") == F.col("c_nationkey")).groupBy(F.col("c_custkey").alias("view")).agg(
        F.max(F.concat(F.lit("s:"), "s_suppkey")).alias("pick"))
    assert rows(got) == rows(want) and got.count() == 61
    assert [df.count() < 30 for df in answers] == [True]
