"""Adapters: what is refused before a job runs, and what is reported of contradicting tables."""

import pytest

from strandwork.sources import adapters as AD


class Given:
    def __init__(self, tables):
        self.tables = tables

    def collect(self, context):
        return self.tables


def standard(spark, **rows):
    return {t: spark.createDataFrame(rows.get(t, []), ddl) for t, (_, ddl, _) in AD.TABLES.items()}


def test_refused_shapes(spark):
    tables, context = standard(spark), AD.Context(spark, "/nowhere")
    assert set(AD.collected(Given({t: df for t, df in tables.items() if t != "coverage"}), context)) == set(AD.TABLES)
    repos = tables["repositories"]
    for change, said in (
        ({"extra": repos}, "unknown table extra"),
        ({"repositories": repos.drop("root_scope")}, "missing column repositories.root_scope"),
        ({"repositories": repos.withColumn("more", repos.repo_key)}, "unknown column repositories.more"),
        ({"repositories": repos.select("repo_key", "root_scope", "repo_key")}, "repeated column repositories.repo_key"),
        ({"units": tables["units"].withColumn("representative", tables["units"].unit_id)}, "units.representative is string, not bigint"),
    ):
        with pytest.raises(AD.AdapterError, match=said):
            AD.collected(Given({**tables, **change}), context)
    with pytest.raises(AD.AdapterError, match="missing table units; missing table .*|.*missing table units"):
        AD.collected(Given({t: df for t, df in tables.items() if t != "units"}), context)


def test_contradictions(spark):
    tables = standard(
        spark,
        repositories=[("r", "top"), ("r", "top"), (None, "top")],
        scopes=[("top", "r", "root", "top", None), ("low", "q", "folder", "low", "gone")],
        declarations=[(1, "r", "top", "a", "k"), (2, None, "high", "b", "k")],
        units=[("u", 1, [1, 2, 3]), ("v", 9, None)],
        source_texts=[(1, "statement", "en", "x"), (1, "proof", "en", "y"), (7, "proof", "en", "z"), (7, "proof", "en", "z")],
    )
    got = sorted(tuple(str(x) for x in r) for r in AD.faults(AD.collected(Given(tables), AD.Context(spark, ""))).collect())
    assert got == sorted([
        ("repositories", "missing_key", "None", "None"), ("repositories", "repeated_key", "r", "2"),
        ("scopes", "unknown_repository", "low", "q"), ("scopes", "unknown_parent", "low", "gone"),
        ("declarations", "unknown_scope", "2", "high"), ("units", "unknown_member", "u", "3"),
        ("units", "unknown_declaration", "v", "9"), ("source_texts", "unknown_declaration", "7", "7")])


def test_empty_tables_have_no_faults(spark):
    assert AD.faults(AD.collected(Given(standard(spark)), AD.Context(spark, ""))).count() == 0
