"""Text helpers, state rules, packages, and registered queries beside their SQL."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandwork.functions import text as X
from strandwork.operators import features as FE, merge as M
from strandwork.sources import packages as P
from strandwork.streaming.jobs import TERMINAL, advance
from tests.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
QUICK = ["e1_distinct_edges", "e2_repository_boundaries", "e4_quotient_by_module", "e19_agreement_by_grouping_sets", "j3_node_interfaces",
         "i11_provider_closure", "i23_frontier", "c3_keep_hide_decisions", "d4_merge_two_sources", "e7_field_merge", "a20_document_outline",
         "l6_rendered_views", "m2_referential_integrity", "n4_optimistic_actions", "n5_expansion_sets"]


def test_comments_nest_and_strings_protect():
    source = 'a /- x /- y -/ z -/ b -- tail\n\n"/- kept -/" c\n/- open\nline -/d'
    assert "x" not in X._without_comments(source) and "kept" in X._without_comments(source) and "tail" not in X._without_comments(source)
    assert [s.strip() for s in X._without_comments(source).split("\n")] == ["a   b", '"/- kept -/" c', "d"]


def test_names_paths_and_shards(spark):
    df = spark.createDataFrame([("A.«x.y».z", "a/../../b")], "n string, p string")
    row = df.select(X.name_parts(F.col("n")).alias("n"), X.normal_path(F.col("p")).alias("p"), X.fnv_shard(F.lit("Nat.add")).alias("s")).first()
    value = 2166136261
    for byte in b"Nat.add":
        value = ((value ^ byte) * 16777619) & 0xFFFFFFFF
    assert (row.n, row.p, row.s) == (["A", "«x.y»", "z"], None, value % 256)


def test_missing_is_not_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "k string, value double")
    got = {r.k: r for r in FE.aggregate(df, ["k"]).collect()}
    assert (got["a"].value, got["a"].observed_sum, got["a"].status, got["a"].coverage) == (None, 1.0, "partial", 0.5)
    assert (got["b"].value, got["b"].status, got["c"].observed_sum, got["c"].status) == (2.0, "present", 0.0, "missing")
    empty = FE.empty_as_covered(spark.createDataFrame([("z",)], "k string"), FE.aggregate(df, ["k"]), ["k"]).first()
    assert (empty.value, empty.coverage, empty.total_count) == (0.0, 1.0, 0)


def test_provider_aliases(spark):
    names = ["x/dependency/y/dependency/Mathlib", "core/Lean", "Batteries"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(M.provider_name(F.col("n"))).collect()] == ["mathlib", "lean", "batteries"]


def test_job_states_absorb_and_belong():
    assert advance("queued", 1, "view", 1) == ("drafting", "moved")
    assert advance("validating", 1, "view", 1) == ("published", "moved")
    assert advance("drafting", 1, "view", 2) == ("drafting", "not_owner")
    assert advance("drafting", 1, "error", 1) == ("failed", "moved")
    for s in TERMINAL:
        assert advance(s, 1, "click", 1) == (s, "absorbed")


def test_packages_are_strict(spark, tmp_path):
    text = {"text": "x = x", "status": "present"}
    part = {"nl": text, "formal": text, "deps": [{"provider": {"repo_key": "b", "local_id": "q"}, "evidence_kind": "lean_type"}]}
    doc = {"workspace_id": "w", "manifest": {"repositories": [{"repo_key": "a", "primary_outcomes": [{"repo_key": "a", "local_id": "p"}]}], "assets": [], "dependency_locks": []},
           "scopes": [{"scope_id": "s", "repo_key": "a", "kind": "root", "name": "a"}], "units": [],
           "declarations": [{"ref": {"repo_key": "a", "local_id": "p"}, "lean_name": "p", "statement": part}]}
    (tmp_path / "w.json").write_text(json.dumps(doc, indent=1))
    tables = P.read_packages(spark, str(tmp_path / "w.json"))
    assert tables["dep_occurrences"].count() == 1 and tables["decls"].first().lean_name == "p"
    (tmp_path / "bad.json").write_text(json.dumps({**doc, "scopes": "none"}))
    with pytest.raises(Exception):
        P.read_packages(spark, str(tmp_path / "bad.json"))["scopes"].collect()
    (tmp_path / "lines.jsonl").write_text('{"a":1,"b":2}\n{"a":1,"a":2}\n{"a":3}\n')
    assert {(r.field, r.n) for r in P.field_report(spark, str(tmp_path / "lines.jsonl"), ["a"]).collect()} == {("b", 1), (None, 1)}


def test_artifacts_refuse_another_kind(spark, tmp_path):
    P.save_artifact(spark.range(5).toDF("x"), str(tmp_path / "a"), "numbers")
    assert P.load_artifact(spark, str(tmp_path / "a"), "numbers").count() == 5
    with pytest.raises(ValueError):
        P.load_artifact(spark, str(tmp_path / "a"), "edges")


@pytest.mark.parametrize("name", QUICK)
def test_queries_match_their_sql(spark, name):
    status, _, _, note = compare(spark, connect(SMALL), SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", note


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


class HeldState:
    """Stands in for the engine's keyed state."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def run_rules(rule, key, columns, rows, state):
    import pandas as pd

    out = pd.concat(list(rule((key,), iter([pd.DataFrame(rows, columns=columns)]), state)))
    return list(out.itertuples(index=False, name=None))


def test_sibling_group_jobs_take_drafts_in_order_on_the_current_base():
    from strandwork.streaming.jobs import _group

    state, cols = HeldState(), ["parent", "seq", "kind", "base", "index", "size"]
    first = run_rules(_group, 7, cols, [(7, 1, "accept", 0, 0, 2), (7, 2, "create", 1, 0, 2), (7, 3, "create", 0, 0, 2), (7, 4, "create", 0, 0, 2),
                                        (7, 5, "accept", 0, 1, 2), (7, 6, "accept", 0, 0, 2)], state)
    assert [r[2] for r in first] == ["no_active_job", "stale_base", "created", "already_active", "out_of_order", "accepted"]
    second = run_rules(_group, 7, cols, [(7, 7, "accept", 0, 1, 2), (7, 8, "create", 0, 0, 2), (7, 9, "create", 1, 0, 2)], state)
    assert [r[2] for r in second] == ["published", "stale_base", "created"]


def test_job_life_cycle_keeps_its_first_owner_across_batches():
    from strandwork.streaming.jobs import _life

    state, cols = HeldState(), ["job", "seq", "kind", "actor"]
    first = run_rules(_life, 1, cols, [(1, 2, "view", 5), (1, 1, "signup", 5), (1, 3, "view", 6)], state)
    assert [r[2:] for r in first] == [("queued", "ignored"), ("drafting", "moved"), ("drafting", "not_owner")]
    second = run_rules(_life, 1, cols, [(1, 4, "click", 5), (1, 5, "view", 5)], state)
    assert [r[2:] for r in second] == [("cancelled", "moved"), ("cancelled", "absorbed")]


def test_files_are_emitted_once_when_complete():
    from strandwork.streaming.appends import _gather
    import pandas as pd

    state, cols = HeldState(), ["file", "chunk_index", "chunk_count"]
    assert list(_gather((3,), iter([pd.DataFrame([(3, 0, 3), (3, 2, 3)], columns=cols)]), state)) == []
    assert run_rules(_gather, 3, cols, [(3, 1, 3)], state) == [(3, 3, "complete")]
    assert list(_gather((3,), iter([pd.DataFrame([(3, 1, 3)], columns=cols)]), state)) == []


def test_backslashes_escape_inside_strings_only():
    from strandwork.functions.text import _without_comments as bare

    assert bare("/- a \\-/ b").strip() == "b"
    assert bare("x -- c\\\ny") == "x \ny"
    assert bare("f \\-- c") == "f \\"
    assert bare('"a\\"--b" -- c').strip() == '"a\\"--b"'


def test_inversions_with_negative_values(spark):
    from strandwork.operators.stats import inversions

    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate([5, -3, 1])] + [("h", 0, -2), ("h", 1, -2)], "k string, o int, v int")
    assert {r.k: r.inversions for r in inversions(rows, ["k"], "o", "v").collect()} == {"g": 2, "h": 0}


def test_type_heads_at_any_depth(spark):
    from pyspark.sql import functions as F
    from strandwork.operators.merge import type_head

    want = {"T (a -> ((((((((b))))))))": "T", "T ⟨a = b⟩": "T", "fun x": None, "T -> U": None, "(T)": None, "Ns.T x": "Ns.T", "a = b": None}
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", type_head(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == want


def test_kept_tables_follow_their_input(spark, tmp_path):
    from strandwork.session import kept

    made = []
    for n in (1, 1, 2):
        if len(made) < n:
            (tmp_path / f"t{n}").write_text("x")
        kept(spark, ("a name", str(tmp_path)), lambda: made.append(1))
    assert len(made) == 2


def test_no_commands_inside_verbatim(spark):
    from strandwork.operators.materials import outline

    text = ["\\section{A}", "\\begin{verbatim}", "\\section{no}", "\\begin{proof}", "\\end{verbatim}", "\\begin{proof}", "in", "\\end{proof}", "out"]
    rows = spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "root string, pos long, text string")
    got = {r.pos: (r.heading, r.environment) for r in outline(rows).collect()}
    assert [p for p, (h, _) in got.items() if h] == [0]
    assert got[6][1] == "proof" and got[8][1] is None and got[2][1] == "verbatim"
