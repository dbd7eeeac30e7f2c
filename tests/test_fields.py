"""Field merging: planted winners, conflicts, unions and exact dependencies."""

from strandwork.operators import fields as FD

SAID = "ref int, field string, authority string, backend string, method string, state string, value string"


def test_scalars_and_conflicts(spark):
    rows = [
        (1, "kind", "lean_environment", "z", "m", "present", "A"), (1, "kind", "lc_catalog", "b", "m", "present", "B"), (1, "kind", "text_ast", "a", "m", "present", "C"),
        (2, "kind", "lc_catalog", "b", "m", "present", "A"), (2, "kind", "lean_environment", "z", "m", "present", "A"),  # equal: no conflict
        (3, "proof.nl", "lean_source", "a", "m", "present", None), (3, "proof.nl", "generated", "b", "m", "present", "text"),  # a missing text gives way
        (4, "proof.nl", "other", "a", "m", "present", None), (4, "proof.nl", "other", "b", "m", "not_applicable", None),
        (5, "proof.nl", "other", "a", "m", "not_applicable", None), (6, "source_refs", "other", "a", "m", "present", None),
    ]
    said = spark.createDataFrame(rows, SAID)
    assert {tuple(r) for r in FD.scalars(said).collect()} == {(1, "kind", "B", "b"), (2, "kind", "A", "b"), (3, "proof.nl", "text", "b"), (4, "proof.nl", None, "a")}
    assert {tuple(r) for r in FD.conflicts(said).collect()} == {(1, "kind", "equal_authority", "B", "z:A"), (4, "proof.nl", "present_vs_not_applicable", None, None)}
    assert FD.scalars(said.limit(0)).count() == FD.conflicts(said.limit(0)).count() == 0


def test_unions(spark):
    said = spark.createDataFrame([(1, "attributes", "a", "b", "m", "present", None)] * 2 + [(2, "attributes", "a", "b", "m", "present", None), (3, "attributes", "a", "b", "m", "missing", None)], SAID)
    members = spark.createDataFrame([(1, "attributes", x) for x in "bab"] + [(3, "attributes", "c")], "ref int, field string, item string")
    assert {(r.ref, tuple(r["items"])) for r in FD.unions(said, members).collect()} == {(1, ("a", "b")), (2, ())}


def test_exact_sources_replace_approximate_dependencies(spark):
    said, deps, complete = [], [], []
    for ref in range(1, 8):
        for authority in ("text_ast", "lean_environment", "lc_catalog"):
            said.append((ref, "statement.deps", authority, "b", "m", "present", None))
            if (ref, authority) != (5, "lc_catalog"):
                deps.append((ref, "statement.deps", authority, f"p_{authority}", "k", "", authority))
                deps.append((ref, "statement.deps", authority, "shared", "k", "", authority))
    said.append((3, "proof.deps", "other", "b", "m", "present", None))
    complete += [(1, "statement", "lean_type"), (2, "statement", "lean_type"), (2, "statement", "lean_value"), (3, "statement", "lean_type"), (4, "statement", "lc_declared"),
                 (5, "statement", "lc_declared"), (6, "statement", "lean_type"), (6, "statement", "lean_value"), (6, "statement", "lc_declared"), (7, "proof", "lean_value")]
    deps.append((7, "statement.deps", "unspoken", "q", "k", "", "x"))
    got = FD.dependencies(spark.createDataFrame(said, SAID),
                          spark.createDataFrame(deps, "ref int, field string, authority string, provider string, evidence_kind string, provider_module string, source string"),
                          spark.createDataFrame(complete, "ref int, part string, domain string")).collect()
    seen = {}
    for r in got:
        seen.setdefault(r.ref, {})[r.provider] = r.sources
    env, lc, text = "lean_environment", "lc_catalog", "text_ast"
    every = {f"p_{a}": [a] for a in (env, lc, text)} | {"shared": [lc, env, text]}
    assert seen[1] == seen[7] == every  # values of the statement are not complete; a proof's domain says nothing about a statement
    assert seen[2] == seen[3] == {"p_lean_environment": [env], "shared": [env]}  # with a proof the types suffice
    assert seen[4] == {"p_lc_catalog": [lc], "shared": [lc]}
    assert 5 not in seen  # an exact empty list replaces the guesses
    assert seen[6] == {"p_lean_environment": [env], "p_lc_catalog": [lc], "shared": [lc, env]}
