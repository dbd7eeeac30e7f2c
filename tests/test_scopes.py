"""Line contexts in blocks beside one pass over the whole file."""

import random

from strandwork.operators import scopes as S

LINES = ["namespace A", "namespace B.C", "section", "section X", "public section", "private namespace P", "end", "end A", "end X", "end B.C", "end A.X", "end A.B.C",
         "end X.A", "open Q R.s", "open scoped Q", "open Q in", "module", "alias f := g.h", "x := 1", "", "@[simp] section X", "import M N.o", "ending"]


def plain(lines):
    stack, out = S.outermost(), []
    for line in lines:
        for step in S.steps(line):
            S.run(stack, step)
        out.append(stack[-1])
    return out


def test_reduced_steps_have_the_same_effect():
    rng = random.Random(2)
    for _ in range(2000):
        before = [s for line in rng.choices(LINES, k=rng.randint(0, 8)) for s in S.steps(line)]
        every = [s for line in rng.choices(LINES, k=rng.randint(0, 14)) for s in S.steps(line)]
        a, b = S.outermost(), S.outermost()
        for s in before:
            S.run(a, s)
            S.run(b, s)
        for s in every:
            S.run(a, s)
        for s in S.reduced(every):
            S.run(b, s)
        assert a == b
    deep = [s for line in ["namespace A"] * 500 + ["end"] * 500 for s in S.steps(line)]
    assert S.reduced(deep) == []


def test_named_ends_close_compounds():
    at = lambda lines: plain(lines)[-1]["namespace"]
    assert at(["namespace A", "section X", "end A.X"]) == "" and at(["namespace A", "section X", "end X"]) == "A"
    assert at(["namespace A", "namespace B.C", "end C"]) == "A.B.C" and at(["end", "namespace A"]) == "A"
    assert plain(["open Q R.s", "namespace A", "open T", "end"])[2]["opens"] == [{"at": "", "name": "Q"}, {"at": "", "name": "R.s"}, {"at": "A", "name": "T"}]
    assert plain(["module", "public section", "end"])[1]["public"] and not plain(["module", "public section", "end"])[2]["public"]


def test_blocks_give_the_contexts_of_whole_files(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)
    rng = random.Random(5)
    files = {k: rng.choices(LINES, k=n) for k, n in ((1, 90), (2, 6), (3, 1), (4, 60), (None, 20))}
    rows = [(k, i + 1, line) for k, own in files.items() for i, line in enumerate(own)]
    df = spark.createDataFrame([*rows, (9, 1, None)], "doc_id long, line_no int, line string")
    got = {(r.doc_id, r.line_no): (r.namespace, [o.asDict() for o in r.opens], [a.asDict() for a in r.aliases], r.public) for r in S.contexts(df).collect()}
    want = {(k, i + 1): (t["namespace"], t["opens"], t["aliases"], t["public"]) for k, own in [*files.items(), (9, [""])] for i, t in enumerate(plain(own))}
    assert got == want
    assert {(r.doc_id, r.module) for r in S.imports(df).collect()} == {(k, m) for k, own in files.items() if "import M N.o" in own for m in ("M", "N.o")}
    assert S.contexts(df.limit(0)).count() == S.imports(df.limit(0)).count() == 0
