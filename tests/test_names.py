"""Name resolution tier by tier beside a plain resolver: rooted, relative, opened, alias, ambiguous, hidden."""

import random

import pytest

from strandwork.operators import names as N

SYMBOLS = [
    ("s1", 1, "A.B.x", True), ("s2", 1, "A.x", True), ("s3", 2, "x", True), ("s4", 3, "C.y", True), ("s5", 3, "A.C.y", True),
    ("s6", 2, "D.z", True), ("s7", 3, "E.z", True), ("s8", 1, "hidden", False), ("s9", 9, "far", True), ("s10", 2, "A.t", True), ("s11", 3, "twice", True), ("s12", 2, "twice", True),
]
VISIBLE = [(1, 1), (1, 2), (1, 3), (2, 2), (3, 3)]


def plain(token, module, namespace, opens, aliases, symbols, visible):
    seen = {s for m, s in visible if m == module}
    parts = lambda ns: [p for p in ns.split(".") if p]
    spaces = {".".join(n.split(".")[:i]) for _, m, n, _ in symbols if m in seen for i in range(1, len(n.split(".")))}
    opened = []
    for at, name in opens:
        if name.startswith("_root_."):
            opened.append(name[7:])
            continue
        for i in range(len(parts(at)), -1, -1):
            if ".".join(parts(at)[:i] + [name]) in spaces:
                opened.append(".".join(parts(at)[:i] + [name]))
                break

    def tiers(word, ns):
        if word.startswith("_root_."):
            return [[word[7:]]]
        return [[".".join(parts(ns)[:i] + [word])] for i in range(len(parts(ns)), -1, -1)] + [[f"{o}.{word}" for o in opened]]

    mean = lambda names: {r for r, m, n, p in symbols if n in names and m in seen and (p or m == module)}
    for k, names in enumerate(tiers(token, namespace)):
        found = mean(names)
        for m, alias, target in aliases:
            if m == module and alias in names:
                found |= next((f for t in tiers(target, alias.rpartition(".")[0]) if (f := mean(t))), set())
        if found:
            return ("edge", next(iter(found)), k) if len(found) == 1 else ("ambiguous", None, k)
    return ("unresolved", None, None)


def run(spark, tokens, contexts, symbols, visible, aliases):
    got = N.resolve(
        spark.createDataFrame(tokens, "context int, token string"),
        spark.createDataFrame(contexts, "context int, module int, namespace string, opens array<struct<at: string, name: string>>"),
        spark.createDataFrame(symbols, "ref string, module int, name string, public boolean"),
        spark.createDataFrame(visible, "module int, seen int"), spark.createDataFrame(aliases, "module int, alias string, target string"))
    return {(r.context, r.token): (r.status, r.ref, r.tier) for r in got.collect()}


def test_tiers_opens_and_aliases(spark):
    contexts = [(1, 1, "A.B", [("A", "C")]), (2, 1, "", [("", "_root_.D"), ("", "_root_.E"), ("Q", "nowhere")]), (3, 2, "A", [])]
    aliases = [(1, "A.short", "t"), (1, "far2", "_root_.x"), (2, "x", "_root_.D.z")]
    tokens = [(1, t) for t in ("x", "_root_.x", "y", "short", "hidden", "far", "none", "twice", "far2")] + [(2, "z"), (2, "y"), (3, "x"), (3, "hidden"), (3, "y")]
    got = run(spark, tokens + tokens[:3], contexts, SYMBOLS, VISIBLE, aliases)
    assert got[1, "x"] == ("edge", "s1", 0)  # innermost namespace
    assert got[1, "_root_.x"] == ("edge", "s3", 0)  # rooted: nothing around it counts
    assert got[1, "y"] == ("edge", "s5", 3)  # opened: A.C goes before C
    assert got[1, "short"] == ("edge", "s10", 1)  # an alias means its target where the alias was made
    assert got[1, "far2"] == ("edge", "s3", 2) and got[1, "hidden"] == ("edge", "s8", 2)
    assert got[1, "far"] == got[1, "none"] == got[3, "hidden"] == got[2, "y"] == ("unresolved", None, None)  # not imported, unknown, private elsewhere
    assert got[1, "twice"] == ("ambiguous", None, 2) and got[2, "z"] == ("ambiguous", None, 1)
    assert got[3, "x"] == ("ambiguous", None, 1)  # a declaration and an alias in one tier
    assert got == {(c, t): plain(t, m, ns, o, aliases, SYMBOLS, VISIBLE) for c, t in tokens for k, m, ns, o in contexts if k == c}


@pytest.mark.parametrize("crowded", [64, 0, 2])
def test_resolution_is_that_of_a_plain_resolver(spark, monkeypatch, crowded):
    monkeypatch.setattr(N, "CROWDED", crowded)
    rng = random.Random(crowded)
    name = lambda n: ".".join(rng.choice("ABC") for _ in range(rng.randint(0, n)))
    dotted = lambda ns, w: f"{ns}.{w}" if ns else w
    symbols = list({(m, n): (f"{m}/{n}", m, n, rng.random() < 0.7) for m in range(8) for n in (dotted(name(3), rng.choice("pqrs")) for _ in range(6))}.values())
    visible = sorted({(m, m) for m in range(8)} | {(m, rng.randrange(8)) for m in range(8) for _ in range(3)})
    contexts = [(c, rng.randrange(8), name(3), [(name(2), rng.choice(["A", "B", "_root_.C", "A.B"])) for _ in range(rng.randint(0, 3))]) for c in range(40)]
    aliases = [(m, dotted(name(2), rng.choice("pt")), rng.choice(["q", "_root_.r", "A.s"])) for m in range(8)]
    tokens = [(c, rng.choice(["", "", "_root_."]) + dotted(name(1), rng.choice("pqrst"))) for c in range(40) for _ in range(6)]
    got = run(spark, tokens, contexts, symbols, visible, aliases)
    assert got == {(c, t): plain(t, *contexts[c][1:], aliases, symbols, visible) for c, t in tokens}
    assert len({s for s, *_ in got.values()}) == 3
