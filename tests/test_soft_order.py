"""Ready queues that soft relations steer, against a step-by-step solver."""

import random

import pytest

from strandwork.operators import sibling as S, soft_order as O
from tests.test_order_jobs import distance, problems, solved, tables


def steered(n, before, wishes, key):
    """What is emitted step by step: of all that may come next, those first that nothing there asks to wait."""
    out, todo = [], set(range(n))
    while todo:
        ready = {i for i in todo if not any(a in todo for a, b in before if b == i)}
        held = {b for a, b in wishes if a in ready and b in ready}
        out.append(min(ready - held or ready, key=key))
        todo.remove(out[-1])
    return out


def plain(rank, edges, wishes):
    n = len(rank)
    pairs = [(a, b) for a, b, _ in edges]
    pull = [sum(w for a, b, w in edges if b == i) - sum(w for a, b, w in edges if a == i) for i in range(n)]
    source = steered(n, pairs, wishes, lambda i: rank[i])
    back = steered(n, [(b, a) for a, b in pairs], [(b, a) for a, b in wishes], lambda i: (pull[i], -rank[i]))[::-1]
    turned = lambda o: sum(o.index(a) > o.index(b) for a, b in wishes)
    off = lambda o: sum(abs(i - rank[x]) for i, x in enumerate(o))
    return source, back, min((source, back), key=lambda o: (distance(edges, o), turned(o), off(o), o))


def test_bundles_are_emitted_like_the_plain_queue():
    for seed in range(400):
        r = random.Random(seed)
        n = r.randrange(1, 12)
        rank = r.sample(range(100), n)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.15]
        wishes = sorted({(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(r.randrange(2 * n))) if a != b})
        got = O.emit(dict(enumerate(rank)), pairs, wishes)
        assert [x for x, _ in got] == steered(n, pairs, wishes, lambda i: rank[i])
    with pytest.raises(ValueError):
        O.emit({"a": 0, "b": 1}, [("a", "b"), ("b", "a")], [])


def test_starts_and_choice_match_a_plain_solver_in_tasks_and_in_rounds(spark):
    """Parents with no wish, few wishes and so many that several bundles run in circles; wishes that say nothing are ignored."""
    r = random.Random(8)
    probs = [(p, rank, [e for e in es if r.random() < 0.3]) for p, rank, es in problems(6, 10, 40)]
    wishes = {}
    for k, (p, *_) in enumerate(probs):
        wishes[p] = sorted({(a, b) for a, b in ((r.randrange(10), r.randrange(10)) for _ in range(4 * k)) if a != b})
    name = lambda i: f"a{i:02d}"
    rows = [(p, name(a), name(b)) for p, ws in wishes.items() for a, b in ws]
    odd = [("p0", "a01", "a01"), ("p0", "a01", "elsewhere"), ("other", "a01", "a02"), (None, None, "a01")]
    soft = spark.createDataFrame(rows + odd, "parent string, provider string, consumer string")
    atoms, edges = tables(spark, probs)
    want = {p: plain(rank, es, wishes[p]) for p, rank, es in probs}
    without = {p: plain(rank, es, []) for p, rank, es in probs}
    assert any(want[p][0] != without[p][0] for p in want) and any(want[p][1] != without[p][1] for p in want)
    source, back = S.source_start(atoms, edges, soft).cache(), S.reverse_start(atoms, edges, soft).cache()
    assert solved(source) == {p: w[0] for p, w in want.items()}
    assert solved(back) == {p: w[1] for p, w in want.items()}
    assert solved(S.pick_start(atoms, edges, source, back, soft)) == {p: w[2] for p, w in want.items()}
    assert solved(S.source_start(atoms, edges, soft, task_rows=0)) == {p: w[0] for p, w in want.items()}


def test_wishes_decide_between_starts_of_equal_distance(spark):
    atoms, edges = tables(spark, [("p", [0, 1, 2], [])])
    schema = "parent string, provider string, consumer string"
    a, b = (spark.createDataFrame([("p", f"a{x:02d}", i) for i, x in enumerate(o)], "parent string, atom string, pos long")
            for o in ([0, 1, 2], [2, 1, 0]))
    soft = spark.createDataFrame([("p", "a02", "a01"), ("p", "a01", "a00"), ("p", "a00", "a02")], schema)
    assert solved(S.pick_start(atoms, edges, a, b)) == {"p": [0, 1, 2]}
    assert solved(S.pick_start(atoms, edges, a, b, soft)) == {"p": [2, 1, 0]}


def test_no_atoms_and_no_wishes(spark):
    atoms, edges = tables(spark, problems(1, 4, 70))
    none = spark.createDataFrame([], "parent string, provider string, consumer string")
    assert S.source_start(atoms.limit(0), edges.limit(0), none).count() == 0


def test_bundles_of_long_chains(spark):
    n = 60
    name = list(range(n))
    random.Random(3).shuffle(name)
    chain = [("p", f"a{name[i]:03d}", f"a{name[i + 1]:03d}") for i in range(n - 1) if i != 40]
    got = {r.atom: r.bundle for r in O.bundles(spark.createDataFrame(chain, "parent string, provider string, consumer string")).collect()}
    want = {f"a{name[i]:03d}": f"a{min(name[:41] if i <= 40 else name[41:]):03d}" for i in range(n)}
    assert got == want
