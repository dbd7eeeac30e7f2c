"""Rounds of graph loops: few of them on long cycles, and the same answers as step by step."""

import random

from strandwork import session
from strandwork.operators import components as C, iterate as I
from tests.test_graph_jobs import closed


def counted(monkeypatch):
    written = []

    def write(df, real=session.materialize):
        written.append(1)
        return real(df)

    for module in (session, C, I):
        monkeypatch.setattr(module, "materialize", write)
    return written


def test_long_rings_take_few_rounds(spark, monkeypatch):
    # A ring of 150, and one of 120 that is closed twice.
    pairs = [(i, (i + 1) % 150) for i in range(150)] + [(200 + i, 200 + (i + 1) % 120) for i in range(120)] + [(260, 200)]
    written = counted(monkeypatch)
    got = C.cyclic_components(spark.range(400).toDF("node"), spark.createDataFrame(pairs, "provider long, consumer long")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(150)}, **{200 + i: 200 for i in range(120)}}
    assert len(written) < 100


def test_components_with_chains_and_what_they_reach(spark):
    pairs = []
    for at in range(0, 1200, 100):
        r = random.Random(at)
        some = lambda: at + r.randrange(14)
        pairs += [(some(), some()) for _ in range(5 + at // 100)]
        # Chains, rings and rings that hang on a node.
        for k in range(6):
            a, b = some(), some()
            way = [a, *(at + 20 + 5 * k + i for i in range(r.randrange(1, 4))), a if k == 5 else b]
            pairs += zip(way, way[1:])
        pairs += [(at + 60, at + 61), (at + 61, at + 62), (at + 62, at + 60)]
    nodes = spark.range(1200).toDF("node")
    edges = spark.createDataFrame(pairs, "provider long, consumer long")
    way = closed(pairs)
    want = {a: min(y for x, y in way if x == a and (y, a) in way) for a, b in way if a == b}
    got = C.cyclic_components(nodes, edges).collect()
    assert len(got) == len(want) and {x.node: x.component for x in got} == want
    starts = nodes.where("node % 3 = 0")
    assert sorted(map(tuple, C.reachable(starts, edges).collect())) == sorted(
        {(a, b) for a, b in way if a % 3 == 0} | {(a, a) for a in range(0, 1200, 3)})
