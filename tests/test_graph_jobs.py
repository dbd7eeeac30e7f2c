"""Loops over graphs against small step-by-step answers."""

import heapq
import random

from pyspark.sql import functions as F

from strandwork.operators import graph as G, iterate as I, tree as T
from strandwork.operators.components import cyclic_components, witnesses
from strandwork.operators.order_stats import positions, quantiles, running
from strandwork.plans import load_all
from strandwork.plans.registry import QUERIES


def random_dag(n, p, seed):
    r = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < p]


def ready_queue(n, edges, rank):
    left, out = [0] * n, []
    for _, b in edges:
        left[b] += 1
    ready = [rank[i] for i in range(n) if not left[i]]
    back = {r: i for i, r in enumerate(rank)}
    heapq.heapify(ready)
    while ready:
        x = back[heapq.heappop(ready)]
        out.append(x)
        for a, b in edges:
            if a == x:
                left[b] -= 1
                if not left[b]:
                    heapq.heappush(ready, rank[b])
    return out


def test_trails_give_the_ready_queue_order(spark):
    n, wanted, nodes, edges = 14, {}, [], []
    for g in range(12):
        dag = random_dag(n, 0.05 + 0.04 * g, g)
        rank = list(range(n))
        random.Random(100 + g).shuffle(rank)
        wanted[g] = ready_queue(n, dag, rank)
        nodes += [((g, i), rank[i]) for i in range(n)]
        edges += [((g, a), (g, b)) for a, b in dag]
    ref = "struct<g:int,i:int>"
    nodes = spark.createDataFrame(nodes, f"node {ref}, rank long")
    edges = spark.createDataFrame(edges, f"provider {ref}, consumer {ref}")
    rows = I.waves(nodes, edges, F.col("rank")).select("node.g", "node.i", "trail").collect()
    for g in wanted:
        mine = [r.i for r in sorted((r for r in rows if r.g == g), key=lambda r: r.trail)]
        assert mine == wanted[g]


def test_cycles_blocked_and_witness(spark):
    # Self-loop, two-cycle, a blocked tail and a longer cycle.
    pairs = [(1, 1), (2, 3), (3, 2), (3, 4), (4, 5), (6, 7), (7, 8), (8, 6), (7, 9), (0, 6), (8, 7)]
    e = spark.createDataFrame(pairs, "provider long, consumer long")
    nodes = spark.range(10).toDF("node")
    comp = {r.node: r.component for r in cyclic_components(nodes, e).collect()}
    assert comp == {1: 1, 2: 2, 3: 2, 6: 6, 7: 6, 8: 6}
    walks = {r.component: r.walk for r in witnesses(cyclic_components(nodes, e), e).collect()}
    assert walks == {1: [1, 1], 2: [2, 3, 2], 6: [6, 7, 8, 6]}
    stuck = {r.node for r in I.waves(nodes, e).where("level IS NULL").collect()}
    assert stuck - set(comp) == {4, 5, 9}


def closed(pairs):
    """Every (a, b) with a way of one step or more from a to b."""
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        todo, met = [a], set()
        for x in todo:
            new = after.get(x, set()) - met
            met |= new
            todo.extend(new)
        out |= {(a, b) for b in met}
    return out


def test_cycles_and_imports_across_modules(spark, tmp_path):
    # Suppliers 1-4 in nations 1, 1, 2, 3; part p is in module p % 4 (part counts are those of derived.decls).
    load_all()
    d = str(tmp_path)
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write("region", [(0, "R0"), (1, "R1")], "r_regionkey int, r_name string")
    write("nation", [(1, "N1", 0), (2, "N2", 0), (3, "N3", 1)], "n_nationkey int, n_name string, n_regionkey int")
    write("supplier", [(i, f"S{i}", n) for i, n in enumerate((1, 1, 2, 3))], "s_suppkey long, s_name string, s_nationkey int")
    write("part", [(i, f"p {i}", "B", "T", 1 + i) for i in range(16)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    chains = [(0, 1, 2, 0), (4, 8, 4), (2, 5), (5, 9, 13), (7, 11, 15), (12, 3), (6, 10, 7)]
    write("lineitem", [(o, n, p) for o, c in enumerate(chains) for n, p in enumerate(c)], "l_orderkey long, l_linenumber int, l_partkey long")
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, d).collect()]
    pairs = {(a, b) for c in chains for a, b in zip(c, c[1:])}
    way = closed(pairs)
    comp = {a: min(y for x, y in way if x == a and (y, a) in way) for a, b in way if a == b}
    assert dict(run("i6_cyclic_components_whole")) == comp and comp == {0: 0, 1: 0, 2: 0, 4: 4, 8: 4}
    assert {n for n, in run("i8_blocked_whole")} == {b for a, b in way if a in comp} - set(comp) == {5, 9, 13}
    assert dict(run("i7_cycle_witness")) == {0: "0,1,2,0", 4: "4,8,4"}
    uses = {(f"s:{max(e) % 4}", f"s:{min(e) % 4}") for e in pairs if (max(e) - min(e)) % 4}
    assert sorted(run("i12_import_closure_whole")) == sorted(closed(uses) | {(f"s:{i}", f"s:{i}") for i in range(4)})


def test_boundary_of_all_subsets(spark):
    pairs = [(0, 1), (1, 2), (0, 3), (3, 2), (2, 4), (4, 4)]
    sets = [(s, i) for s in range(32) for i in range(5) if s >> i & 1]
    got = G.boundary(spark.createDataFrame(pairs, "provider long, consumer long"), spark.createDataFrame(sets, "grp long, ref long")).collect()
    want = set()
    for s in range(32):
        for a, b in pairs:
            p, c = s >> a & 1, s >> b & 1
            if p or c:
                want.add((s, a, b, "internal" if p and c else "outgoing" if p else "incoming"))
    assert {tuple(r) for r in got} == want


def test_closure_and_cycle_detection(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "node long, parent long")
    closure = I.ancestors(chain)
    assert closure.count() == 40 * 41 // 2
    assert closure.where("node = 39").agg(F.max("depth")).first()[0] == 39
    ring = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (3, 2), (4, None), (5, 4)], "node long, parent long")
    assert {r.node for r in I.parent_cycles(ring).collect()} == {0, 1, 2, 3}


def test_compress_wrappers(spark):
    rows = [("r", None, "repo"), ("a", "r", "scope"), ("b", "a", "scope"), ("u1", "b", "unit"), ("u2", "b", "unit"), ("c", "b", "scope"), ("u3", "c", "unit"),
            ("q", None, "repo"), ("d", "q", "scope"), ("u4", "d", "unit")]
    kept, aliases = T.compress(spark.createDataFrame(rows, "node string, parent string, kind string"))
    assert {(r.node, r.parent) for r in kept.collect()} == {("r", None), ("u1", "r"), ("u2", "r"), ("u3", "r"), ("q", None), ("u4", "q")}
    assert {(r.node, r.survivor) for r in aliases.collect()} == {("a", "r"), ("b", "r"), ("c", "u3"), ("d", "u4")}


def test_running_totals_do_not_depend_on_partitions(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i, (i * 37) % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    want, acc = {}, {}
    for k, o, v in rows:
        acc[k] = acc.get(k, 0) + v
        want[k, o] = acc[k]
    for parts in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = running(df.repartition(parts), ["k"], ["o"], {"t": F.col("v")}).collect()
        assert {(r.k, r.o): r.t for r in got} == want
    assert [r.pos for r in positions(df, [], ["o"]).orderBy("o").collect()] == list(range(3000))


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 4, 9)], "k string, v long")
    assert quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()[1:] == (1.75, 3.0, 5.25)
