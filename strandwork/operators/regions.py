"""Contiguous region trees over ordered siblings: best interval splits, or even ones."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandwork.operators.order_stats import running
from strandwork.session import dealt, materialize, measured

# Fixed value: largest display group.
FAN_OUT = 6
# Points of a tile's side, and split candidates that are weighed at once.
TILE = 256
SPLITS = 1 << 20
# Items of a parent that is solved together with others of its size, and cells of the tables of such a block.
SMALL, CELLS = 64, 1 << 18
SMALL_ROW = "parent string, top double, spans array<struct<lo:bigint,hi:bigint,up_lo:bigint,up_hi:bigint>>"
TILE_ROW = "parent string, n long, p long, q long, cost binary, skew binary, held binary, left array<int>, top double"
PART = {"x": "bigint", "y": "bigint", "cost": "binary", "skew": "binary", "held": "binary", "prefix": "array<double>",
        "own": "array<struct<a:bigint,b:bigint,weight:double>>"}


def _descend(lo_ok: Column, n: Column, k: int, inside) -> Column:
    """Fold the even splits from (0, n) down, following the half that ``inside(lo, hi)`` accepts."""
    start = F.struct(F.lit(0).cast("bigint").alias("lo"), n.cast("bigint").alias("hi"), F.lit(False).alias("done"),
                     F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("path"))

    def step(s, _):
        size = s["hi"] - s["lo"]
        mid = s["lo"] + F.floor(size / 2).cast("bigint")
        left, right = inside(s["lo"], mid), inside(mid, s["hi"])
        stop = s["done"] | (size <= k) | ~(left | right)
        lo, hi = F.when(left, s["lo"]).otherwise(mid), F.when(left, mid).otherwise(s["hi"])
        grown = F.concat(s["path"], F.array(F.struct(lo.alias("lo"), hi.alias("hi"))))
        return F.struct(F.when(stop, s["lo"]).otherwise(lo).alias("lo"), F.when(stop, s["hi"]).otherwise(hi).alias("hi"),
                        stop.alias("done"), F.when(stop, s["path"]).otherwise(grown).alias("path"))

    depth = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int") + 1)
    return F.aggregate(depth, start, step)


def balanced_regions(sizes: DataFrame, items: DataFrame, k: int = FAN_OUT) -> DataFrame:
    """Intervals of the even region tree: (parent, lo, hi, up_lo, up_hi).

    Every item finds its own chain of intervals from its position alone, so one
    parent may hold any number of items.
    """
    walk = items.select("parent", "pos").join(dealt(sizes), "parent").select("parent", "n", _descend(
        F.lit(True), F.col("n"), k, lambda lo, hi: (F.col("pos") >= lo) & (F.col("pos") < hi)).alias("w"))
    chain = walk.select("parent", F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("n").cast("bigint").alias("hi"))), "w.path").alias("c"))
    step = chain.where(F.size("c") > 1).select("parent", F.explode(F.arrays_zip(
        F.slice("c", F.lit(2), F.size("c") - 1).alias("own"), F.slice("c", F.lit(1), F.size("c") - 1).alias("up"))).alias("s"))
    return step.select("parent", F.col("s.own.lo").alias("lo"), F.col("s.own.hi").alias("hi"),
                       F.col("s.up.lo").alias("up_lo"), F.col("s.up.hi").alias("up_hi")).distinct()


def balanced_cost(sizes: DataFrame, weights: DataFrame, k: int = FAN_OUT) -> DataFrame:
    """Each pair costs its weight times the size of the smallest interval that holds both ends."""
    met = weights.join(dealt(sizes), "parent").select("parent", "weight", _descend(
        F.lit(True), F.col("n"), k, lambda lo, hi: (F.col("a") >= lo) & (F.col("b") < hi)).alias("w"))
    return met.groupBy("parent").agg(F.sum(F.col("weight") * (F.col("w.hi") - F.col("w.lo"))).alias("cost"))


def best_intervals(n: int, pairs: list[tuple[int, int, float]], k: int, burdens: list[float] | None = None):
    """Cheapest binary interval tree over n items: (cost, [(lo, hi, up_lo, up_hi)]), the plain form of ``partition``.

    Spans are solved diagonal by diagonal, all spans of a length at once; a table is a
    list of diagonals, indexed by length and then by first item.  A span splits between
    a third and two thirds, ties going to the smaller burden difference, the more even
    split, the shorter left side.  What a cut of a span crosses is the weight inside the
    span less the weights inside its parts.
    """
    own = [np.zeros(max(0, n - m + 1)) for m in range(n + 1)]
    for a, b, w in pairs:
        # A pair counts first in the shortest span that holds it ...
        own[b - a + 1][a] += w
    held, load = [*own[:1], *own[1:2]], [np.zeros(n + 1), np.asarray(burdens if burdens is not None else np.zeros(n), float)]
    for m in range(2, n + 1):
        # ... and a span holds what its two shorter neighbours hold, less what both do, and its own.
        held.append(held[m - 1][:-1] + held[m - 1][1:] - held[m - 2][1:-1] + own[m])
        load.append(load[m - 1][:-1] + load[1][m - 1 :])
    cost, skew, left_size = [np.zeros(n + 1)], [np.zeros(n + 1)], [np.zeros(n + 1, int)]
    for m in range(1, n + 1):
        spans = n - m + 1
        if m <= k:
            cost.append(m * held[m])
            skew.append(np.zeros(spans))
            left_size.append(np.zeros(spans, int))
            continue
        sizes = np.arange((m + 2) // 3, 2 * m // 3 + 1)
        split = lambda table, join: np.stack([join(table[s][:spans], table[m - s][s : s + spans]) for s in sizes.tolist()])
        crossing = held[m] - split(held, np.add)
        total = split(cost, np.add) + m * crossing
        burden = split(skew, np.add) + split(load, lambda x, y: np.abs(x - y))
        keys = [np.broadcast_to(sizes[:, None], total.shape), np.broadcast_to(np.abs(m - 2 * sizes)[:, None], total.shape)]
        best = np.lexsort([*keys, *([burden] if burdens is not None else []), total], axis=0)[0]
        every = np.arange(spans)
        cost.append(total[best, every])
        skew.append(burden[best, every])
        left_size.append(sizes[best])
    todo, out = [(0, n)], []
    for lo, hi in todo:
        if hi - lo > k:
            mid = lo + int(left_size[hi - lo][lo])
            parts = [(lo, mid), (mid, hi)]
            todo.extend(parts)
            out.extend((*part, lo, hi) for part in parts)
    return (float(cost[n][0]) if n else 0.0), out


def split_blocks(p: int, q: int, side: int) -> tuple[int, int]:
    """First and last block of points in which spans from block p to block q can split.

    The split point nowhere falls as its span moves or grows to the right, so the two corners decide.
    """
    length = (q - p) * side
    return (p * side + (length + 2) // 3) // side, min(((p + 1) * side - 1 + 2 * length // 3) // side, q)


def solve_tile(p: int, q: int, n: int, k: int, side: int, own, near: dict, prefix: dict):
    """All spans from a point of block p to a point of block q: (cost, skew, held, left), each points x points.

    ``own`` lists the pairs (a, b, weight) with a in block p and b + 1 in block q; ``near``
    holds (cost, skew, held) of the tiles that ``needed`` names, ``prefix`` the burden
    before each point of the blocks used, or nothing where burdens do not count.
    Spans are taken by length, because short ones of a tile may be parts of long ones.
    """
    low, high = p * side, q * side
    rows, cols = min(side, n + 1 - low), min(side, n + 1 - high)
    held = np.zeros((rows, cols))
    for a, b, w in own:
        held[a - low, b + 1 - high] += w
    held = held[::-1].cumsum(axis=0)[::-1].cumsum(axis=1)
    # What the tile's own rows and columns do not cover lies in the tiles to its left and below.
    if (p, q - 1) in near:
        held += near[p, q - 1][2][:, -1:]
    if (p + 1, q) in near:
        held += near[p + 1, q][2][:1]
    if (p + 1, q - 1) in near:
        held -= near[p + 1, q - 1][2][0, -1]
    first, last = split_blocks(p, q, side)
    base, reach = first * side, min((last + 1) * side, n + 1) - first * side
    starts, ends = np.zeros((3, rows, reach)), np.zeros((3, reach, cols))
    for r in range(first, last + 1):
        at = slice(r * side - base, min((r + 1) * side, n + 1) - base)
        if p <= r < q:
            starts[:, :, at] = near[p, r]
        if p < r <= q:
            ends[:, at] = near[r, q]
        if r == q:
            starts[2][:, at] = held
        if r == p:
            ends[2][at] = held
    cost, skew, left = np.zeros((rows, cols)), np.zeros((rows, cols)), np.zeros((rows, cols), np.int32)
    middle = np.concatenate([prefix[r] for r in range(first, last + 1)]) if prefix else None
    for m in range(max(1, high - low - rows + 1), high + cols - low):
        lo = np.arange(max(low, high - m), min(low + rows, high + cols - m))
        i, j = lo - low, lo + m - high
        if m <= k:
            cost[i, j] = m * held[i, j]
        else:
            sizes = np.arange((m + 2) // 3, 2 * m // 3 + 1)[:, None]
            step = max(1, SPLITS // len(sizes))
            for at in range(0, len(lo), step):
                x, y = i[at : at + step], j[at : at + step]
                mid = lo[at : at + step] + sizes - base
                total = starts[0][x, mid] + ends[0][mid, y] + m * (held[x, y] - (starts[2][x, mid] + ends[2][mid, y]))
                best = total == total.min(axis=0)
                if middle is not None:
                    burden = starts[1][x, mid] + ends[1][mid, y] + np.abs(2 * middle[mid] - prefix[p][x] - prefix[q][y])
                    burden = np.where(best, burden, np.inf)
                    best = burden == burden.min(axis=0)
                pick = np.where(best, np.abs(m - 2 * sizes), m + 1).argmin(axis=0)
                every = np.arange(len(x))
                cost[x, y], left[x, y] = total[pick, every], sizes[pick, 0]
                if middle is not None:
                    skew[x, y] = burden[pick, every]
        if last == q:
            starts[0][i, lo + m - base], starts[1][i, lo + m - base] = cost[i, j], skew[i, j]
        if first == p:
            ends[0][lo - base, j], ends[1][lo - base, j] = cost[i, j], skew[i, j]
    return cost, skew, held, left


def needed(p: int, q: int, side: int) -> list[tuple[int, int]]:
    """The tiles that ``solve_tile`` reads: those that splits lead to, and the three beside it that hold weights."""
    first, last = split_blocks(p, q, side)
    of = {(p, r) for r in range(first, last + 1)} | {(r, q) for r in range(first, last + 1)}
    return sorted((x, y) for x, y in of | {(p, q - 1), (p + 1, q), (p + 1, q - 1)} if p <= x <= y <= q and (x, y) != (p, q))


def solve_alike(n: int, k: int, held: np.ndarray, prefix: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(cost, left) of all spans of many parents of n items, parents x points x points: ``solve_tile`` for parents of one tile.

    ``held`` has the weight of a pair (a, b) at (a, b + 1) and is summed in place; ``prefix`` is parents x points, or None
    where burdens do not count.
    """
    held[:] = held[:, ::-1].cumsum(axis=1)[:, ::-1].cumsum(axis=2)
    cost, left = np.zeros(held.shape), np.zeros(held.shape, np.int32)
    skew = np.zeros(held.shape) if prefix is not None else None
    for m in range(1, n + 1):
        lo = np.arange(n + 1 - m)
        hi = lo + m
        if m <= k:
            cost[:, lo, hi] = m * held[:, lo, hi]
            continue
        sizes = np.arange((m + 2) // 3, 2 * m // 3 + 1)[:, None]
        mid = lo + sizes
        total = cost[:, lo, mid] + cost[:, mid, hi] + m * (held[:, None, lo, hi] - (held[:, lo, mid] + held[:, mid, hi]))
        best = total == total.min(axis=1, keepdims=True)
        if prefix is not None:
            burden = skew[:, lo, mid] + skew[:, mid, hi] + np.abs(2 * prefix[:, mid] - prefix[:, None, lo] - prefix[:, None, hi])
            best &= burden == np.where(best, burden, np.inf).min(axis=1, keepdims=True)
        pick = np.where(best, np.abs(m - 2 * sizes), m + 1).argmin(axis=1)
        chosen = lambda table: np.take_along_axis(table, pick[:, None], axis=1)[:, 0]
        cost[:, lo, hi], left[:, lo, hi] = chosen(total), sizes[pick, 0]
        if prefix is not None:
            skew[:, lo, hi] = chosen(burden)
    return cost, left


def _solve_small(plan: DataFrame, own: DataFrame, prefix: DataFrame | None, k: int) -> DataFrame:
    """(parent, top, spans) of parents of one tile: as many as share a size and fit a block are solved by one call."""
    rows = plan.select("parent", "n").join(dealt(own.where("p = 0 AND q = 0").select("parent", "own")), "parent", "left")
    rows = rows.withColumn("prefix", F.lit(None).cast("array<double>")) if prefix is None else rows.join(
        dealt(prefix.where("x = 0").select("parent", "prefix")), "parent", "left")

    def job(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            loaded = batch.column("prefix").is_valid().to_numpy(zero_copy_only=False)
            pairs = batch.column("own")
            many = np.asarray(pairs.value_lengths().fill_null(0))
            first = np.cumsum(many) - many
            a, b, weight = (np.asarray(pairs.flatten().field(f)) for f in ("a", "b", "weight"))
            for size, burdened in sorted(set(zip(n.tolist(), loaded.tolist()))):
                alike = np.flatnonzero((n == size) & (loaded == burdened))
                step = max(1, CELLS // (size + 1) ** 2)
                for at in range(0, len(alike), step):
                    block = alike[at : at + step]
                    held = np.zeros((len(block), size + 1, size + 1))
                    of = np.repeat(np.arange(len(block)), many[block])
                    pick = np.concatenate([np.arange(first[r], first[r] + many[r]) for r in block])
                    np.add.at(held, (of, a[pick], b[pick] + 1), weight[pick])
                    before = np.stack([batch.column("prefix")[r].values.to_numpy() for r in block.tolist()]) if burdened else None
                    cost, left = solve_alike(size, k, held, before)
                    spans = [[dict(zip(("lo", "hi", "up_lo", "up_hi"), s)) for s in _below(left[i], [(0, size)], k)] for i in range(len(block))]
                    yield pa.RecordBatch.from_arrays([
                        batch.column("parent").take(pa.array(block)), pa.array(cost[:, 0, size]),
                        pa.array(spans, pa.list_(pa.struct([(f, pa.int64()) for f in ("lo", "hi", "up_lo", "up_hi")])))], ["parent", "top", "spans"])

    # Little input can be much work, as in a round of tiles.
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartition(tasks, "parent").mapInArrow(job, SMALL_ROW))


def _below(left: np.ndarray, todo: list[tuple[int, int]], k: int, low: int = 0) -> list[tuple[int, int, int, int]]:
    """(lo, hi, up_lo, up_hi) below the spans of ``todo``, whose left sizes are told by points from ``low`` on."""
    out = []
    for lo, hi in todo:
        if hi - lo > k:
            mid = lo + int(left[lo - low, hi - low])
            todo += [(lo, mid), (mid, hi)]
            out += [(lo, mid, lo, hi), (mid, hi, lo, hi)]
    return out


def _tile_round(plan: DataFrame, distance: int, own: DataFrame, prefix: DataFrame | None, done: list[DataFrame], k: int, side: int) -> DataFrame:
    """All tiles whose blocks are ``distance`` apart, from the rounds before."""
    keys = ["parent", "p", "q"]
    spans = plan.where(F.col("last") >= distance).select("parent", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last") - distance)).alias("p"))
    spans = spans.withColumn("q", F.col("p") + distance)
    # Tiles of equal distance need the same tiles, moved by p.
    near, (first, last) = needed(0, distance, side), split_blocks(0, distance, side)
    none = lambda t: F.lit(None).cast(t)
    part = lambda df, **c: df.select(*keys, "n", *[c.get(f, none(t)).alias(f) for f, t in PART.items()])
    parts = part(spans.join(dealt(own), keys, "left"), own=F.col("own"))
    if near:
        wanted = spans.select(*keys, "n", F.explode(F.array(*[F.struct((F.col("p") + x).alias("x"), (F.col("p") + y).alias("y")) for x, y in near])).alias("t"))
        wanted = wanted.select(*keys, "n", "t.x", "t.y")
        tiles = functools.reduce(DataFrame.unionAll, [done[g].select("parent", F.col("p").alias("x"), F.col("q").alias("y"), "cost", "skew", "held")
                                                      for g in sorted({y - x for x, y in near})])
        parts = parts.unionAll(part(wanted.join(dealt(tiles), ["parent", "x", "y"]), **{f: F.col(f) for f in ("x", "y", "cost", "skew", "held")}))
    if prefix is not None:
        blocks = sorted({0, distance, *range(first, last + 1)})
        asked = spans.select(*keys, "n", F.explode(F.array(*[F.col("p") + b for b in blocks])).alias("x"))
        parts = parts.unionAll(part(asked.join(dealt(prefix), ["parent", "x"]), x=F.col("x"), prefix=F.col("prefix")))

    def job(key, rows: pd.DataFrame) -> pd.DataFrame:
        parent, p, q = key
        n = int(rows["n"].iloc[0])
        wide = lambda b: min(side, n + 1 - b * side)
        tiles, before, pairs = {}, {}, []
        for r in rows.itertuples(index=False):
            if r.held is not None:
                tiles[int(r.x), int(r.y)] = np.stack([np.frombuffer(v).reshape(wide(int(r.x)), wide(int(r.y))) for v in (r.cost, r.skew, r.held)])
            elif r.prefix is not None:
                before[int(r.x)] = np.asarray(r.prefix, float)
            elif r.own is not None:
                pairs = [(o["a"], o["b"], o["weight"]) for o in r.own]
        cost, skew, held, left = solve_tile(int(p), int(q), n, k, side, pairs, tiles, before)
        top = cost[0, n - q * side] if p == 0 and q == n // side else None
        return pd.DataFrame([(parent, n, p, q, cost.tobytes(), skew.tobytes(), held.tobytes(), left.ravel(), top)],
                            columns=["parent", "n", "p", "q", "cost", "skew", "held", "left", "top"])

    # Little input can be much work: as many tasks as the session shuffles into, not as few as the bytes would fill.
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(parts.repartition(tasks, *keys).groupBy(*keys).applyInPandas(job, TILE_ROW))


def _descend_tiles(plan: DataFrame, rounds: list[DataFrame], k: int, side: int) -> DataFrame:
    """The chosen intervals below (0, n): level by level across tiles, and in one task a tile for what lies inside one."""
    block = lambda c: F.floor(F.col(c) / side).cast("bigint")
    empty = "parent string, lo long, hi long, up_lo long, up_hi long"
    level = plan.where(F.col("n") > k).select("parent", F.lit(0).cast("bigint").alias("lo"), F.col("n").alias("hi"))
    crossing = lambda: (F.col("hi") - F.col("lo") > k) & (block("lo") < block("hi"))
    found, inside = [], [level.where(~crossing())]
    across = [t.select("parent", "n", "p", "q", "left") for t in rounds[1:]]
    level, go_on = level.where(crossing()), bool(across)
    while go_on:
        tiles = functools.reduce(DataFrame.unionAll, across)
        place = (F.col("lo") - F.col("p") * side) * F.least(F.lit(side), F.col("n") + 1 - F.col("q") * side) + F.col("hi") - F.col("q") * side
        cut = level.withColumn("p", block("lo")).withColumn("q", block("hi")).join(dealt(tiles), ["parent", "p", "q"])
        cut = cut.select("parent", "lo", "hi", (F.col("lo") + F.element_at("left", (place + 1).cast("int"))).alias("mid"))
        halves = F.array(*[F.struct(F.col(a).alias("lo"), F.col(b).alias("hi")) for a, b in (("lo", "mid"), ("mid", "hi"))])
        halves = cut.select("parent", F.explode(halves).alias("s"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"))
        halves, seen = measured(halves.select("parent", "s.lo", "s.hi", "up_lo", "up_hi"), open=F.count_if(crossing()))
        found.append(halves)
        inside.append(halves.where((F.col("hi") - F.col("lo") > k) & ~crossing()).select("parent", "lo", "hi"))
        level, go_on = halves.where(crossing()).select("parent", "lo", "hi"), seen["open"] > 0
    whole = functools.reduce(DataFrame.unionAll, inside).groupBy("parent", block("lo").alias("p")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def job(key, rows: pd.DataFrame) -> pd.DataFrame:
        n, p, row = int(rows["n"].iloc[0]), int(key[1]), rows.iloc[0]
        left = np.asarray(row["left"]).reshape(-1, min(side, n + 1 - p * side))
        found = _below(left, [(s["lo"], s["hi"]) for s in row["spans"]], k, p * side)
        return pd.DataFrame([(key[0], *s) for s in found], columns=["parent", "lo", "hi", "up_lo", "up_hi"])

    below = whole.join(dealt(rounds[0].select("parent", "p", "n", "left")), ["parent", "p"]).groupBy("parent", "p").applyInPandas(job, empty)
    return materialize(functools.reduce(DataFrame.unionAll, [below, *found]))


def partition(order: DataFrame, weights: DataFrame, k: int = FAN_OUT, algorithm: str = "ordered_dp",
              burdens: DataFrame | None = None, side: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Region intervals and (parent, algorithm, cost) for every parent.

    ``order(parent, atom, pos)`` with positions from 0 without gaps, ``weights(parent, a, b,
    weight)`` with positions a < b, repeated pairs adding up.  The caller names the
    algorithm, whatever the sizes: ``ordered_dp`` is the best tree, ``balanced`` the even
    one, computed item by item.  ``burdens(parent, pos, burden)`` is used only where no
    burden is null.

    The best tree is solved over tables for parents of every size: the spans between two
    blocks of ``side`` points are a tile, tiles of blocks equally far apart are a round,
    and a tile's task reads only the tiles that its splits can lead to, a third of a row
    and of a column.  A parent below ``side`` points is one tile; parents of at most ``SMALL``
    items are solved by the block of equal sizes, not by one call each.
    """
    if algorithm not in ("ordered_dp", "balanced"):
        raise ValueError(f"unknown algorithm: {algorithm}")
    plan = order.groupBy("parent").agg(F.count("*").alias("n")).withColumn("algorithm", F.lit(algorithm))
    alone = (F.col("n") > SMALL) | (F.col("n") >= side)
    plan, seen = measured(plan.withColumn("last", F.floor(F.col("n") / side).cast("bigint")), last=F.max(F.floor(F.col("n") / side)), alone=F.count_if(alone))
    if algorithm == "balanced":
        cost = balanced_cost(plan.select("parent", "n"), weights, k)
        return balanced_regions(plan.select("parent", "n"), order, k), plan.join(dealt(cost), "parent", "left").select(
            "parent", "n", "algorithm", F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"))
    block = lambda c: F.floor(c / side).cast("bigint")
    pairs = weights.join(dealt(plan.select("parent")), "parent", "left_semi").groupBy(
        "parent", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    own = materialize(pairs.groupBy("parent", block(F.col("a")).alias("p"), block(F.col("b") + 1).alias("q")).agg(
        F.sort_array(F.collect_list(F.struct("a", "b", "weight"))).alias("own")))
    before = None
    if burdens is not None:
        load = materialize(order.join(dealt(burdens), ["parent", "pos"], "left").select("parent", "pos", F.col("burden").cast("double").alias("burden")))
        load = load.join(dealt(load.where("burden IS NULL").select("parent")), "parent", "left_anti")
        points = running(load, ["parent"], ["pos"], {"before": F.col("burden")}).select("parent", (F.col("pos") + 1).cast("bigint").alias("point"), "before")
        points = points.unionAll(points.select("parent").distinct().select("parent", F.lit(0).cast("bigint"), F.lit(0.0)))
        before = materialize(points.groupBy("parent", block(F.col("point")).alias("x")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("point", "before"))), lambda s: s["before"]).alias("prefix")))
    small = _solve_small(plan.where(~alone), own, before, k)
    top, spans = [small.select("parent", "top")], small.select("parent", F.explode("spans").alias("s")).select("parent", "s.*")
    if seen["alone"]:
        rounds: list[DataFrame] = []
        large = plan.where(alone)
        for distance in range(int(seen["last"]) + 1):
            rounds.append(_tile_round(large, distance, own, before, rounds, k, side))
        top += [t.where("top IS NOT NULL").select("parent", "top") for t in rounds]
        spans = spans.unionAll(_descend_tiles(large, rounds, k, side))
    top = functools.reduce(DataFrame.unionAll, top)
    return spans, plan.join(dealt(top), "parent", "left").select(
        "parent", "n", "algorithm", F.coalesce("top", F.lit(0.0)).alias("cost"))
