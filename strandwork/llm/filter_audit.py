"""How filters interact: what each removes, alone and behind the others, in every order.

1. **Decisions.** One pass over the texts gives each row the filters that it fails; whether
   a smaller id has the same text is found by a digest and its least id, joined back.
2. **Posting lists.** Failing rows are dealt by (part, range of row numbers).  Inside such a
   range each filter has a sorted list of failing rows; unions of filters come from galloping
   k-way merges of these lists, what a filter removes behind others is the difference of its
   list and their union, and the same lists cut with the labelled rows give what is lost.
3. **Sums.** The sizes of a range depend on its rows alone, so they add up over ranges; every
   order and step then reads the one size that belongs to its filter and those before it.

A range holds at most ``RANGE`` rows and a task one range at a time, so neither a source
nor a group of copies of any size meets in one place.

Cases: null texts are empty, a null part is the empty string, which is a part like others;
repeated rows are judged one by one; a null id has no smaller one and is no smaller one, and
has no label; ids labelled twice count as good (toxic) if any of their labels says so; an
empty table has no parts; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from bisect import bisect_left
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandwork.llm.texts import pieces
from strandwork.session import materialize

#: Row numbers of a range: what a task holds at once.
RANGE = 1 << 16
# The five filters and their limits.
LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
SIGNS = re.compile(r"[#$%&*|]")
NO_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def failing(text: str) -> int:
    """Bits of the filters A to D that a text fails; words are what blanks of ASCII set apart."""
    raw = text.encode()
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, NO_UPPER))
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * upper > UPPER_PERCENT * len(text)) << 2 | (SIGNS.search(text) is not None) << 3)


def decisions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(row, part, fails, good, toxic) of every document; ``fails`` has a bit for each of ``LETTERS``."""

    def run(batches):
        for own, texts in pieces(batches):
            digests = [hashlib.sha256(t.encode()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(digests, pa.binary()), pa.array(list(map(failing, texts)), pa.int32())],
                                             ["row", "key", "part", "digest", "fails"])

    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"),
                       F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("text"))
    # Written once, so that row numbers stay what they are.
    judged = materialize(read.mapInArrow(run, f"row long, key {kind}, part string, digest binary, fails int"))
    # Both lookups are tables of their own: a group of copies or a repeated id of any size is then a join that Spark can split.
    copied = materialize(judged.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    marked = materialize(labels.groupBy(F.col(key).alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    seen = judged.join(copied, "digest", "left").select(
        "row", "key", "part", (F.col("fails") + F.when(F.col("first") < F.col("key"), 1 << 4).otherwise(0)).alias("fails"))
    no = F.lit(False)
    return seen.join(marked, "key", "left").select("row", "part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def gallop(ids: list[int], bound: int, at: int) -> int:
    """The first place from ``at`` on with an id of at least ``bound``: steps double until they pass it, then halve."""
    step, last = 1, len(ids)
    while at + step < last and ids[at + step] < bound:
        at += step
        step *= 2
    return bisect_left(ids, bound, at, min(at + step, last))


def union(lists: list[list[int]]) -> list[int]:
    """Ids of any of the sorted lists: the run of the least head up to the next head is copied at once."""
    out: list[int] = []
    live = [[own[0], 0, own] for own in lists if own]
    while len(live) > 1:
        live.sort(key=itemgetter(0))
        head, at, own = live[0]
        bound = live[1][0]
        # An id that another list begins with is left to that list.
        end = gallop(own, bound, at) if head < bound else at + 1
        if head < bound:
            out += own[at:end]
        if end < len(own):
            live[0][:2] = own[end], end
        else:
            del live[0]
    for _, at, own in live:
        out += own[at:]
    return out


def difference(ids: list[int], others: list[int]) -> list[int]:
    """Ids that are not among the others; both lists are sorted, and each gallops to the head of the other."""
    out: list[int] = []
    i = j = 0
    while i < len(ids) and j < len(others):
        if ids[i] < others[j]:
            end = gallop(ids, others[j], i)
            out += ids[i:end]
            i = end
        elif ids[i] > others[j]:
            j = gallop(others, ids[i], j)
        else:
            i, j = i + 1, j + 1
    return out + ids[i:]


def steps_of(filters: int) -> list[tuple[int, int]]:
    """Every filter with every set of others before it, as (bits before, filter)."""
    return [(before, f) for before in range(1 << filters) for f in range(filters) if not before >> f & 1]


def sizes(rows, filters: int) -> np.ndarray:
    """Of one range, for each of ``steps_of``: failing, removed, removed so far, good ones lost, toxic ones lost."""
    rows = list(rows)
    every = [[[r for r, fails, *marks in rows if fails >> f & 1 and (not kind or marks[kind - 1])] for f in range(filters)] for kind in range(3)]
    before = [[union([own[f] for f in range(filters) if s >> f & 1]) for s in range(1 << filters)] for own in every]
    removed = [[len(difference(own[f], seen[s])) for s, f in steps_of(filters)] for own, seen in zip(every, before)]
    fails = [len(every[0][f]) for _, f in steps_of(filters)]
    gone = [len(before[0][s | 1 << f]) for s, f in steps_of(filters)]
    return np.array([fails, removed[0], gone, removed[1], removed[2]], np.int64).T


_SIZES = ["fails", "removed", "gone", "good_lost", "toxic_lost"]


def audit(decided: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step; ``decided`` is as ``decisions`` makes it, with a bit for each letter."""
    filters = len(letters)
    steps = steps_of(filters)

    def run(batches):
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        for part, own in itertools.groupby(rows, itemgetter(0)):
            total = np.zeros((len(steps), len(_SIZES)), np.int64)
            for _, block in itertools.groupby(own, itemgetter(1)):
                total += sizes((r[2:] for r in block), filters)
            columns = [pa.array([part] * len(steps)), *(pa.array(np.array(x, np.int32)) for x in zip(*steps)), *map(pa.array, total.T)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "before", "filter", *_SIZES])

    decided = materialize(decided)
    block = F.shiftright("row", RANGE.bit_length() - 1)
    listed = decided.where("fails > 0").select("part", block.alias("block"), "row", "fails", "good", "toxic").repartition("part", "block")
    found = listed.sortWithinPartitions("part", "block", "row").mapInArrow(
        run, "part string, before int, filter int, " + ", ".join(f"{c} long" for c in _SIZES))
    # Every part has every step, also those where nothing fails.
    every = F.explode(F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("filter")) for s, f in steps]))
    parts = decided.groupBy("part").agg(F.count("*").alias("rows")).select("part", "rows", every.alias("step")).select("part", "rows", "step.*")
    zero = F.lit(0).cast("long")
    summed = parts.select("*", *[zero.alias(c) for c in _SIZES]).unionByName(found.withColumn("rows", zero)).groupBy(
        "part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ("rows", *_SIZES)])
    # A filter has 2 ** (filters - 1) rows a part; each set before it stands in so many orders.
    own = Window.partitionBy("part", "filter")
    orders = F.element_at(F.array(*[F.lit(math.factorial(n) * math.factorial(filters - 1 - n)) for n in range(filters)]), F.bit_count("before").cast("int") + 1)
    alone = F.expr(f"before = {(1 << filters) - 1} - shiftleft(1, filter)")
    valued = summed.select("*", F.sum(F.when(alone, F.col("removed")).otherwise(0)).over(own).alias("unique_fails"),
                           F.sum(F.col("removed") * orders).over(own).alias("shapley"))
    ways = [("".join(letters[f] for f in way), k + 1, sum(1 << f for f in way[:k]), way[k])
            for way in itertools.permutations(range(filters)) for k in range(filters)]
    # As many rows as the filters have orders and steps.
    named = decided.sparkSession.createDataFrame(ways, "filter_order string, step int, before int, filter int")
    return valued.join(F.broadcast(named), ["before", "filter"]).select(
        "part", "filter_order", "step", (F.col("rows") - F.col("gone")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley")
