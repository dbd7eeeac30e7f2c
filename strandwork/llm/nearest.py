"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector, padded to a power of two, is turned by three rounds of random signs and
a fast Hadamard transform; its bucket in a table is the signed axis that it lies next
to.  A query looks into the ``PROBES`` nearest axes of each of ``TABLES`` tables.  What shares
a bucket is scored exactly and each bucket hands on the best of each query only.

Vectors of other lengths than 64 take a number of probes in proportion to their axes.  Queries
whose buckets hold fewer than ``k`` answers are held against all rows of their length, in
blocks.  Recall is measured on ``RECALL_SAMPLE`` queries in the same way each time; if it is
below ``LEAST_RECALL``, every query is scanned so.

Buckets are dealt into chunks by a hash of the id, so many that a bucket of mean size has
``CHUNK`` rows a chunk; a bucket with a third of all rows then has chunks some forty times
larger, which is still bounded.  Equal vectors are one candidate with its smallest ids,
as many as an answer can show, and one query.

With one axis a table, a query meets a fixed share of all rows, which is what vectors
without any structure need for their neighbours (their nearest are hardly nearer than
the rest).  ``axes`` concatenates several axes to a bucket for vectors that do cluster.

Scores are cosines in double precision of the original vectors, summed in one order for
every pair.  Cases: null ids and vectors, zero vectors, and vectors with null or
non-finite components take no part; vectors meet others of their length only; equal
rows count once; a row is no neighbour of rows of its own id; ties go to the smaller id; with
fewer than ``k`` candidates a query gets them all, and none if it is alone; other columns are not
read, whatever their names; an empty table has no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandwork.session import materialize

TABLES, PROBES, CHUNK = 10, 10, 4096
#: Signed axes of 64 dimensions, which ``PROBES`` is meant for; longer vectors take as many more probes as they have more axes.
PROBED_AXES = 128
#: Distinct queries that recall is measured on, and what it has to be; below it all queries are held against all rows.
RECALL_SAMPLE, LEAST_RECALL = 64, 0.9
#: Vectors hashed at once in a task.
BLOCK = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of every row."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        half *= 2
    return x / math.sqrt(n)


@functools.cache
def signs(size: int, table: int, axis: int) -> np.ndarray:
    return np.random.default_rng([size, table, axis]).choice([-1.0, 1.0], (3, size))


def turned(x: np.ndarray, table: int, axis: int) -> np.ndarray:
    """Signed axes of every row: (row, 2 * size) closeness to each."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for s in signs(size, table, axis):
        y = hadamard(y * s)
    return np.concatenate([y, -y], 1)


def buckets(x: np.ndarray, table: int, axes: int, probes: int) -> np.ndarray:
    """The ``probes`` most promising buckets of each row, the best first: the nearest axes, combined by their sum of closeness."""
    number, gain = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for axis in range(axes):
        close = turned(x, table, axis)
        keep = min(probes, close.shape[1])
        best = np.argsort(-close, 1, kind="stable")[:, :keep]
        gain = (gain[:, :, None] + np.take_along_axis(close, best, 1)[:, None, :]).reshape(len(x), -1)
        number = (number[:, :, None] * close.shape[1] + best[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-gain, 1, kind="stable")[:, :probes]
        gain, number = np.take_along_axis(gain, order, 1), np.take_along_axis(number, order, 1)
    return number


def probes_for(size: int, probes: int) -> int:
    """The same share of buckets for every length of vectors."""
    return max(probes, math.ceil(probes * (2 << max(1, (size - 1).bit_length())) / PROBED_AXES))


def _hashed(rows: DataFrame, tables: int, axes: int, probes) -> DataFrame:
    """(size, table, bucket, node, vector) for each probed bucket of each row of ``rows(node, vector)``; ``probes`` by length."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                vectors = part.column(1)
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == size)
                    mine = part.take(pa.array(own))
                    x = mine.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), size)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for table in range(tables):
                        found = buckets(x, table, axes, probes(size))
                        again = mine.take(pa.array(np.repeat(np.arange(len(own)), found.shape[1])))
                        n = again.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, table, np.int32)), pa.array(found.reshape(-1)),
                             again.column(0), again.column(1)], ["size", "table", "bucket", "node", "vector"])

    schema = f"size int, table int, bucket long, node {rows.schema['node'].dataType.simpleString()}, vector {rows.schema['vector'].dataType.simpleString()}"
    return rows.select("node", "vector").mapInArrow(run, schema)


def _best(k: int):
    def run(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("asks").to_pylist(), bool)
        size = group.column("size")[0].as_py()
        x = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        nodes = group.column("node").combine_chunks()
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(c):
            first = np.array(nodes.take(pa.array(c)).field("id").to_pylist(), np.int64)
            norm = np.sqrt((x * x).sum(1))
            unit = x / norm[:, None]
            for at in range(0, len(q), 256):
                rough = unit[q[at : at + 256]] @ unit[c].T
                for i, row in zip(q[at : at + 256], rough):
                    floor = np.partition(row, -k)[-k] - 1e-9 if len(row) > k else -np.inf
                    near = np.flatnonzero(row >= floor)
                    exact = (x[i] * x[c[near]]).sum(1) / (norm[i] * norm[c[near]])
                    order = np.lexsort((first[near], -exact))[:k]
                    pairs.append((np.full(len(order), i), c[near[order]], exact[order]))
        ask = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        got = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
        score = np.concatenate([p[2] for p in pairs]) if pairs else np.zeros(0)
        return pa.table([nodes.take(pa.array(ask)), nodes.take(pa.array(got)), pa.array(score)], ["ask", "got", "score"])

    return run


def search(rows: DataFrame, asks, k: int = 5, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES,
           probes: int = PROBES, axes: int = 1, least_recall: float = LEAST_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``asks(key column)`` is true."""
    sound = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    valid = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector")).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull()).where(sound)
    # An answer shows k ids of a vector at most, after the query's own is left out; Spark limits each partition before the shuffle.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    kept = materialize(valid.distinct().withColumn("place", place).where(F.col("place") <= k + 1))
    # A distinct vector is named by its least id and its hash.
    named = kept.withColumn("node", F.struct("id", F.xxhash64("vector").alias("hash")))
    singles = named.where("place = 1").select("node", "vector", F.size("vector").alias("size"))
    queries = valid.where(asks(F.col("id"))).distinct()
    distinct = queries.groupBy("vector").agg(F.struct(F.min("id").alias("id"), F.first(F.xxhash64("vector")).alias("hash")).alias("node"))
    distinct = materialize(distinct.select("node", "vector", F.size("vector").alias("size")))
    lengths = materialize(singles.groupBy("size").agg(F.count("*").alias("n")))
    members = materialize(named.join(singles.select("vector", F.col("node").alias("got")), "vector").select("got", F.col("id").alias("found_id")))
    found = materialize(_probed(singles, distinct, lengths, k, tables, probes, axes))
    # Queries that the tables gave too few ids (their own counts as one), and a fixed sample, are held against all rows of their length.
    ids = found.join(members.groupBy("got").agg(F.count("*").alias("ids")), "got").groupBy("ask").agg(F.sum("ids").alias("ids"))
    told = distinct.select(F.col("node").alias("ask"), "vector", "size").join(ids, "ask", "left")
    sample = told.orderBy(F.xxhash64("ask", F.lit("recall")), "ask").limit(RECALL_SAMPLE).select("ask")
    few = told.where(F.coalesce("ids", F.lit(0)) < k + 1).select("ask")
    again = materialize(distinct.join(few.unionAll(sample).distinct().withColumnRenamed("ask", "node"), "node", "left_semi"))
    exact = materialize(_scanned(singles, again, lengths, k))
    seen = exact.join(sample, "ask", "left_semi").join(found.select("ask", "got", F.lit(1).alias("hit")), ["ask", "got"], "left").agg(
        F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    if seen["hits"] < least_recall * seen["n"]:
        found = _scanned(singles, distinct, lengths, k)
    else:
        found = found.join(again.select(F.col("node").alias("ask")), "ask", "left_anti").unionByName(exact)
    # Back to ids: every id of a found vector, then every query of a vector.
    rows_found = found.join(members, "got").select("ask", "found_id", "score")
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "found_id")
    rows_found = rows_found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("ask", "found_id", "score")
    askers = queries.join(distinct.select("vector", F.col("node").alias("ask")), "vector").select("ask", F.col("id").alias("query_id"))
    answer = askers.join(rows_found, "ask").where("query_id <> found_id")
    ranked = answer.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "found_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("found_id").alias("vec_id"), "score")


def _met(index: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(ask, got, score): the best ``k + 1`` of each asking row over all groups of (size, table, bucket, chunk) that it is in."""
    columns = ["size", "table", "bucket", "chunk", "node", "vector"]
    both = index.select(*columns, F.lit(False).alias("asks")).unionByName(asking.select(*columns, F.lit(True).alias("asks")))
    node = both.schema["node"].dataType.simpleString()
    found = both.groupBy("size", "table", "bucket", "chunk").applyInArrow(_best(k + 1), f"ask {node}, got {node}, score double")
    per_vector = Window.partitionBy("ask").orderBy(F.desc("score"), "got")
    return found.groupBy("ask", "got").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(per_vector)).where(
        F.col("r") <= k + 1).select("ask", "got", "score")


def _probed(singles: DataFrame, distinct: DataFrame, lengths: DataFrame, k: int, tables: int, probes: int, axes: int) -> DataFrame:
    """What shares a probed bucket; a bucket of mean size has ``CHUNK`` rows a chunk."""
    # Signed axes of a length: twice the next power of two.
    around = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("size", F.lit(2)))) + 1)
    dealt = lengths.select("size", F.greatest(F.lit(1), F.ceil(F.col("n") / F.pow(around, F.lit(axes)) / CHUNK)).cast("int").alias("chunks"))
    index = _hashed(singles, tables, axes, lambda size: 1).join(dealt, "size").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    asking = _hashed(distinct, tables, axes, lambda size: probes_for(size, probes)).join(dealt, "size").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return _met(index, asking, k)


def _scanned(singles: DataFrame, asking: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """The same against every row of the asking row's length, in blocks of ``CHUNK``."""
    dealt = lengths.select("size", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), F.lit(-1).alias("table"), F.lit(0).cast("long").alias("bucket"))
    index = singles.join(dealt, "size").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    return _met(index, asking.join(dealt, "size").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))), k)
