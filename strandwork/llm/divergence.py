"""How the word use of the sources of a language diverges, exactly, by one-hot level products.

1. **Counts.** One pass over the texts counts terms per (language, source), a bounded number of
   them in a task at a time; one shuffle by (language, term) adds them up and keeps the
   terms of enough documents.
2. **Directory.** The kept terms V of each language, the total N of each group and of each
   language; a share of a term depends on its count (its level) and on these alone.
3. **Pairs.** Terms are dealt by hash into blocks, sources into blocks of ``SOURCES``.  A task
   takes one block of terms for two blocks of sources: indicator columns for each (source,
   level) that occurs, times their transpose, are the joint tables of levels of all pairs of
   sources at once.  Each cell is priced once and multiplied by the terms in it; sums over
   blocks are whole numbers.  Products are split until their columns are ``COLUMNS`` at most.
4. **Terms.** Each count is priced against its language, and a ranked window keeps the first
   ``TOP`` of every group.

All arithmetic is in whole numbers: decimals and longs in Spark, 64-bit integers in the tasks,
and Python's own where counts are too large for them; the products count at most ``SLAB`` terms,
which single precision holds exactly.

Cases: null texts, languages and sources are empty strings, which are groups like others; groups
without kept terms price as if every count were 0; a language with one source has no pairs;
repeated rows count as documents of their own; an empty table has no rows; other columns, of
whatever name, are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandwork.llm.texts import pieces
from strandwork.session import materialize

LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Different (language, source, term) that a task counts before it hands them on.
COUNTED = 400_000
#: Terms of a block, sources of a block, and of one product the terms and the indicator columns.
TERMS, SOURCES, SLAB, COLUMNS = 4096, 64, 1024, 1024
# Fixed value: what makes a term, as a table from UTF-8 bytes to lower-case term bytes or blanks.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up as far as a task has seen them."""
    shape = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        seen: dict[tuple, dict[bytes, list[int]]] = defaultdict(dict)
        held = 0

        def told():
            for (a, b), own in seen.items():
                n, d = zip(*own.values())
                words = [w.decode() for w in own]
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(words)), pa.array([b] * len(words)), pa.array(words), pa.array(n, pa.int64()),
                                                  pa.array(d, pa.int64())], schema=shape)
            seen.clear()

        for part, texts in pieces(batches):
            for group, t in zip(zip(part.column(0).to_pylist(), part.column(1).to_pylist()), texts):
                words = Counter(terms(t))
                if not words:
                    continue
                own = seen[group]
                held -= len(own)
                for word, n in words.items():
                    if (known := own.get(word)) is None:
                        own[word] = [n, 1]
                    else:
                        known[0] += n
                        known[1] += 1
                held += len(own)
            if held > COUNTED:
                yield from told()
                held = 0
        yield from told()

    return _groups(docs, lang, source, text).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _groups(docs: DataFrame, lang: str, source: str, *more: str) -> DataFrame:
    empty = F.lit("")
    return docs.select(F.coalesce(F.col(f"`{lang}`"), empty).alias("lang"), F.coalesce(F.col(f"`{source}`"), empty).alias("source"),
                       *[F.col(f"`{c}`").alias(c) for c in more])


def kept_counts(counted: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, whole, first): counts of kept terms, their count in the language, and a mark on one row of each term.

    A term has at most one row for each source of its language when it meets in a task.
    """
    # Dealt by language and term at once, so that the sums and the windows over a term need no further shuffle.
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return summed.select("lang", "source", "term", "n", F.sum("n").over(term).alias("whole"), F.sum("docs").over(term).alias("in_docs"),
                         (F.col("source") == F.min("source").over(term)).alias("first")).where(F.col("in_docs") >= least_docs).drop("in_docs")


def directory(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, total, whole_total, terms, sources) of every group that occurs, with or without terms."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    own, zero = Window.partitionBy("lang"), F.lit(0).cast("long")
    return _groups(docs, lang, source).distinct().join(totals, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce(F.sum("total").over(own), zero).alias("whole_total"),
        F.coalesce(F.sum("firsts").over(own), zero).alias("terms"), F.count("*").over(own).alias("sources"))


def share(count: str, total: str) -> str:
    """1 + floor(SCALE * (count + 1) / (total + V)), exactly, as SQL."""
    return f"(1 + (CAST({SCALE} AS DECIMAL(10, 0)) * ({count} + 1)) DIV ({total} + terms))"


def term_part(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): terms that a source uses more than its language does."""
    priced = kept.join(groups, ["lang", "source"]).selectExpr(
        "lang", "source", "term AS item", f"{share('n', 'total')} AS p", f"{share('whole', 'whole_total')} AS q").where("p > q").selectExpr(
        "lang", "source", "item", "((p - q) * (p - q)) DIV q AS value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return priced.withColumn("rank", rank).where(F.col("rank") <= top)


def shares(levels: np.ndarray, denominators: np.ndarray) -> np.ndarray:
    """The same in a task: 64-bit where that is exact, else Python's whole numbers (which fit again after the division)."""
    if len(levels) and int(levels.max()) + 1 > (2**63 - 1) // SCALE:
        return np.array([1 + SCALE * (int(c) + 1) // int(d) for c, d in zip(levels, denominators)], np.int64)
    return 1 + SCALE * (levels + 1) // denominators


def products(counts: np.ndarray):
    """Joint tables of the levels of all sources over the rows of ``counts`` (terms by sources), in exact blocked products.

    Yields (sources of the columns, levels of the columns, joint counts); the columns are those (source, level) that
    occur in a slab of terms, which is halved while they are too many.
    """
    order = np.argsort(counts.sum(1), kind="stable")
    slabs = [counts[order[i : i + SLAB]] for i in range(0, len(order), SLAB)]
    while slabs:
        slab = slabs.pop()
        source = np.broadcast_to(np.arange(slab.shape[1]), slab.shape)
        # Columns by source and level: the level numbered among all levels of the slab.
        levels, at = np.unique(slab, return_inverse=True)
        columns, at = np.unique(source * len(levels) + at.reshape(slab.shape), return_inverse=True)
        if len(columns) > COLUMNS and len(slab) > 1:
            slabs += [slab[: len(slab) // 2], slab[len(slab) // 2 :]]
            continue
        hot = np.zeros((len(slab), len(columns)), np.float32)
        hot[np.arange(len(slab))[:, None], at.reshape(slab.shape)] = 1
        yield columns // len(levels), levels[columns % len(levels)], hot.T @ hot


def priced(counts: np.ndarray, denominators: np.ndarray) -> np.ndarray:
    """Sum of floor((p - q)^2 / q) over the terms, for every two sources (p of the row, q of the column)."""
    out = np.zeros((counts.shape[1], counts.shape[1]), np.int64)
    for source, level, joint in products(counts):
        p = shares(level, denominators[source])
        a, b = np.nonzero(joint)
        gap = p[a] - p[b]
        np.add.at(out, (source[a], source[b]), gap * gap // p[b] * joint[a, b].astype(np.int64))
    return out


_BLOCK = ["lang", "terms_of", "left", "right"]


def _pair_block(counted: pa.Table, groups: pa.Table) -> pa.Table:
    """One block of terms for two blocks of sources: partial values of their pairs."""
    names = groups.column("source").to_pylist()
    side = groups.column("side").to_numpy()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = {names[i]: k for k, i in enumerate(order)}
    side = side[order]
    denominators = groups.column("denominator").to_numpy()[order]
    words = counted.column("term").combine_chunks().dictionary_encode() if counted.num_rows else None
    counts = np.zeros((len(words.dictionary) if words is not None else 0, len(order)), np.int64)
    if words is not None:
        at = [place[s] for s in counted.column("source").to_pylist()]
        counts[words.indices.to_numpy(), at] = counted.column("n").to_numpy()
    value = priced(counts, denominators)
    left, right = groups.column("left")[0].as_py(), groups.column("right")[0].as_py()
    # Of a block with itself all pairs; of two blocks those from one to the other, both ways.
    a, b = np.nonzero((side[:, None] != side[None, :]) if left != right else ~np.eye(len(order), dtype=bool))
    label = [names[i] for i in order]
    return pa.table({"lang": pa.array([groups.column("lang")[0].as_py()] * len(a), pa.string()), "source": pa.array([label[i] for i in a], pa.string()),
                     "item": pa.array([label[i] for i in b], pa.string()), "value": pa.array(value[a, b]),
                     "seen": pa.array(np.full(len(a), len(counts), np.int64))})


def pair_part(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): how far each other source of the language is from a source."""
    # Blocks by size alone: terms and sources of a language of any size are spread over tasks.
    sized = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS))).withColumn(
        "bands", F.ceil(F.col("sources") / SOURCES)).withColumn("side", F.pmod(F.xxhash64("source"), F.col("bands"))).withColumn(
        "denominator", F.greatest(F.lit(1), F.col("total") + F.col("terms")))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bands") - 1)).alias("partner")

    def paired(df):
        return df.withColumns({"left": F.least("side", "partner"), "right": F.greatest("side", "partner")}).drop("partner")

    listed = paired(sized.select("*", partner)).select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("terms_of"), "left", "right", "side", "source", "denominator")
    counted = paired(kept.select("lang", "source", "term", "n").join(sized.select("lang", "source", "blocks", "bands", "side"), ["lang", "source"]).select(
        "lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("terms_of"), "side", partner)).select(
        *_BLOCK, "source", "term", "n")
    partial = counted.groupBy(*_BLOCK).cogroup(listed.groupBy(*_BLOCK)).applyInArrow(
        _pair_block, "lang string, source string, item string, value long, seen long")
    summed = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # Terms that neither block of sources has: count 0 on both sides.
    nothing = groups.selectExpr("lang", "source", "terms", f"IF(terms = 0, 0, {share('0', 'total')}) AS p")
    other = nothing.select("lang", F.col("source").alias("item"), F.col("p").alias("q"))
    whole = summed.join(nothing, ["lang", "source"]).join(other, ["lang", "item"]).selectExpr(
        "lang", "source", "item", "IF(terms = 0, 0, value + (terms - seen) * (((p - q) * (p - q)) DIV q)) AS value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return whole.withColumn("rank", rank)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    kept = materialize(kept_counts(term_counts(docs, text, lang, source), least_docs))
    groups = materialize(directory(docs, kept, lang, source))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair_part(kept, groups).withColumn("part", F.lit("pair")).select(columns).unionByName(
        term_part(kept, groups, top).withColumn("part", F.lit("term")).select(columns))
