"""The fact tables, derived from the star-schema and text tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandwork.session import dealt

#: Line numbers of an order that are joined with their neighbours together.
LINES_TOGETHER = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def repos(spark: SparkSession, folder: str) -> DataFrame:
    region = table(spark, folder, "region")
    return region.select(
        F.col("r_name").alias("repo_key"),
        F.concat(F.lit("r:"), F.col("r_regionkey")).alias("root_scope"),
    )


def homes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per supplier with the nation and region above it."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return (
        table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("s_name").alias("module"), F.col("r_name").alias("repo_key"),
                "n_nationkey", "n_name", "r_regionkey")
    )


def scopes(spark: SparkSession, folder: str) -> DataFrame:
    """The scope forest: region, nation, supplier."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    none = F.lit(None).cast("string")
    top = region.select(F.concat(F.lit("r:"), "r_regionkey").alias("scope_id"), F.col("r_name").alias("repo_key"),
                        F.lit("root").alias("kind"), F.col("r_name").alias("name"), none.alias("parent"))
    mid = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("n:"), "n_nationkey"), "r_name", F.lit("folder"), "n_name",
        F.concat(F.lit("r:"), "r_regionkey"))
    low = homes(spark, folder).select(F.concat(F.lit("s:"), "s_suppkey"), "repo_key", F.lit("module"), "module",
                                      F.concat(F.lit("n:"), "n_nationkey"))
    return top.unionAll(mid).unionAll(low)


def decls(spark: SparkSession, folder: str) -> DataFrame:
    """One declaration per part.  ``ref`` is the node id used by every graph job."""
    supplier = table(spark, folder, "supplier")
    n = supplier.agg(F.count("*")).scalar()
    key = F.col("p_partkey")
    part = table(spark, folder, "part").withColumn("suppliers", n).withColumn("home", key % F.col("suppliers"))
    return part.join(dealt(homes(spark, folder)), F.col("home") == F.col("s_suppkey")).select(
        key.alias("ref"), "repo_key", F.concat(F.lit("s:"), "home").alias("scope_id"),
        F.concat(F.lit("n:"), "n_nationkey").alias("folder_id"), F.concat(F.lit("r:"), "r_regionkey").alias("root_id"),
        "module", F.concat(F.col("p_brand"), F.lit("."), F.regexp_replace("p_name", " ", "_"), F.lit("."), key % 7).alias("name"),
        F.col("p_type").alias("kind"), (F.col("p_size") % 2 == 0).alias("local_public"),
        (key % 10 == 0).alias("technical"), (F.col("p_size") >= 48).alias("outcome"),
        F.when((key % 10 == 0) & (key >= F.col("suppliers")), key - F.col("suppliers")).alias("generated_from"),
        F.when(key % 13 != 0, F.col("p_name")).alias("statement_text"),
        F.when(key % 13 == 0, "missing").otherwise("present").alias("statement_status"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("proof_text"),
        F.when(F.col("p_size") % 3 == 0, "not_applicable").otherwise("present").alias("proof_status"),
        F.when(key % 17 != 0, F.concat(F.lit("src/"), "n_name", F.lit("/"), "module")).alias("path"),
        (F.col("p_size") * 10 + key % 10).alias("start_line"),
        F.when(key % 7 != 0, 1 + key % 3).alias("start_column"),
        (F.col("p_size") * 10 + key % 10 + key % 5).alias("end_line"),
        F.when(key % 7 != 0, 4 + key % 11).alias("end_column"),
    )


def source_key() -> Column:
    """(class, path, start line, start column or 0, end line, end column or 0, ref); unlocated rows last."""
    located = F.col("path").isNotNull()
    zero = F.lit(0).cast("long")
    num = lambda c: F.when(located, F.coalesce(F.col(c).cast("long"), zero)).otherwise(zero)
    return F.struct(
        F.when(located, 0).otherwise(1).alias("class"), F.coalesce("path", F.lit("")).alias("path"),
        num("start_line").alias("start_line"), num("start_column").alias("start_column"),
        num("end_line").alias("end_line"), num("end_column").alias("end_column"), F.col("ref"))


def _beside(line: DataFrame) -> DataFrame:
    """Lines of orders, shuffled once so that a line and the next one of its order meet in one ``block`` of lines.

    The first line of a block also stands in the block before it, ``ahead`` of its own.
    """
    n = F.col("l_linenumber")
    own = F.floor(n / LINES_TOGETHER).cast("long")
    both = F.array(F.struct(own.alias("block"), F.lit(False).alias("ahead")), F.struct((own - 1).alias("block"), F.lit(True).alias("ahead")))
    dealt_to = F.explode(F.when(n % LINES_TOGETHER == 0, both).otherwise(F.slice(both, 1, 1)))
    rows = line.where("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL").select("*", dealt_to.alias("at"))
    return rows.select(*line.columns, "at.block", "at.ahead").repartition("l_orderkey", "block")


def _next() -> Column:
    """Whether ``b_line`` follows ``l_linenumber``, a line that is not ahead of its block.

    One term over both sides: it is no join key and no filter of one side, so both sides read the same shuffle.
    """
    return F.when(F.col("ahead"), 2 * LINES_TOGETHER).otherwise(0) + F.col("b_line") - F.col("l_linenumber") == 1


def occurrences(spark: SparkSession, folder: str, directed: bool = False) -> DataFrame:
    """Dependency evidence between neighbouring lines of an order, with a multiplicity ``n``.

    Equal lines are counted before the join, so repeated (order, line) keys do not
    multiply rows.  ``directed`` keeps line order (cyclic); otherwise the smaller
    part is the provider (acyclic).
    """
    line = _beside(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))
    line = line.groupBy(*line.columns).agg(F.count("*").alias("k"))
    a = line.select("l_orderkey", "block", "ahead", "l_linenumber", F.col("l_partkey").alias("a_part"), F.col("l_suppkey").alias("a_supp"), F.col("k").alias("a_n"))
    b = line.select("l_orderkey", "block", F.col("l_linenumber").alias("b_line"), F.col("l_partkey").alias("b_part"),
                    "l_returnflag", "l_linestatus", F.col("k").alias("b_n"))
    pairs = a.join(dealt(b), ["l_orderkey", "block"]).where(_next() & (F.col("a_part") != F.col("b_part")))
    provider = F.col("a_part") if directed else F.least("a_part", "b_part")
    consumer = F.col("b_part") if directed else F.greatest("a_part", "b_part")
    return pairs.select(
        provider.alias("provider"), consumer.alias("consumer"),
        F.when(F.col("l_returnflag") == "R", "proof").otherwise("statement").alias("part"),
        F.when(F.col("l_linestatus") == "O", "lean_type").otherwise("lean_value").alias("evidence_kind"),
        F.when(F.col("l_linenumber") > 1,
               F.concat(F.lit("Supplier#"), F.lpad(F.col("a_supp").cast("string"), 9, "0"))).alias("provider_module"),
        (F.col("a_n") * F.col("b_n")).alias("n"))


def edge_pairs(spark: SparkSession, folder: str, directed: bool = False) -> DataFrame:
    """Distinct (provider, consumer) pairs only: reads three columns and drops repeats before the join."""
    line = _beside(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")).distinct()
    a = line.select("l_orderkey", "block", "ahead", "l_linenumber", F.col("l_partkey").alias("a_part"))
    b = line.select("l_orderkey", "block", F.col("l_linenumber").alias("b_line"), F.col("l_partkey").alias("b_part"))
    met = a.join(dealt(b), ["l_orderkey", "block"]).where(_next() & (F.col("a_part") != F.col("b_part")))
    if directed:
        return met.select(F.col("a_part").alias("provider"), F.col("b_part").alias("consumer")).distinct()
    return met.select(F.least("a_part", "b_part").alias("provider"), F.greatest("a_part", "b_part").alias("consumer")).distinct()


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Two annotators per document: quality and toxic as yes / no / uncertain."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    says = lambda c: F.when(F.col("doc_id") % 17 == 0, "uncertain").when(F.col(c) == 1, "yes").otherwise("no")
    return table(spark, folder, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("sample_id"), F.col("lang").alias("project"),
        F.when(F.col("doc_id") % 5 == 0, "boundary").otherwise("random").alias("stratum"),
        says("quality").alias("first"), says("toxic").alias("second"), "n_chars", "source")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document, numbered from 1."""
    return table(spark, folder, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select(
        "doc_id", (F.col("at") + 1).alias("line_no"), "line")
