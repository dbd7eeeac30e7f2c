"""Label agreement, quantiles, correlations, sampling, batching and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.operators import stats as S
from strandwork.operators.order_stats import positions, quantiles, running
from strandwork.plans.oracle_base import LABELS, tree
from strandwork.plans.registry import query
from strandwork.session import materialize
from strandwork.sources import derived as D


def _agree(select, group):
    def share(a):
        return " + ".join(f"(count(*) FILTER (first = '{s}') / count(*)::DOUBLE) * (count(*) FILTER (second = '{s}') / count(*)::DOUBLE)" for s in ("no", "uncertain", "yes"))
    e = share(0)
    return f"""WITH {LABELS}
SELECT {select} count(*) AS n, round(count(*) FILTER (first = second) / count(*)::DOUBLE, 6) AS observed, round({e}, 6) AS expected,
 CASE WHEN abs(({e}) - 1) > 1e-12 THEN round((count(*) FILTER (first = second) / count(*)::DOUBLE - ({e})) / (1 - ({e})), 6) END AS kappa,
 CASE WHEN count(*) FILTER (first <> 'uncertain' AND second <> 'uncertain') > 0 THEN round(count(*) FILTER (first <> 'uncertain' AND first = second)
   / count(*) FILTER (first <> 'uncertain' AND second <> 'uncertain')::DOUBLE, 6) END AS definite_agreement,
 round(count(*) FILTER (first = 'uncertain') / count(*)::DOUBLE, 6) AS uncertain_first,
 round(count(*) FILTER (second = 'uncertain') / count(*)::DOUBLE, 6) AS uncertain_second
FROM said {group}"""


@query("e18_agreement", _agree("", ""))
def agreement(spark, d):
    return S.agreement(D.labels(spark, d))


@query("e18_confusion", f"WITH {LABELS} SELECT first, count(*) FILTER (second = 'no') AS no, count(*) FILTER (second = 'uncertain') AS uncertain, count(*) FILTER (second = 'yes') AS yes FROM said GROUP BY first")
def confusion(spark, d):
    return D.labels(spark, d).groupBy("first").pivot("second", ["no", "uncertain", "yes"]).agg(F.count(F.lit(1))).fillna(0)


@query("e19_agreement_by_grouping_sets", _agree("project, stratum, grouping_id(project, stratum) AS level,", "GROUP BY GROUPING SETS ((), (stratum), (project), (project, stratum))"))
def agreement_sets(spark, d):
    return S.grouped_agreement(D.labels(spark, d))


@query("d19_annotator_pairs", f"WITH {LABELS} SELECT sample_id, first, second, first = second AS same FROM said")
def annotator_pairs(spark, d):
    """Pairs two annotators' long label rows on sample and label."""
    said = D.labels(spark, d)
    long = said.select("sample_id", F.lit(1).alias("annotator"), F.col("first").alias("value")).unionAll(said.select("sample_id", F.lit(2), "second"))
    one, two = (long.where(F.col("annotator") == i).select("sample_id", F.col("value").alias(n)) for i, n in ((1, "first"), (2, "second")))
    return one.join(two, "sample_id").withColumn("same", F.col("first") == F.col("second"))


@query("e20_quantiles", f"""WITH {LABELS} SELECT project, quantile_cont(n_chars::DOUBLE, 0.25) AS q1, quantile_cont(n_chars::DOUBLE, 0.5) AS q2,
 quantile_cont(n_chars::DOUBLE, 0.75) AS q3 FROM said WHERE stratum = 'random' GROUP BY project""")
def size_quantiles(spark, d):
    rows = D.labels(spark, d).where("stratum = 'random'")
    return quantiles(rows, ["project"], "n_chars", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


@query("e21_quartile_table", f"""WITH {LABELS}, cuts AS (SELECT project AS p, quantile_cont(n_chars::DOUBLE, 0.25) AS q1, quantile_cont(n_chars::DOUBLE, 0.5) AS q2,
 quantile_cont(n_chars::DOUBLE, 0.75) AS q3 FROM said WHERE stratum = 'random' GROUP BY project)
SELECT project, 1 + (n_chars > q1)::INT + (n_chars > q2)::INT + (n_chars > q3)::INT AS quartile, count(*) FILTER (first = 'no') AS no,
 count(*) FILTER (first = 'uncertain') AS uncertain, count(*) FILTER (first = 'yes') AS yes FROM said JOIN cuts ON p = project GROUP BY ALL""")
def quartile_table(spark, d):
    rows = D.labels(spark, d)
    return S.quartile_table(rows, ["project"], "n_chars", "first", rows.where("stratum = 'random'"))


@query("e21_medians_by_label", f"""WITH {LABELS} SELECT project, first, median(n_chars::DOUBLE) AS median, min(n_chars) AS lowest, max(n_chars) AS highest,
 min(n_chars) = max(n_chars) AS constant FROM said WHERE first <> 'uncertain' GROUP BY ALL""")
def medians_by_label(spark, d):
    rows = materialize(D.labels(spark, d).where("first <> 'uncertain'"))
    bounds = rows.groupBy("project", "first").agg(F.min("n_chars").alias("lowest"), F.max("n_chars").alias("highest"))
    return quantiles(rows, ["project", "first"], "n_chars", {"median": 0.5}).join(bounds, ["project", "first"]).withColumn(
        "constant", F.col("lowest") == F.col("highest"))


@query("e22_spearman", f"""WITH {LABELS}, v AS (SELECT project, n_chars AS x, length(source) * 1000 + sample_id % 97 AS y FROM said),
r AS (SELECT project, rank() OVER (PARTITION BY project ORDER BY x) + (count(*) OVER (PARTITION BY project, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY project ORDER BY y) + (count(*) OVER (PARTITION BY project, y) - 1) / 2.0 AS ry FROM v)
SELECT project, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY project""")
def spearman(spark, d):
    rows = D.labels(spark, d).select("project", F.col("n_chars").alias("x"), (F.length("source") * 1000 + F.col("sample_id") % 97).alias("y"))
    return S.spearman(rows, ["project"], "x", "y").withColumn("rho", F.round("rho", 6))


@query("f12_average_ranks", f"""WITH {LABELS} SELECT sample_id, rank() OVER (PARTITION BY project ORDER BY n_chars) + (count(*) OVER (PARTITION BY project, n_chars) - 1) / 2.0 AS mean_rank FROM said""")
def average_ranks(spark, d):
    from strandwork.operators.order_stats import average_ranks as ranks

    return ranks(D.labels(spark, d).select("sample_id", "project", "n_chars"), ["project"], "n_chars", "mean_rank").select("sample_id", "mean_rank")


@query("e23_label_counts", f"""WITH {LABELS} SELECT source, count(*) FILTER (first = 'no') AS no, count(*) FILTER (first = 'uncertain') AS uncertain, count(*) FILTER (first = 'yes') AS yes FROM said GROUP BY source""")
def label_counts(spark, d):
    return D.labels(spark, d).groupBy("source").pivot("first", ["no", "uncertain", "yes"]).agg(F.count(F.lit(1))).fillna(0)


@query("e24_majority_share", f"""WITH {LABELS}, v AS (SELECT sample_id, first AS s FROM said UNION ALL SELECT sample_id, second FROM said UNION ALL
 SELECT sample_id, CASE WHEN n_chars > 2000 THEN 'yes' ELSE 'no' END FROM said)
SELECT sample_id, round(max(n) / 3.0, 6) AS share FROM (SELECT sample_id, s, count(*) AS n FROM v GROUP BY ALL) GROUP BY sample_id""")
def majority_share(spark, d):
    """Share of the most frequent answer; the third vote is by length."""
    votes = D.labels(spark, d).select("sample_id", F.explode(F.array("first", "second", F.when(F.col("n_chars") > 2000, "yes").otherwise("no"))).alias("s"))
    return votes.groupBy("sample_id", "s").agg(F.count("*").alias("n")).groupBy("sample_id").agg(
        F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("e25_load_audit", tree("""
SELECT count(*) AS declarations, count(DISTINCT module) AS modules, count(statement_text) AS texts, count(*) FILTER (proof_status = 'present') AS proofs,
 count(*) FILTER (statement_status = 'missing') AS missing FROM decls"""))
def load_audit(spark, d):
    return D.decls(spark, d).groupBy("module").agg(
        F.count("*").alias("n"), F.count("statement_text").alias("t"), F.count_if(F.col("proof_status") == "present").alias("p"),
        F.count_if(F.col("statement_status") == "missing").alias("m")).agg(
        F.sum("n").alias("declarations"), F.count("*").alias("modules"), F.sum("t").alias("texts"), F.sum("p").alias("proofs"), F.sum("m").alias("missing"))


@query("e26_usage_rollup", """
SELECT event_type, count(*) AS calls, round(sum(value), 2) AS amount, round(sum(value) FILTER (user_id % 2 = 0), 2) AS cached, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def usage_rollup(spark, d):
    per = D.table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return per.groupBy("event_type").agg(F.sum("n").alias("calls"), F.round(F.sum("v"), 2).alias("amount"),
                                         F.round(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("v"))), 2).alias("cached"), F.count("*").alias("users"))


@query("e34_paired_judgements", f"""WITH {LABELS}, j AS (SELECT sample_id, CASE WHEN first = 'uncertain' THEN NULL WHEN first = 'yes' THEN 'A' ELSE 'B' END AS c1,
 CASE WHEN second = 'uncertain' THEN NULL WHEN second = 'yes' THEN 'B' ELSE 'A' END AS c2 FROM said)
SELECT sample_id, CASE WHEN c1 IS NULL OR c2 IS NULL THEN 'invalid' WHEN s1 = s2 THEN s1 ELSE 'tie' END AS outcome FROM (
 SELECT *, CASE WHEN (c1 = 'A') = (sample_id % 2 = 0) THEN 'baseline' ELSE 'solver' END AS s1,
  CASE WHEN (c2 = 'A') = (sample_id % 2 = 1) THEN 'baseline' ELSE 'solver' END AS s2 FROM j)""")
def paired_judgements(spark, d):
    """A preference counts only when both label-swapped calls pick the same strategy."""
    rows = D.labels(spark, d)
    even = F.col("sample_id") % 2 == 0
    first_label = F.when(F.col("first") != "uncertain", F.when(F.col("first") == "yes", "A").otherwise("B"))
    second_label = F.when(F.col("second") != "uncertain", F.when(F.col("second") == "yes", "B").otherwise("A"))
    named = lambda c, a_is_base: F.when((c == "A") == a_is_base, "baseline").otherwise("solver")
    picks = rows.select("sample_id", first_label.alias("c1"), second_label.alias("c2"),
                        named(first_label, even).alias("s1"), named(second_label, ~even).alias("s2"))
    return picks.select("sample_id", F.when(F.col("c1").isNull() | F.col("c2").isNull(), "invalid").when(
        F.col("s1") == F.col("s2"), F.col("s1")).otherwise("tie").alias("outcome"))


@query("c7_sample_population", """
SELECT doc_id, lang, n_chars FROM documents WHERE n_chars BETWEEN 200 AND 20000 AND source <> 'src13'""")
def sample_population(spark, d):
    return D.table(spark, d, "documents").where("n_chars BETWEEN 200 AND 20000 AND source <> 'src13'").select("doc_id", "lang", "n_chars")


@query("g7_stratified_sample", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS a, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS z FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('11:' || doc_id)) AS rn FROM e WHERE a > 1 AND z > 1)
SELECT lang, doc_id, 'shortest' AS stratum FROM e WHERE a = 1 UNION ALL SELECT lang, doc_id, 'longest' FROM e WHERE z = 1
UNION ALL SELECT lang, doc_id, 'random' FROM r WHERE rn <= 10""")
def stratified_sample(spark, d):
    return S.stratified_sample(D.table(spark, d, "documents").select("lang", "doc_id", "n_chars"), "lang", "doc_id", "n_chars", "11", 10)


@query("g6_best_case_per_project", """
SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3""")
def best_cases(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return D.table(spark, d, "documents").select("lang", "doc_id", "n_chars").withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query("g8_alternating_labels", """
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id)) % 2 = 1 THEN 'AB' ELSE 'BA' END AS labels FROM documents""")
def alternating_labels(spark, d):
    drawn = D.table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.concat(F.lit("3:"), "doc_id"), 256).alias("h"))
    return positions(drawn, ["lang"], ["h"], "p").select("doc_id", F.when(F.col("p") % 2 == 0, "AB").otherwise("BA").alias("labels"))


@query("g9_selection_batches", """
WITH s AS (SELECT source, doc_id, n_chars > 3000 AS alone, row_number() OVER (PARTITION BY source, n_chars > 3000 ORDER BY doc_id) - 1 AS pos,
 count(*) OVER (PARTITION BY source, n_chars > 3000) AS n FROM documents)
SELECT source, doc_id, alone, pos, ntile_ AS batch FROM (SELECT *, CASE WHEN pos < (n % b) * (n // b + 1) THEN pos // (n // b + 1) ELSE (n % b) + (pos - (n % b) * (n // b + 1)) // (n // b) END AS ntile_
 FROM (SELECT *, CASE WHEN alone THEN n ELSE ceil(n / 12.0)::BIGINT END AS b FROM s))""")
def selection_batches(spark, d):
    """Documents in even batches per source: short ones by up to 12, long ones alone."""
    docs = D.table(spark, d, "documents").select("source", "doc_id", (F.col("n_chars") > 3000).alias("alone"))
    batches = [S.even_batches(docs.where(F.col("alone") == alone), ["source", "alone"], ["doc_id"], size) for alone, size in ((False, 12), (True, 1))]
    return batches[0].unionByName(batches[1])


@query("f8_chunk_ids", """
SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS chunk FROM documents""")
def chunk_ids(spark, d):
    docs = D.table(spark, d, "documents").select("source", "doc_id")
    return positions(docs, ["source"], ["doc_id"], "pos").select("source", "doc_id", F.floor(F.col("pos") / 10).alias("chunk"))


@query("f10_envelope_page", """
SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents) WHERE upto <= 20000""")
def envelope_page(spark, d):
    docs = D.table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return running(docs, ["source"], ["doc_id"], {"upto": F.col("n_chars")}).where("upto <= 20000").select("source", "doc_id")


@query("f13_round_robin", """
SELECT doc_id, row_number() OVER (ORDER BY rn, source) - 1 AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)""")
def round_robin(spark, d):
    """Interleave the sources: the first of each, then the second of each, and so on."""
    docs = materialize(positions(D.table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "rn"))
    return positions(docs, [], ["rn", "source"], "place").select("doc_id", "place")


@query("f9_greedy_packing")
def greedy_packing(spark, d):
    """Pack the turns of each conversation in order under a count and a character cap; checked in tests by brute force."""
    from strandwork.operators.packing import pack

    turns = D.table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return pack(turns, ["conv_id"], "turn", "size", 6, 1500)


@query("e27_content_completeness", """
SELECT p.lang, count(*) AS wanted, count(l.doc_id) AS done, count(*) - count(l.doc_id) AS missing, count(*) = count(l.doc_id) AS complete
FROM documents p LEFT JOIN labels l ON l.doc_id = p.doc_id GROUP BY p.lang""")
def content_completeness(spark, d):
    have = D.table(spark, d, "labels").select("doc_id", F.lit(1).alias("here"))
    return D.table(spark, d, "documents").select("doc_id", "lang").join(have, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("wanted"), F.count("here").alias("done"), (F.count("*") - F.count("here")).alias("missing"),
        (F.count("*") == F.count("here")).alias("complete"))


@query("e35_unit_fact_sets", tree("""
SELECT ref, CASE WHEN a IS NULL THEN 'unexpected' ELSE 'missing' END AS side FROM (SELECT ref, scope_id AS a FROM decls WHERE generated_from IS NULL) FULL JOIN (SELECT ref, scope_id AS b FROM decls WHERE NOT technical OR outcome) USING (ref)
WHERE a IS NULL OR b IS NULL"""))
def unit_fact_sets(spark, d):
    """Units of two trees over the same facts: owners by generation against everything that is not technical."""
    from strandwork.operators.quality import set_difference

    decls = D.decls(spark, d)
    return set_difference(decls.where("generated_from IS NULL").select("ref"), decls.where("NOT technical OR outcome").select("ref"), ["ref"])


@query("e17_order_experiment", tree("""
SELECT repo_key, count(*) AS atoms, sum(abs(rank - pos))::BIGINT AS displacement, count(*) FILTER (rank <> pos) AS changed FROM (
 SELECT repo_key, row_number() OVER (PARTITION BY scope_id ORDER BY path IS NULL, path, CASE WHEN path IS NULL THEN 0 ELSE start_line END,
  CASE WHEN path IS NULL THEN 0 ELSE coalesce(start_column, 0) END, CASE WHEN path IS NULL THEN 0 ELSE end_line END,
  CASE WHEN path IS NULL THEN 0 ELSE coalesce(end_column, 0) END, ref) AS rank, row_number() OVER (PARTITION BY scope_id ORDER BY ref) AS pos FROM decls) GROUP BY repo_key"""))
def order_experiment(spark, d):
    from strandwork.plans.q_order import module_problem

    atoms, _, by_id = module_problem(spark, d)
    place = D.scopes(spark, d).select(F.col("scope_id").alias("parent"), "repo_key")
    return atoms.join(by_id, ["parent", "atom"]).join(place, "parent").groupBy("repo_key").agg(
        F.count("*").alias("atoms"), F.sum(F.abs(F.col("rank") - F.col("pos"))).alias("displacement"), F.count_if(F.col("rank") != F.col("pos")).alias("changed"))
