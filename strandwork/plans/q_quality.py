"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.functions import text as X
from strandwork.operators import graph as G, iterate as I, quality as Q, sibling as S
from strandwork.plans.oracle_base import LABELS, LINES, graph, tree
from strandwork.plans.q_graph import acyclic_pairs
from strandwork.plans.q_order import PROBLEM, module_problem
from strandwork.plans.registry import query
from strandwork.session import materialize
from strandwork.sources import derived as D, published as P


@query("m1_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return Q.duplicate_keys(D.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("m2_referential_integrity", """
SELECT CAST(l_partkey AS VARCHAR) AS ref, 'part' AS rule, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY l_partkey
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id""")
def referential_integrity(spark, d):
    t = lambda n: D.table(spark, d, n)
    return (Q.missing_refs(t("lineitem"), "l_partkey", t("part").select("p_partkey"), "part")
            .unionAll(Q.missing_refs(t("lineitem"), "l_orderkey", t("orders").select("o_orderkey"), "order"))
            .unionAll(Q.missing_refs(t("orders"), "o_custkey", t("customer").where("c_acctbal > 0").select("c_custkey"), "customer"))
            .unionAll(Q.missing_refs(t("documents"), "doc_id", t("labels").select("doc_id"), "label")))


@query("m3_row_rules", tree("""
SELECT ref, 'text_without_status' AS rule FROM decls WHERE (statement_text IS NULL) = (statement_status = 'present')
UNION ALL SELECT ref, 'half_open_columns' FROM decls WHERE (start_column IS NULL) <> (end_column IS NULL)
UNION ALL SELECT ref, 'backward_range' FROM decls WHERE start_line > end_line OR (start_line = end_line AND start_column >= end_column)
UNION ALL SELECT ref, 'unlocated' FROM decls WHERE path IS NULL
UNION ALL SELECT ref, 'unknown_kind' FROM decls WHERE kind NOT IN ('PROMO', 'ECONOMY', 'STANDARD')"""))
def row_rules(spark, d):
    c = F.col
    return Q.row_rules(D.decls(spark, d), ["ref"], {
        "text_without_status": c("statement_text").isNull() == (c("statement_status") == "present"),
        "half_open_columns": c("start_column").isNull() != c("end_column").isNull(),
        "backward_range": (c("start_line") > c("end_line")) | ((c("start_line") == c("end_line")) & (c("start_column") >= c("end_column"))),
        "unlocated": c("path").isNull(), "unknown_kind": ~c("kind").isin("PROMO", "ECONOMY", "STANDARD")})


@query("m4_parent_cycles", """
WITH RECURSIVE ns AS (SELECT count(*) AS n FROM customer), p AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey * 7 + 3) % n END AS parent FROM customer, ns),
ok(node) AS (SELECT node FROM p WHERE parent IS NULL UNION SELECT p.node FROM p JOIN ok ON ok.node = p.parent)
SELECT node FROM p WHERE node NOT IN (SELECT node FROM ok)""")
def parent_cycles(spark, d):
    n = D.table(spark, d, "customer").agg(F.count("*")).scalar()
    k = F.col("c_custkey")
    nodes = D.table(spark, d, "customer").withColumn("n", n).select(k.alias("node"), F.when(k % 10 != 0, (k * 7 + 3) % F.col("n")).alias("parent"))
    return I.parent_cycles(materialize(nodes))


@query("m5_unit_cover", tree("""
SELECT d.ref, count(u.unit) AS owners FROM decls d LEFT JOIN (SELECT ref AS unit, ref FROM decls WHERE generated_from IS NULL UNION ALL SELECT generated_from, ref FROM decls WHERE generated_from % 30 <> 0
 UNION ALL SELECT -1, ref FROM decls WHERE outcome) u ON u.ref = d.ref GROUP BY d.ref HAVING count(u.unit) <> 1"""))
def unit_cover(spark, d):
    """Declarations owned by no unit or by several."""
    decls = D.decls(spark, d)
    owned = decls.where("generated_from IS NULL").select("ref").unionAll(decls.where("generated_from % 30 <> 0").select("ref")).unionAll(decls.where("outcome").select("ref"))
    n = owned.groupBy("ref").agg(F.count("*").alias("owners"))
    return decls.select("ref").join(n, "ref", "left").fillna(0, ["owners"]).where("owners <> 1")


@query("m6_coverage_completeness", graph("""
SELECT ref, part, 'missing' AS side FROM (SELECT ref, 'statement' AS part FROM decls UNION ALL SELECT ref, 'proof' FROM decls WHERE proof_status = 'present' EXCEPT SELECT DISTINCT consumer, part FROM occ)
UNION ALL SELECT ref, part, 'unexpected' FROM (SELECT DISTINCT consumer AS ref, part FROM occ EXCEPT (SELECT ref, 'statement' FROM decls UNION ALL SELECT ref, 'proof' FROM decls WHERE proof_status = 'present'))"""))
def coverage_completeness(spark, d):
    decls = D.decls(spark, d)
    want = decls.select("ref", F.lit("statement").alias("part")).unionAll(decls.where("proof_status = 'present'").select("ref", F.lit("proof")))
    have = D.occurrences(spark, d).select(F.col("consumer").alias("ref"), "part").distinct()
    return Q.set_difference(want, have, ["ref", "part"])


@query("m7_stale_digests", """
SELECT doc_id, 'stale' AS rule FROM documents WHERE sha256(text) <> sha256(CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END)""")
def stale_digests(spark, d):
    docs = D.table(spark, d, "documents")
    kept = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("recorded"))
    return docs.select("doc_id", F.sha2("text", 256).alias("now")).join(kept, "doc_id").where("now <> recorded").select("doc_id", F.lit("stale").alias("rule"))


@query("m8_hierarchy_audit", tree("""
SELECT CAST(ref AS VARCHAR) AS node, 'endpoint_outside_root' AS rule FROM decls d WHERE NOT EXISTS (SELECT 1 FROM scopes s WHERE s.scope_id = d.scope_id AND s.repo_key = d.repo_key)
UNION ALL SELECT scope_id, 'empty_scope' FROM scopes s WHERE kind = 'module' AND NOT EXISTS (SELECT 1 FROM decls d WHERE d.scope_id = s.scope_id)
UNION ALL SELECT scope_id, 'childless_folder' FROM scopes s WHERE kind = 'folder' AND NOT EXISTS (SELECT 1 FROM scopes k WHERE k.parent = s.scope_id)
UNION ALL SELECT scope_id, 'foreign_parent' FROM scopes s WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM scopes p WHERE p.scope_id = s.parent AND p.repo_key = s.repo_key)"""))
def hierarchy_audit(spark, d):
    scopes, decls = D.scopes(spark, d), D.decls(spark, d)
    rule = lambda df, col, name: df.select(F.col(col).cast("string").alias("node"), F.lit(name).alias("rule"))
    return (rule(decls.join(scopes, ["scope_id", "repo_key"], "left_anti"), "ref", "endpoint_outside_root")
            .unionAll(rule(scopes.where("kind = 'module'").join(decls, "scope_id", "left_anti"), "scope_id", "empty_scope"))
            .unionAll(rule(scopes.where("kind = 'folder'").join(scopes.select(F.col("parent").alias("scope_id")), "scope_id", "left_anti"), "scope_id", "childless_folder"))
            .unionAll(rule(scopes.where("parent IS NOT NULL").join(scopes.select(F.col("scope_id").alias("parent"), "repo_key"), ["parent", "repo_key"], "left_anti"), "scope_id", "foreign_parent")))


@query("m9_order_audit", graph("""
SELECT s.parent, count(*) FILTER (b.rank <= a.rank) AS turned, sum(b.rank - a.rank)::BIGINT AS distance FROM pe s JOIN prob a ON a.ref = provider JOIN prob b ON b.ref = consumer GROUP BY s.parent""", PROBLEM))
def order_audit(spark, d):
    """Edges that the source order turns round, and its recomputed distance."""
    atoms, edges, _ = module_problem(spark, d)
    gap = F.col("to_pos") - F.col("from_pos")
    return S.spans(edges, atoms.select("parent", "atom", F.col("rank").alias("pos"))).groupBy("parent").agg(F.count_if(gap <= 0).alias("turned"), F.sum(gap).alias("distance"))


@query("m10_chunk_completeness", """
SELECT l_orderkey AS file, count(DISTINCT l_linenumber) <> max(c) AS incomplete, max(k) > 1 AS repeated, min(l_linenumber) <> 1 AS no_first FROM (
 SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS k, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) GROUP BY l_orderkey""")
def chunk_completeness(spark, d):
    """Orders as files whose lines are numbered chunks."""
    rows = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") - 1).alias("chunk"))
    last = rows.groupBy("file").agg((F.max("chunk") + 1).alias("chunks"))
    return Q.chunk_report(rows.join(last, "file"), "file", "chunk", "chunks", []).select("file", "incomplete", "repeated", "no_first")


@query("m11_catalog_rules", tree("""
SELECT ref, 'automatic_needs_proof_only' AS rule FROM decls WHERE ref % 3 <> 0 AND ref % 2 = 0 UNION ALL SELECT ref, 'reviewed_needs_source' FROM decls WHERE ref % 3 = 0 AND path IS NULL"""))
def catalog_rules(spark, d):
    reviewed = F.col("ref") % 3 == 0
    return Q.row_rules(D.decls(spark, d), ["ref"], {"automatic_needs_proof_only": ~reviewed & (F.col("ref") % 2 == 0), "reviewed_needs_source": reviewed & F.col("path").isNull()})


@query("m12_material_audit", """
WITH b AS (SELECT conv_id, turn, role AS kind, conv_id % 5 AS target FROM conversations)
SELECT 'duplicate_binding' AS rule, count(*) AS n FROM (SELECT conv_id, kind, target FROM b GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'missing_parent', count(*) FROM conversations c WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)
UNION ALL SELECT 'blank_text', count(*) FROM conversations WHERE trim(text) = ''""")
def material_audit(spark, d):
    conv = D.table(spark, d, "conversations")
    twice = Q.duplicate_keys(conv.select("conv_id", "role", F.col("conv_id") % 5), ["conv_id", "role"])
    lost = conv.where("turn > 0").select("conv_id", (F.col("turn") - 1).alias("turn")).join(conv, ["conv_id", "turn"], "left_anti")
    tell = lambda df, name: df.agg(F.lit(name).alias("rule"), F.count("*").alias("n"))
    return tell(twice, "duplicate_binding").unionAll(tell(lost, "missing_parent")).unionAll(tell(conv.where(F.trim("text") == ""), "blank_text"))


@query("m13_order_evidence_audit", """
WITH RECURSIVE ns AS (SELECT count(*) AS n FROM supplier), e AS (SELECT s_suppkey AS a, (s_suppkey * 3 + 1) % n AS b, 'manual' AS producer FROM supplier, ns WHERE s_suppkey % 4 <> 0),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT DISTINCT a AS node, 'manual_cycle' AS rule FROM r WHERE a = b""")
def order_evidence_audit(spark, d):
    """Manual relations must not run in a circle."""
    from strandwork.operators.components import cyclic_components

    n = D.table(spark, d, "supplier").agg(F.count("*")).scalar()
    s = D.table(spark, d, "supplier").withColumn("n", n).select(F.col("s_suppkey").alias("node"), "n")
    e = s.where("node % 4 <> 0").select(F.col("node").alias("provider"), ((F.col("node") * 3 + 1) % F.col("n")).alias("consumer"))
    return cyclic_components(materialize(s.select("node")), materialize(e)).select("node", F.lit("manual_cycle").alias("rule"))


@query("m14_paired_run_audit", f"""WITH {LABELS} SELECT count(*) AS pairs, count(*) FILTER (first NOT IN ('yes', 'no', 'uncertain')) AS bad_first, count(*) FILTER (second NOT IN ('yes', 'no', 'uncertain')) AS bad_second,
 count(*) - count(DISTINCT sample_id) AS repeated FROM said""")
def paired_run_audit(spark, d):
    ok = ("yes", "no", "uncertain")
    per = D.labels(spark, d).groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if(~F.col("first").isin(*ok)).alias("f"), F.count_if(~F.col("second").isin(*ok)).alias("s"))
    return per.agg(F.sum("n").alias("pairs"), F.sum("f").alias("bad_first"), F.sum("s").alias("bad_second"), (F.sum("n") - F.count("*")).alias("repeated"))


@query("m15_csr_consistency", """
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'length_mismatch' WHEN doc_id % 4 = 2 THEN 'malformed' END AS code FROM documents WHERE doc_id % 4 IN (1, 2)""")
def csr_consistency(spark, d):
    """Offset and target arrays of every document, some with a target too many, some cut off."""
    docs = D.table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    ints = lambda hi: F.array_join(F.transform(F.sequence(F.lit(0), hi), lambda i: i.cast("string")), ",")
    k = F.col("doc_id") % 4
    text = F.concat(F.lit("window.EDGES={off:["), ints(F.col("n")), F.lit("],dst:["), ints(F.when(k == 1, F.col("n")).otherwise(F.col("n") - 1)), F.when(k == 2, F.lit("]}oops")).otherwise(F.lit("]};")))
    return P.csr_violations(docs.select("doc_id", text.alias("text")), "doc_id", "text", "EDGES")


@query("m16_profile_checks", """
SELECT c_mktsegment AS slice, count(*) AS unknown_specs FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY c_mktsegment""")
def profile_checks(spark, d):
    known = D.table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    return D.table(spark, d, "customer").join(known, "c_nationkey", "left_anti").groupBy(F.col("c_mktsegment").alias("slice")).agg(F.count("*").alias("unknown_specs"))


@query("m17_sequence_rules", """
SELECT conv_id, 'repeated_member' AS rule FROM conversations GROUP BY conv_id, role HAVING count(*) > 1
UNION ALL SELECT DISTINCT conv_id, 'protected_needs_primary' FROM conversations WHERE conv_id % 3 = 0 AND role = 'assistant'""")
def sequence_rules(spark, d):
    conv = D.table(spark, d, "conversations")
    again = Q.duplicate_keys(conv, ["conv_id", "role"]).select("conv_id", F.lit("repeated_member").alias("rule"))
    return again.unionAll(conv.where("conv_id % 3 = 0 AND role = 'assistant'").select("conv_id", F.lit("protected_needs_primary")).distinct())


@query("m18_input_audit", tree("""
SELECT scope_id, CASE WHEN scope_id LIKE 's:%' THEN 'missing' ELSE 'unexpected' END AS side FROM (
 SELECT scope_id FROM scopes WHERE kind = 'module' AND scope_id NOT IN (SELECT scope_id FROM decls WHERE outcome)
 UNION ALL SELECT DISTINCT folder_id FROM decls WHERE outcome)"""))
def input_audit(spark, d):
    """Scopes an order must cover against the scopes it names."""
    decls = D.decls(spark, d).where("outcome")
    want = D.scopes(spark, d).where("kind = 'module'").select("scope_id")
    have = decls.select("scope_id").unionAll(decls.select("folder_id")).distinct()
    return Q.set_difference(want, have, ["scope_id"])


@query("m19_report_audit", """
SELECT source, count(*) AS items, max(n) AS largest, count(*) FILTER (n > 12) AS over FROM (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 12 AS b, 1 AS one FROM documents) x
JOIN (SELECT source AS s2, b AS b2, count(*) AS n FROM (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 12 AS b FROM documents) GROUP BY ALL) y ON s2 = source AND b2 = b GROUP BY source""")
def report_audit(spark, d):
    from strandwork.operators.order_stats import positions

    rows = positions(D.table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "pos")
    batches = rows.groupBy("source", F.floor(F.col("pos") / 12).alias("b")).agg(F.count("*").alias("n"))
    return batches.groupBy("source").agg(F.sum("n").alias("items"), F.max("n").alias("largest"), F.coalesce(F.sum(F.when(F.col("n") > 12, F.col("n"))), F.lit(0)).alias("over"))


@query("m20_coverage_diagnostics", f"""WITH {LINES} SELECT doc_id, round(count(*) FILTER (trim(line) <> '') / count(*)::DOUBLE, 6) AS ratio, count(*) FILTER (line LIKE '%#%') AS unrecognised FROM lines GROUP BY doc_id""")
def coverage_diagnostics(spark, d):
    return D.lines(spark, d).groupBy("doc_id").agg(F.round(F.count_if(F.trim("line") != "") / F.count("*"), 6).alias("ratio"), F.count_if(F.col("line").contains("#")).alias("unrecognised"))
