"""Content records, rendered views, pages and submission checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.operators import content as C, graph as G, quality as Q, tree as T
from strandwork.operators.order_stats import adjacent_pairs, running
from strandwork.plans.oracle_base import LABELS, LINES, graph, tree
from strandwork.plans.q_graph import acyclic_pairs
from strandwork.plans.q_tree import CLOSURE, PATHS, POS, TREE, VIEWS, full_closure, placed_tree, standing_views
from strandwork.plans.registry import query
from strandwork.session import kept, materialize
from strandwork.sources import derived as D


@query("l1_appended_records", "SELECT sha256(text) AS record_id, count(*) AS copies FROM documents GROUP BY 1 HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def appended_records(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("record_id"))
    fresh = C.new_records(docs, docs.where("doc_id % 3 = 0"), "record_id").select("record_id")
    return docs.groupBy("record_id").agg(F.count("*").alias("copies")).join(fresh, "record_id", "left_semi")


@query("l2_cache_lookup", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS cached FROM documents")
def cache_lookup(spark, d):
    have = D.table(spark, d, "labels").select("doc_id", F.lit(True).alias("hit"))
    return D.table(spark, d, "documents").select("doc_id").join(have, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("cached"))


@query("l3_active_records", tree("SELECT scope_id, kind, min(statement_text) AS text FROM decls WHERE statement_text IS NOT NULL GROUP BY ALL HAVING count(DISTINCT statement_text) = 1"))
def active_records(spark, d):
    rows = D.decls(spark, d).where("statement_text IS NOT NULL").select("scope_id", "kind", F.col("statement_text").alias("text"))
    return C.active(rows, ["scope_id", "kind"], "text")


@query("l4_record_integrity", "SELECT doc_id FROM documents WHERE n_chars <> length(text) OR doc_id % 50 = 7")
def record_integrity(spark, d):
    """Records whose stored digest or size no longer matches the body."""
    docs = D.table(spark, d, "documents")
    stored = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 50 == 7, F.reverse(F.concat("text", F.lit("x")))).otherwise(F.col("text")), 256).alias("recorded"), F.col("n_chars").alias("size"))
    return docs.select("doc_id", F.sha2("text", 256).alias("now"), F.length("text").alias("length")).join(stored, "doc_id").where(
        "now <> recorded OR length <> size").select("doc_id")


@query("l5_published_blocks", tree("""
SELECT ref, CASE WHEN ref % 3 = 0 THEN 'added' WHEN ref % 7 = 1 AND ref % 2 = 0 THEN 'conflict' ELSE 'kept' END AS fate FROM decls WHERE ref % 3 <> 0 OR ref % 2 = 0"""))
def published_blocks(spark, d):
    rows = D.decls(spark, d)
    old = rows.where("ref % 3 <> 0").select("ref", F.col("name").alias("body"))
    new = rows.where("ref % 2 = 0").select("ref", F.when(F.col("ref") % 7 == 1, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("body"))
    return C.publish(old, new, "ref", "body").select("ref", "fate")


BLOCKS = """
blocks AS (SELECT node, 'lead_in' AS part, 'In ' || title AS text FROM nodes WHERE kind <> 'unit' UNION ALL SELECT node, 'synopsis', title || chr(10) || kind FROM nodes WHERE kind <> 'unit'
 UNION ALL SELECT node, 'lead_out', CASE WHEN length(title) % 2 = 0 THEN '' ELSE 'Out' END FROM nodes WHERE kind <> 'unit'
 UNION ALL SELECT node, 'statement', title FROM nodes WHERE kind = 'unit' UNION ALL SELECT node, 'proof', CASE WHEN length(title) % 3 = 0 THEN '' ELSE kind END FROM nodes WHERE kind = 'unit'),
seg AS (SELECT s.view, s.node, b.part, w.sort_path || [CASE b.part WHEN 'lead_in' THEN -2 WHEN 'synopsis' THEN -1 WHEN 'statement' THEN -1 WHEN 'proof' THEN 0 ELSE 4611686018427387904 END] AS key,
  CASE WHEN b.text = '' THEN 0 ELSE length(b.text) - length(replace(b.text, chr(10), '')) + 1 END AS n, length(b.text) AS chars
  FROM shown s JOIN blocks b ON b.node = s.node JOIN walk w ON w.node = s.node WHERE b.part <> 'synopsis' OR EXISTS (SELECT 1 FROM front f WHERE f.view = s.view AND f.node = s.node)),
lined AS (SELECT *, sum(CASE WHEN n > 0 THEN n + 1 ELSE 0 END) OVER (PARTITION BY view ORDER BY key) AS upto FROM seg),
rendered AS (SELECT view, node, part, (upto - CASE WHEN n > 0 THEN n + 1 ELSE 0 END + 1)::BIGINT AS start_line, (upto - CASE WHEN n > 0 THEN n + 1 ELSE 0 END + n)::BIGINT AS end_line, chars FROM lined)"""
RENDER = (TREE, CLOSURE, POS, PATHS, VIEWS, BLOCKS)


def shown_and_front(spark, d):
    """Visible and frontier nodes of the readers that stand for others, and who they stand for."""
    def build():
        nodes, closure = full_closure(spark, d)
        readers, views, expanded = standing_views(spark, d)
        shown = materialize(T.visible(nodes, closure, views, expanded))
        return shown, materialize(T.frontier(shown, nodes, expanded)), readers

    return kept(spark, ("shown", d), build)


def blocks(spark, d):
    nodes = full_closure(spark, d)[0]
    section, unit = nodes.where("kind <> 'unit'"), nodes.where("kind = 'unit'")
    row = lambda df, part, text: df.select("node", F.lit(part).alias("part"), text.alias("text"))
    return (row(section, "lead_in", F.concat(F.lit("In "), "title")).unionAll(row(section, "synopsis", F.concat("title", F.lit("\n"), "kind")))
            .unionAll(row(section, "lead_out", F.when(F.length("title") % 2 == 0, "").otherwise("Out"))).unionAll(row(unit, "statement", F.col("title")))
            .unionAll(row(unit, "proof", F.when(F.length("title") % 3 == 0, "").otherwise(F.col("kind")))))


def rendered(spark, d):
    def build():
        placed, closure = placed_tree(spark, d)
        shown, front, readers = shown_and_front(spark, d)
        return materialize(C.render(shown, front, T.position_paths(placed, closure).select("node", "sort_path"), blocks(spark, d))), readers

    return kept(spark, ("rendered", d), build)


@query("l6_rendered_views", tree("SELECT view, node, part, start_line, end_line FROM rendered", *RENDER, recursive=True))
def rendered_views(spark, d):
    return T.for_alike(*rendered(spark, d))


@query("l7_display_length", tree("SELECT view, sum(chars)::BIGINT AS length, sum(chars) > 400 AS over_budget FROM rendered GROUP BY view", *RENDER, recursive=True))
def display_length(spark, d):
    size = F.sum(F.length("text"))
    rows, readers = rendered(spark, d)
    return T.for_alike(materialize(rows.join(blocks(spark, d), ["node", "part"]).groupBy("view").agg(size.alias("length"), (size > 400).alias("over_budget"))), readers)


@query("l15_text_page", tree("SELECT view, node, part FROM rendered WHERE end_line >= 3 AND start_line <= 8 AND end_line >= start_line", *RENDER, recursive=True))
def text_page(spark, d):
    """Segments that overlap lines 3 to 8."""
    rows, readers = rendered(spark, d)
    return T.for_alike(rows.where("end_line >= 3 AND start_line <= 8 AND end_line >= start_line").select("view", "node", "part"), readers)


@query("l8_overview", graph("""
SELECT a.view, a.node AS from_node, b.node AS to_node, count(*) AS pair_count FROM edges e
JOIN closure p ON p.node = 'u:' || e.provider JOIN front a ON a.node = p.ancestor JOIN closure c ON c.node = 'u:' || e.consumer JOIN front b ON b.node = c.ancestor AND b.view = a.view
WHERE a.node <> b.node GROUP BY ALL""", TREE, CLOSURE, VIEWS, recursive=True))
def overview(spark, d):
    """Edges between the frontier nodes of every view.

    Edges are folded once to every pair of tree nodes on the two root paths that a
    frontier can pick, so a view joins node pairs and never base edges.
    """
    from strandwork.plans.q_features import parted

    _, front, readers = shown_and_front(spark, d)
    _, p = parted(spark, d)
    rest = lambda c: F.slice(F.col(c), F.col("k") + 1, F.size(c))
    used = front.select("node").distinct()
    pairs = p.where("k > 0").select(F.explode(rest("pp")).alias("from_node"), rest("cp").alias("cs")).select("from_node", F.explode("cs").alias("to_node")).join(
        used.withColumnRenamed("node", "from_node"), "from_node", "left_semi").join(used.withColumnRenamed("node", "to_node"), "to_node", "left_semi").groupBy(
        "from_node", "to_node").agg(F.count("*").alias("pair_count"))
    a, b = front.select("view", F.col("node").alias("from_node")), front.select("view", F.col("node").alias("to_node"))
    return T.for_alike(materialize(pairs.join(a, "from_node").join(b, ["view", "to_node"]).select("view", "from_node", "to_node", "pair_count")), readers)


@query("l9_inspected_members", tree("SELECT scope_id, ref, name, row_number() OVER (PARTITION BY scope_id ORDER BY name, ref) - 1 AS place, count(*) OVER (PARTITION BY scope_id) AS total FROM decls QUALIFY place < 5"))
def inspected_members(spark, d):
    rows = D.decls(spark, d).select("scope_id", "ref", "name")
    return C.page(rows, ["scope_id"], ["name", "ref"], 0, 5).select("scope_id", "ref", "name", "place", "total")


@query("l9_inspected_lines", f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE line_no BETWEEN 2 AND 4")
def inspected_lines(spark, d):
    return D.lines(spark, d).where("line_no BETWEEN 2 AND 4")


@query("l10_exposures", "SELECT user_id, event_type, count(*) AS exposures, min(event_id) AS first FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")
def exposures(spark, d):
    return D.table(spark, d, "events").where("event_type IN ('view', 'click')").groupBy("user_id", "event_type").agg(F.count("*").alias("exposures"), F.min("event_id").alias("first"))


@query("l11_instances", tree("SELECT repo_key, count(*) AS declarations, count(*) FILTER (outcome) AS outcomes, count(DISTINCT scope_id) AS modules FROM decls GROUP BY repo_key"))
def instances(spark, d):
    per = D.decls(spark, d).groupBy("repo_key", "scope_id").agg(F.count("*").alias("n"), F.count_if("outcome").alias("o"))
    return per.groupBy("repo_key").agg(F.sum("n").alias("declarations"), F.sum("o").alias("outcomes"), F.count("*").alias("modules"))


@query("l12_submission_targets", tree("""
SELECT s.job, s.ref FROM (SELECT 's:' || l_suppkey AS job, l_partkey AS ref FROM lineitem GROUP BY ALL) s WHERE NOT EXISTS (SELECT 1 FROM decls d JOIN decls o ON o.folder_id = d.folder_id WHERE d.scope_id = s.job AND o.ref = s.ref)"""))
def submission_targets(spark, d):
    """Targets that lie outside the folder a job may speak about."""
    asked = D.table(spark, d, "lineitem").select(F.concat(F.lit("s:"), "l_suppkey").alias("job"), F.col("l_partkey").alias("ref")).distinct()
    decls = D.decls(spark, d)
    home = decls.select(F.col("scope_id").alias("job"), F.col("folder_id").alias("allowed")).distinct()
    at = decls.select("ref", "folder_id")
    return asked.join(home, "job", "left").join(at, "ref", "left").where("allowed IS NULL OR folder_id IS NULL OR allowed <> folder_id").select("job", "ref")


@query("l13_junction_cover", """
WITH p AS (SELECT conv_id, turn AS a, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, a, b, 'missing' AS side FROM p WHERE b IS NOT NULL AND a % 4 = 2""")
def junction_cover(spark, d):
    """Neighbouring pairs against the junction rows that were written for them."""
    pairs = materialize(adjacent_pairs(D.table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], "turn").select("conv_id", F.col("before").alias("a"), F.col("after").alias("b")))
    return Q.set_difference(pairs, pairs.where("a % 4 <> 2"), ["conv_id", "a", "b"])


@query("l14_label_contract", f"""WITH {LABELS} SELECT doc_id AS sample_id, 'uncovered' AS rule FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT sample_id, 'label_not_allowed' FROM said WHERE first = 'uncertain'""")
def label_contract(spark, d):
    said = D.labels(spark, d)
    gone = D.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id")).join(said, "sample_id", "left_anti")
    return gone.select("sample_id", F.lit("uncovered").alias("rule")).unionAll(said.where(~F.col("first").isin("yes", "no")).select("sample_id", F.lit("label_not_allowed")))


@query("l16_fixed_sources", tree("SELECT ref, coalesce(CASE WHEN technical AND path IS NULL THEN 'fixed' END, CASE WHEN statement_text IS NULL THEN 'missing' ELSE 'source' END) AS provenance FROM decls"))
def fixed_sources(spark, d):
    rows = D.decls(spark, d)
    fixed = rows.where("technical AND path IS NULL").select("ref", F.lit("fixed").alias("fixed"))
    return rows.join(fixed, "ref", "left").select("ref", F.coalesce("fixed", F.when(F.col("statement_text").isNull(), "missing").otherwise("source")).alias("provenance"))


@query("l17_group_preview", tree("""
SELECT parent, child_pos, title, (sum(length(title) + 3) OVER (PARTITION BY parent ORDER BY child_pos) - length(title) - 3)::BIGINT AS starts_at FROM placed WHERE parent IS NOT NULL""", TREE, POS))
def group_preview(spark, d):
    """Pieces of every sibling group's preview text (titles joined by three characters) with the offset each starts at.

    Kept as pieces, since a group may have any number of children.
    """
    placed = placed_tree(spark, d)[0].where("parent IS NOT NULL").select("parent", "child_pos", "title")
    upto = running(placed, ["parent"], ["child_pos"], {"upto": F.length("title") + 3})
    return upto.select("parent", "child_pos", "title", (F.col("upto") - F.length("title") - 3).alias("starts_at"))


@query("g1_card_page", tree("""
SELECT scope_id, ref, place, total, CASE WHEN total > 8 THEN 8 END AS next_offset FROM (SELECT scope_id, ref, row_number() OVER (PARTITION BY scope_id ORDER BY CASE WHEN outcome THEN 0 WHEN local_public THEN 1 ELSE 2 END, ref) - 1 AS place,
 count(*) OVER (PARTITION BY scope_id) AS total FROM decls) WHERE place >= 3 AND place < 8"""))
def card_page(spark, d):
    rows = D.decls(spark, d).select("scope_id", "ref", F.when(F.col("outcome"), 0).when(F.col("local_public"), 1).otherwise(2).alias("tier"))
    return C.page(rows, ["scope_id"], ["tier", "ref"], 3, 5).select("scope_id", "ref", "place", "total", "next_offset")


@query("g2_cursor_page", tree("""
SELECT ref, name, to_base64(json_object('name', name, 'ref', ref)::VARCHAR::BLOB) AS cursor FROM decls WHERE (name, ref) > ('Brand#12', 0) ORDER BY name, ref LIMIT 20"""))
def cursor_page(spark, d):
    """The page after a cursor: a keyset filter instead of an offset."""
    after = F.struct(F.lit("Brand#12").alias("name"), F.lit(0).cast("long").alias("ref"))
    return D.decls(spark, d).select("ref", "name").where(F.struct("name", "ref") > after).orderBy("name", "ref").limit(20).select(
        "ref", "name", F.base64(F.to_json(F.struct("name", "ref")).cast("binary")).alias("cursor"))
