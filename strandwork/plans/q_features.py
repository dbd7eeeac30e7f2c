"""Measurements, interfaces, cards and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.operators import features as X, graph as G, iterate as I, ranking as K, tree as T
from strandwork.operators.order_stats import positions
from strandwork.plans.oracle_base import graph, tree
from strandwork.plans.q_graph import acyclic_pairs
from strandwork.plans.q_tree import CLOSURE, PATHS, POS, TREE, VIEWS, full_closure, placed_tree, scope_tree, standing_views, unit_closure
from strandwork.plans.registry import query
from strandwork.session import kept, materialize
from strandwork.sources import derived as D

# The words counted as category members in the name arrays.
CATEGORY = ("red", "small", "large")

METRICS = """
obs AS (SELECT ref, scope_id, folder_id, root_id, unnest(['formal_statement', 'formal_proof', 'original_statement', 'category_words']) AS metric,
  unnest([CASE WHEN statement_status = 'not_applicable' THEN 0 ELSE length(statement_text) END, CASE WHEN proof_status = 'not_applicable' THEN 0 ELSE length(proof_text) END,
          length(kind), CASE WHEN ref % 4 <> 0 THEN NULL ELSE len(list_filter(string_split(split_part(name, '.', 2), '_'), lambda x: x IN ('red', 'small', 'large'))) END])::DOUBLE AS value
  FROM decls)"""
AGG = """CASE WHEN count(value) = count(*) THEN sum(value) END AS value, coalesce(sum(value), 0) AS observed_sum,
  CASE WHEN count(value) = count(*) THEN 'present' WHEN count(value) > 0 THEN 'partial' ELSE 'missing' END AS status,
  count(value) AS observed_count, count(*) AS total_count, round(count(value) / count(*), 6) AS coverage, min(value) AS minimum, max(value) AS maximum"""


def observations(spark, d):
    decls = D.decls(spark, d)
    words = F.split(F.split("name", r"\.")[1], "_")
    return X.unpivot(decls, ["ref", "scope_id", "folder_id", "root_id"], {
        "formal_statement": X.text_observation("statement_text", "statement_status"),
        "formal_proof": X.text_observation("proof_text", "proof_status"),
        "original_statement": F.length("kind"),
        "category_words": F.when(F.col("ref") % 4 == 0, F.size(F.filter(words, lambda w: w.isin(*CATEGORY))))})


@query("j1_declaration_features", tree("SELECT ref, metric, value FROM obs", METRICS))
def declaration_features(spark, d):
    return observations(spark, d).select("ref", "metric", "value")


@query("b5_text_lengths", tree("SELECT ref, length(name) AS codepoints, statement_status AS status FROM decls"))
def text_lengths(spark, d):
    return D.decls(spark, d).select("ref", F.length("name").alias("codepoints"), F.col("statement_status").alias("status"))


@query("b14_category_counts", tree("SELECT ref, value::BIGINT AS n FROM obs WHERE metric = 'category_words' AND value IS NOT NULL", METRICS))
def category_counts(spark, d):
    return observations(spark, d).where("metric = 'category_words' AND value IS NOT NULL").select("ref", F.col("value").cast("long").alias("n"))


@query("j11_sample_rows_with_reasons", tree("""
SELECT ref, value, CASE WHEN value IS NULL THEN 'no compiled observation' END AS reason FROM obs WHERE metric = 'category_words'""", METRICS))
def sample_rows(spark, d):
    return observations(spark, d).where("metric = 'category_words'").select(
        "ref", "value", F.when(F.col("value").isNull(), "no compiled observation").alias("reason"))


@query("e5_observation_aggregate", tree(f"SELECT scope_id AS node, metric, {AGG} FROM obs GROUP BY ALL", METRICS))
def observation_aggregate(spark, d):
    return X.aggregate(observations(spark, d), ["scope_id", "metric"]).withColumnRenamed("scope_id", "node")


@query("e5_empty_groups", tree(f"""
SELECT s.scope_id AS node, coalesce(a.coverage, 1) AS coverage, coalesce(a.total_count, 0) AS total_count FROM scopes s
LEFT JOIN (SELECT folder_id, {AGG} FROM obs WHERE metric = 'formal_statement' GROUP BY folder_id) a ON a.folder_id = s.scope_id WHERE s.kind = 'folder'""", METRICS))
def empty_groups(spark, d):
    one = X.aggregate(observations(spark, d).where("metric = 'formal_statement'"), ["folder_id"])
    folders = D.scopes(spark, d).where("kind = 'folder'").select(F.col("scope_id").alias("folder_id"))
    return X.empty_as_covered(folders, one, ["folder_id"]).select(F.col("folder_id").alias("node"), "coverage", "total_count")


@query("j2_node_features", tree(f"""
SELECT node, metric, {AGG} FROM (SELECT scope_id AS node, metric, value FROM obs UNION ALL SELECT folder_id, metric, value FROM obs
UNION ALL SELECT root_id, metric, value FROM obs) GROUP BY ALL""", METRICS))
def node_features(spark, d):
    rows = observations(spark, d).select("metric", "value", F.explode(F.array("scope_id", "folder_id", "root_id")).alias("node"))
    return X.aggregate(rows, ["node", "metric"])


@query("d20_compiled_rows", tree("SELECT d.ref, d.name, o.value AS words FROM decls d LEFT JOIN (SELECT * FROM obs WHERE metric = 'category_words' AND value IS NOT NULL) o ON o.ref = d.ref", METRICS))
def compiled_rows(spark, d):
    rows = observations(spark, d).where("metric = 'category_words' AND value IS NOT NULL").select("ref", F.col("value").alias("words"))
    return D.decls(spark, d).select("ref", "name").join(rows, "ref", "left")


INTERFACE = """
px AS (SELECT ref, unnest([root_id, folder_id, scope_id, 'u:' || ref]) AS node, unnest([0, 1, 2, 3]) AS lvl FROM decls),
em AS (SELECT e.provider, e.consumer, p.node, 'p' AS mark FROM edges e JOIN px p ON p.ref = e.provider
       UNION ALL SELECT e.provider, e.consumer, c.node, 'c' FROM edges e JOIN px c ON c.ref = e.consumer),
cls AS (SELECT node, provider, consumer, CASE WHEN count(*) = 2 THEN 'internal' WHEN max(mark) = 'p' THEN 'outgoing' ELSE 'incoming' END AS side FROM em GROUP BY node, provider, consumer),
crs AS (SELECT i.node, i.provider, i.consumer FROM cls i JOIN px a ON a.ref = i.provider AND a.node = i.node
        JOIN px p ON p.ref = i.provider AND p.lvl = a.lvl + 1 JOIN px c ON c.ref = i.consumer AND c.lvl = a.lvl + 1
        WHERE i.side = 'internal' AND p.node <> c.node),
main AS (SELECT node, provider AS ref FROM cls WHERE side <> 'internal' UNION SELECT node, provider FROM crs UNION SELECT node, consumer FROM crs
         UNION SELECT px.node, px.ref FROM px JOIN decls d ON d.ref = px.ref WHERE d.outcome),
bare AS (SELECT px.node, px.ref, d.local_public, EXISTS (SELECT 1 FROM cls WHERE cls.node = px.node AND cls.provider = px.ref AND cls.side = 'internal') AS eaten
         FROM px JOIN decls d ON d.ref = px.ref WHERE px.node NOT IN (SELECT node FROM main)),
tiered AS (SELECT node, ref, CASE WHEN local_public THEN 1 WHEN NOT eaten THEN 2 ELSE 3 END AS tier FROM bare),
iface AS (SELECT * FROM main UNION ALL SELECT node, ref FROM tiered t WHERE tier = (SELECT min(tier) FROM tiered u WHERE u.node = t.node))"""


def parted(spark, d):
    def build():
        _, closure = scope_tree(spark, d)
        paths = materialize(unit_closure(spark, d, closure))
        return paths, materialize(X.parted_edges(acyclic_pairs(spark, d), paths))

    return kept(spark, ("parted", d), build)


def interfaces(spark, d):
    paths, p = parted(spark, d)
    decls = D.decls(spark, d)
    return X.node_interfaces(p, paths, decls.where("outcome"), decls.where("local_public"))


@query("j3_node_interface_counts", graph("""
SELECT c.node, count(*) FILTER (side = 'internal') AS internal_pairs, count(*) FILTER (side = 'incoming') AS incoming_pairs,
 count(*) FILTER (side = 'outgoing') AS outgoing_pairs, (SELECT count(*) FROM crs x WHERE x.node = c.node) AS cross_child_pairs FROM cls c GROUP BY c.node""", INTERFACE))
def interface_counts(spark, d):
    return X.node_interface_counts(parted(spark, d)[1])


@query("j3_node_interfaces", graph("SELECT node, ref FROM iface", INTERFACE))
def node_interfaces(spark, d):
    return interfaces(spark, d)


MATERIAL = """
material AS (SELECT i.node, CASE WHEN count(statement_text) = count(*) THEN sum(length(statement_text)) END AS material,
                    round(count(statement_text) / count(*), 6) AS coverage
             FROM iface i JOIN decls d ON d.ref = i.ref WHERE i.node NOT LIKE 'u:%' GROUP BY i.node
             UNION ALL SELECT 'u:' || ref, CASE WHEN statement_text IS NOT NULL THEN length(statement_text) + coalesce(length(proof_text), 0) END,
                    CASE WHEN statement_text IS NULL THEN 0.5 ELSE 1 END FROM decls)"""


def materials(spark, d):
    decls = D.decls(spark, d)
    own = decls.select("ref", X.text_observation("statement_text", "statement_status").alias("s"), X.text_observation("proof_text", "proof_status").alias("p"))
    sections = X.aggregate(interfaces(spark, d).where("node NOT LIKE 'u:%'").join(own, "ref"), ["node"], "s")
    half = F.when(F.col("s").isNull(), 1).otherwise(2) / 2 - F.when(F.col("p").isNull(), 0.5).otherwise(0)
    units = own.select(F.concat(F.lit("u:"), "ref").alias("node"), (F.col("s") + F.col("p")).alias("material"), half.alias("coverage"))
    return sections.select("node", F.col("value").alias("material"), "coverage").unionAll(units)


@query("j4_cost_material", graph("SELECT node, material::DOUBLE AS material, coverage::DOUBLE AS coverage FROM material", INTERFACE, MATERIAL))
def cost_material(spark, d):
    return materials(spark, d)


@query("j5_declaration_cards", tree("""
SELECT d.ref, d.name, d.module, d.kind, d.statement_text, d.outcome, d.local_public, g.name AS generated_from_name FROM decls d LEFT JOIN decls g ON g.ref = d.generated_from"""))
def declaration_cards(spark, d):
    decls = D.decls(spark, d)
    return decls.select("ref", "name", "module", "kind", "statement_text", "outcome", "local_public", "generated_from").join(
        decls.select(F.col("ref").alias("generated_from"), F.col("name").alias("generated_from_name")), "generated_from", "left").drop("generated_from")


@query("j6_scope_view", graph("""
SELECT grp, side, part, evidence_kind, count(*) AS n FROM (
 SELECT p.scope_id AS grp, CASE WHEN p.scope_id = c.scope_id THEN 'internal' ELSE 'outgoing' END AS side, part, evidence_kind
 FROM occ o JOIN decls p ON p.ref = o.provider JOIN decls c ON c.ref = o.consumer
 UNION ALL SELECT c.scope_id, 'incoming', part, evidence_kind FROM occ o JOIN decls p ON p.ref = o.provider JOIN decls c ON c.ref = o.consumer WHERE p.scope_id <> c.scope_id)
GROUP BY ALL"""))
def scope_view(spark, d):
    owner = D.decls(spark, d).select("ref", F.col("scope_id").alias("grp"))
    met = G.owned(G.distinct_evidence(D.occurrences(spark, d)), owner)
    same = F.col("from_grp") == F.col("to_grp")
    sides = F.when(same, F.array(F.struct(F.col("from_grp").alias("grp"), F.lit("internal").alias("side")))).otherwise(
        F.array(F.struct(F.col("from_grp").alias("grp"), F.lit("outgoing").alias("side")), F.struct(F.col("to_grp").alias("grp"), F.lit("incoming").alias("side"))))
    return met.select(F.explode(sides).alias("s"), "part", "evidence_kind", "n").groupBy(
        F.col("s.grp").alias("grp"), F.col("s.side").alias("side"), "part", "evidence_kind").agg(F.sum("n").alias("n"))


@query("j7_writing_view", graph("""
SELECT node, ref FROM (
  SELECT i.node, i.ref FROM iface i UNION SELECT px.node, px.ref FROM px JOIN decls d ON d.ref = px.ref WHERE d.local_public
  UNION SELECT px.node, min(px.ref) FROM px GROUP BY px.node) WHERE node LIKE 'n:%'""", INTERFACE))
def writing_view(spark, d):
    """Refs shown when writing a folder: interface, public members and a representative."""
    paths, _ = parted(spark, d)
    members = paths.select("ref", F.explode("path").alias("node")).where("node LIKE 'n:%'")
    public = members.join(D.decls(spark, d).where("local_public").select("ref"), "ref", "left_semi").select("node", "ref")
    lead = members.groupBy("node").agg(F.min("ref").alias("ref"))
    return interfaces(spark, d).where("node LIKE 'n:%'").unionAll(public).unionAll(lead).distinct()


@query("j8_incidence_codes", graph("""
SELECT scope_id, ref, dense_rank() OVER (PARTITION BY scope_id ORDER BY ref) - 1 AS code FROM (
 SELECT p.scope_id, e.provider AS ref FROM edges e JOIN decls p ON p.ref = e.provider JOIN decls c ON c.ref = e.consumer AND c.scope_id = p.scope_id
 UNION SELECT p.scope_id, e.consumer FROM edges e JOIN decls p ON p.ref = e.provider JOIN decls c ON c.ref = e.consumer AND c.scope_id = p.scope_id)"""))
def incidence_codes(spark, d):
    owner = D.decls(spark, d).select("ref", F.col("scope_id").alias("grp"))
    inner = G.internal_edges(acyclic_pairs(spark, d), owner)
    refs = inner.select(F.col("grp").alias("scope_id"), F.explode(F.array("provider", "consumer")).alias("ref")).distinct()
    return positions(refs, ["scope_id"], ["ref"], "code")


@query("j8_repeated_text", tree("SELECT statement_text, count(*) AS uses FROM decls WHERE statement_text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"))
def repeated_text(spark, d):
    return D.decls(spark, d).where("statement_text IS NOT NULL").groupBy("statement_text").agg(F.count("*").alias("uses")).where("uses > 1")


@query("j9_text_inputs", tree("""
SELECT ref, statement_text IS NOT NULL AND kind <> 'PROMO' AS need_statement, proof_text IS NOT NULL AND kind <> 'PROMO' AS need_proof,
 coalesce(length(statement_text), 0) + coalesce(length(proof_text), 0) AS input_size FROM decls"""))
def text_inputs(spark, d):
    wanted = F.col("kind") != "PROMO"
    return D.decls(spark, d).select("ref", (F.col("statement_text").isNotNull() & wanted).alias("need_statement"),
                                    (F.col("proof_text").isNotNull() & wanted).alias("need_proof"),
                                    (F.coalesce(F.length("statement_text"), F.lit(0)) + F.coalesce(F.length("proof_text"), F.lit(0))).alias("input_size"))


@query("j10_atom_cards", tree("""
SELECT scope_id, string_agg(ref::VARCHAR, ',' ORDER BY ref) AS first_members, max(n) AS members FROM (
 SELECT scope_id, ref, row_number() OVER (PARTITION BY scope_id ORDER BY ref) AS rn, count(*) OVER (PARTITION BY scope_id) AS n FROM decls) WHERE rn <= 3 GROUP BY scope_id"""))
def atom_cards(spark, d):
    from pyspark.sql import Window

    decls = D.decls(spark, d).select("scope_id", "ref")
    first = decls.withColumn("rn", F.row_number().over(Window.partitionBy("scope_id").orderBy("ref"))).where("rn <= 3").groupBy("scope_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("ref")), lambda x: x.cast("string")), ",").alias("first_members"))
    return first.join(decls.groupBy("scope_id").agg(F.count("*").alias("members")), "scope_id")


@query("j12_fixed_entries", tree("""
SELECT ref, 'Auxiliary entry: ' || substr(list_extract(string_split(name, '.'), -1), 1, 32) AS title FROM decls WHERE technical AND path IS NULL"""))
def fixed_entries(spark, d):
    last = F.element_at(F.split("name", r"\."), -1)
    return D.decls(spark, d).where("technical AND path IS NULL").select("ref", F.concat(F.lit("Auxiliary entry: "), F.substring(last, 1, 32)).alias("title"))


@query("j13_child_plan", tree("SELECT parent, child_pos, node, title FROM placed WHERE parent IS NOT NULL", TREE, POS))
def child_plan(spark, d):
    return placed_tree(spark, d)[0].where("parent IS NOT NULL").select("parent", "child_pos", "node", "title")


@query("e28_writing_preflight", graph("""
SELECT i.node, count(*) AS cards, coalesce(sum(length(statement_text)), 0)::BIGINT AS size, coalesce(sum(length(statement_text)), 0) > 2000 AS over_budget
FROM iface i JOIN decls d ON d.ref = i.ref GROUP BY i.node""", INTERFACE))
def writing_preflight(spark, d):
    size = F.coalesce(F.sum(F.length("statement_text")), F.lit(0))
    return interfaces(spark, d).join(D.decls(spark, d).select("ref", "statement_text"), "ref").groupBy("node").agg(
        F.count("*").alias("cards"), size.alias("size"), (size > 2000).alias("over_budget"))


@query("e30_shared_interfaces", graph("SELECT ref, count(DISTINCT node) AS children FROM iface WHERE node LIKE 's:%' GROUP BY ref HAVING count(DISTINCT node) > 1", INTERFACE))
def shared_interfaces(spark, d):
    return interfaces(spark, d).where("node LIKE 's:%'").distinct().groupBy("ref").agg(F.count("*").alias("children")).where("children > 1")


TARGETS = """
ip AS (SELECT e.provider, e.consumer, p.root_id AS root FROM edges e JOIN decls p ON p.ref = e.provider JOIN decls c ON c.ref = e.consumer WHERE p.root_id = c.root_id),
tgt(root, ref) AS (SELECT root_id, ref FROM decls WHERE outcome UNION SELECT t.root, ip.provider FROM tgt t JOIN ip ON ip.consumer = t.ref)"""


def target_units(spark, d):
    """Outcomes and their providers inside each repository."""
    def build():
        _, p = parted(spark, d)
        back = materialize(p.where("k > 0").select(F.col("consumer").alias("provider"), F.col("provider").alias("consumer")))
        seeds = D.decls(spark, d).where("outcome").select(F.col("ref").alias("node"))
        return materialize(I.reach(back, seeds).select(F.col("node").alias("ref")))

    return kept(spark, ("targets", d), build)


@query("k1_target_units", graph("SELECT ref FROM tgt", TARGETS, recursive=True))
def k1_target_units(spark, d):
    return target_units(spark, d)


def node_facts(spark, d):
    def build():
        placed, closure = placed_tree(spark, d)
        paths, p = parted(spark, d)
        targets = target_units(spark, d)
        members = paths.select("ref", F.col("path")[0].alias("root"), F.explode("path").alias("node")).join(
            targets.withColumn("t", F.lit(1)), "ref", "left").groupBy("node").agg(
            F.count("*").alias("units"), F.count("t").alias("targets"))
        totals = K.pair_totals(p.where("k > 0"), targets)
        ranks = positions(T.position_paths(placed, closure), [], ["sort_path"], "source_rank").select("node", "source_rank")
        roots = closure.join(placed.where("parent IS NULL").select(F.col("node").alias("ancestor")), "ancestor").select("node", F.col("ancestor").alias("root"))
        facts = placed.select("node", "kind").join(roots, "node").join(members, "node", "left").join(totals, "node", "left").join(
            materials(spark, d).select("node", "material"), "node", "left").join(ranks, "node").fillna(0, ["units", "targets", "pairs", "separable"])
        return materialize(facts), materialize(facts.where("node = root").select("root", F.col("targets").alias("target_count")))

    return kept(spark, ("node facts", d), build)


FACTS = """
nf AS (SELECT n.node, n.kind, (SELECT count(*) FROM closure c JOIN nodes u ON u.node = c.node AND u.kind = 'unit' WHERE c.ancestor = n.node) AS units, m.material
       FROM nodes n LEFT JOIN material m ON m.node = n.node),
deg AS (SELECT consumer, count(*) AS in_pairs FROM ip GROUP BY consumer),
newvis AS (SELECT f.view, f.node AS cand, c.node FROM front f JOIN nodes k ON k.node = f.node AND k.kind <> 'unit' JOIN closure c ON c.ancestor = f.node AND c.depth > 0
  WHERE NOT EXISTS (SELECT 1 FROM closure m JOIN closure q ON q.node = m.ancestor AND q.ancestor = f.node AND q.depth > 0
                    WHERE m.node = c.node AND m.depth > 0 AND NOT EXISTS (SELECT 1 FROM expanded e WHERE e.view = f.view AND e.node = m.ancestor))),
nw AS (SELECT v.* FROM newvis v WHERE v.node LIKE 'u:%' OR NOT EXISTS (SELECT 1 FROM expanded e WHERE e.view = v.view AND e.node = v.node)),
ntgt AS (SELECT c.ancestor AS node, count(*) AS t FROM tgt JOIN closure c ON c.node = 'u:' || tgt.ref GROUP BY 1),
rt AS (SELECT root, count(*) AS n FROM tgt GROUP BY root),
croot AS (SELECT c.node, c.ancestor AS root FROM closure c WHERE c.ancestor LIKE 'r:%'),
gd AS (SELECT nw.view, nw.cand, sum(CASE WHEN w.units > 0 THEN coalesce(t.t, 0) * (1.0 / w.units - 1.0 / c.units) ELSE 0 END) AS g
       FROM nw JOIN nf w ON w.node = nw.node JOIN nf c ON c.node = nw.cand LEFT JOIN ntgt t ON t.node = nw.node GROUP BY ALL),
inside AS (SELECT p.ancestor AS node, count(*) AS pairs, sum(1.0 / deg.in_pairs) AS sep FROM ip JOIN tgt ON tgt.ref = ip.consumer AND tgt.root = ip.root
           JOIN deg ON deg.consumer = ip.consumer JOIN closure p ON p.node = 'u:' || ip.provider JOIN closure q ON q.node = 'u:' || ip.consumer AND q.ancestor = p.ancestor
           GROUP BY 1),
dep AS (SELECT nw.view, nw.cand, sum(coalesce(i.pairs, 0)) AS pairs, sum(coalesce(i.sep, 0)) AS sep FROM nw LEFT JOIN inside i ON i.node = nw.node GROUP BY ALL),
cost AS (SELECT v.view, v.cand, greatest(120, sum(CASE WHEN material IS NULL OR material > 3000 THEN 1200 WHEN material > 800 THEN 600 ELSE 240 END)) AS cost,
                bool_or(material IS NULL) AS missing FROM newvis v JOIN nf ON nf.node = v.node GROUP BY ALL),
scored AS (SELECT gd.view, gd.cand AS candidate, coalesce(round(g / rt.n, 9), 0) AS gain_decl,
       coalesce(round((coalesce(ci.sep, 0) - dep.sep) / rt.n, 9), 0) AS gain_dep, (coalesce(ci.pairs, 0) - dep.pairs)::BIGINT AS new_pairs, cost.cost::BIGINT AS cost,
       CASE WHEN missing THEN 2 WHEN cost.cost <= 600 THEN 0 WHEN cost.cost <= 1600 THEN 1 ELSE 2 END AS tier
  FROM gd JOIN dep ON dep.view = gd.view AND dep.cand = gd.cand JOIN cost ON cost.view = gd.view AND cost.cand = gd.cand
  JOIN croot r ON r.node = gd.cand LEFT JOIN rt ON rt.root = r.root LEFT JOIN inside ci ON ci.node = gd.cand)"""
RANK_PARTS = (TREE, CLOSURE, VIEWS, INTERFACE, MATERIAL, TARGETS, FACTS)


def candidates(spark, d):
    """Candidates of the readers that stand for others, their expansion sets, and who they stand for."""
    nodes, closure = full_closure(spark, d)
    readers, views, expanded = standing_views(spark, d)
    front = T.frontier(T.visible(nodes, closure, views, expanded), nodes, expanded)
    parents = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    return front.join(parents, "node", "left_semi").select("view", F.col("node").alias("candidate")), expanded, readers


def scored(spark, d):
    """Scores of the readers that stand for others, and who they stand for."""
    def build():
        nodes, closure = full_closure(spark, d)
        cand, expanded, readers = candidates(spark, d)
        cand = materialize(cand)
        facts, targets = node_facts(spark, d)
        return materialize(K.score(K.newly_visible(nodes, closure, expanded, cand), expanded, facts, targets)), readers

    return kept(spark, ("scored", d), build)


@query("k2_declaration_gain", graph("SELECT view, candidate, gain_decl FROM scored", *RANK_PARTS, recursive=True))
def declaration_gain(spark, d):
    rows, readers = scored(spark, d)
    return T.for_alike(rows.select("view", "candidate", "gain_decl"), readers)


@query("k3_dependency_gain", graph("SELECT view, candidate, gain_dep, new_pairs FROM scored", *RANK_PARTS, recursive=True))
def dependency_gain(spark, d):
    rows, readers = scored(spark, d)
    return T.for_alike(rows.select("view", "candidate", "gain_dep", "new_pairs"), readers)


@query("k4_planned_cost", graph("SELECT view, candidate, cost, tier FROM scored", *RANK_PARTS, recursive=True))
def planned_cost(spark, d):
    rows, readers = scored(spark, d)
    return T.for_alike(rows.select("view", "candidate", "cost", "tier"), readers)


@query("k5_scored_candidates", graph("SELECT view, candidate, tier, gain_decl, gain_dep FROM scored", *RANK_PARTS, recursive=True))
def scored_candidates(spark, d):
    rows, readers = scored(spark, d)
    return T.for_alike(rows.select("view", "candidate", "tier", "gain_decl", "gain_dep"), readers)


@query("g3_structural_ranking", graph("""
SELECT view, candidate, row_number() OVER (PARTITION BY view ORDER BY tier, gain_decl DESC, gain_dep DESC, w.rank, candidate) AS rank FROM scored
JOIN (SELECT node, row_number() OVER (ORDER BY sort_path) AS rank FROM walk) w ON w.node = candidate""", *RANK_PARTS, POS, PATHS, recursive=True))
def structural_ranking(spark, d):
    rows, readers = scored(spark, d)
    ranked = positions(rows, ["view"], ["tier", F.desc("gain_decl"), F.desc("gain_dep"), F.col("source_rank"), F.col("candidate")], "rank", 1)
    return T.for_alike(materialize(ranked.select("view", "candidate", "rank")), readers)


@query("g5_top_recommendations", graph("""
SELECT view, candidate, rank FROM (SELECT view, candidate, row_number() OVER (PARTITION BY view ORDER BY tier, gain_decl DESC, gain_dep DESC, w.rank, candidate) AS rank FROM scored
JOIN (SELECT node, row_number() OVER (ORDER BY sort_path) AS rank FROM walk) w ON w.node = candidate) WHERE rank <= 3""", *RANK_PARTS, POS, PATHS, recursive=True))
def top_recommendations(spark, d):
    rows, readers = scored(spark, d)
    return T.for_alike(materialize(K.top(rows, 3).select("view", "candidate", "rank")), readers)


@query("g4_seeded_ranking", tree("""
SELECT f.view, f.node AS candidate, row_number() OVER (PARTITION BY f.view ORDER BY sha256('7:' || f.view || ':' || f.node)) AS rank
FROM front f JOIN nodes n ON n.node = f.node WHERE n.kind <> 'unit' AND f.node IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)""", TREE, CLOSURE, VIEWS, recursive=True))
def seeded_ranking(spark, d):
    cand, _, readers = candidates(spark, d)
    return K.seeded_ranks(cand, readers, "7")


@query("k6_policy_consistency", tree("""
SELECT scope_id AS root, 'a' || (length(name) % 3) AS asked, 'a' || (length(scope_id) % 3) AS built FROM scopes WHERE kind = 'folder' AND length(name) % 3 <> length(scope_id) % 3"""))
def policy_consistency(spark, d):
    """Structures whose asked policy key differs from the one their features were built for."""
    asked = D.scopes(spark, d).where("kind = 'folder'").select(F.col("scope_id").alias("root"), F.concat(F.lit("a"), F.length("name") % 3).alias("asked"))
    built = D.scopes(spark, d).where("kind = 'folder'").select(F.col("scope_id").alias("root"), F.concat(F.lit("a"), F.length("scope_id") % 3).alias("built"))
    return asked.join(built, "root").where("asked <> built")
