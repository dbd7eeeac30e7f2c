"""Edges, boundaries, quotients and set checks on the dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.operators import graph as G
from strandwork.plans.oracle_base import graph, tree
from strandwork.plans.registry import query
from strandwork.sources import derived as D


def acyclic_pairs(spark, d):
    return D.edge_pairs(spark, d)


def repo_members(spark, d):
    return D.decls(spark, d).select(F.col("repo_key").alias("grp"), "ref")


@query("e1_distinct_edges", graph("""
SELECT provider, consumer, count(*) AS occurrences, string_agg(DISTINCT part, ',' ORDER BY part) AS parts,
       string_agg(DISTINCT evidence_kind, ',' ORDER BY evidence_kind) AS kinds
FROM occ GROUP BY provider, consumer"""))
def distinct_edges(spark, d):
    e = G.edges(D.occurrences(spark, d))
    return e.withColumns({"parts": F.array_join("parts", ","), "kinds": F.array_join("kinds", ",")})


@query("e1_edge_evidence", graph("""
SELECT provider, consumer, part, evidence_kind, provider_module, count(*) AS n FROM occ GROUP BY ALL"""))
def edge_evidence(spark, d):
    return G.distinct_evidence(D.occurrences(spark, d))


@query("c1_selected_evidence", graph("""
SELECT provider, consumer, evidence_kind, count(*) AS n FROM occ WHERE evidence_kind = 'lean_type' GROUP BY ALL"""))
def selected_evidence(spark, d):
    return G.select_evidence(D.occurrences(spark, d), ["lean_type", "published"]).groupBy(
        "provider", "consumer", "evidence_kind").agg(F.sum("n").cast("long").alias("n"))


@query("d1_unloaded_refs", graph("""
SELECT DISTINCT provider AS ref FROM edges WHERE provider NOT IN (SELECT ref FROM decls WHERE NOT technical)"""))
def unloaded_refs(spark, d):
    return G.unloaded(acyclic_pairs(spark, d), D.decls(spark, d).where("NOT technical"))


@query("d2_missing_outcomes", tree("""
SELECT ref FROM decls a WHERE outcome AND NOT EXISTS (SELECT 1 FROM decls b WHERE b.ref = a.ref AND statement_status = 'present')"""))
def missing_outcomes(spark, d):
    decls = D.decls(spark, d)
    return decls.where("outcome").select("ref").join(
        decls.where("statement_status = 'present'").select("ref"), "ref", "left_anti")


BOUNDARY = """
touch AS (SELECT d.repo_key AS grp, e.provider, e.consumer,
                 CASE WHEN p.repo_key = c.repo_key THEN 'internal' WHEN d.repo_key = p.repo_key THEN 'outgoing' ELSE 'incoming' END AS side
          FROM edges e JOIN decls p ON p.ref = e.provider JOIN decls c ON c.ref = e.consumer
          JOIN (SELECT DISTINCT repo_key FROM decls) d ON d.repo_key = p.repo_key OR d.repo_key = c.repo_key)"""


@query("e2_repository_boundaries", graph("""
SELECT grp, count(*) FILTER (side = 'incoming') AS incoming_pairs, count(*) FILTER (side = 'outgoing') AS outgoing_pairs,
       count(*) FILTER (side = 'internal') AS internal_pairs,
       count(DISTINCT provider) FILTER (side = 'incoming') AS incoming_providers,
       count(DISTINCT provider) FILTER (side = 'outgoing') AS outgoing_providers
FROM touch GROUP BY grp""", BOUNDARY))
def repository_boundaries(spark, d):
    return G.boundary_counts(G.boundary(acyclic_pairs(spark, d), repo_members(spark, d)))


@query("e2_boundary_declarations", graph("""
SELECT grp, 'input' AS role, provider AS ref FROM touch WHERE side = 'incoming'
UNION SELECT grp, 'output', provider FROM touch WHERE side = 'outgoing'
UNION SELECT repo_key, 'output', ref FROM decls WHERE outcome""", BOUNDARY))
def boundary_declarations(spark, d):
    members = repo_members(spark, d)
    return G.boundary_declarations(G.boundary(acyclic_pairs(spark, d), members), members,
                                   D.decls(spark, d).where("outcome"))


@query("e3_pair_and_provider_counts", graph("""
SELECT s.grp, count(*) AS incoming_pairs, count(DISTINCT provider) AS incoming_providers
FROM (SELECT c.scope_id AS grp, e.provider FROM edges e JOIN decls p ON p.ref = e.provider
      JOIN decls c ON c.ref = e.consumer WHERE p.scope_id <> c.scope_id) s GROUP BY s.grp"""))
def pair_and_provider_counts(spark, d):
    owner = D.decls(spark, d).select("ref", F.col("scope_id").alias("grp"))
    cross = G.owned(acyclic_pairs(spark, d), owner).where("from_grp <> to_grp")
    return cross.groupBy(F.col("to_grp").alias("grp"), "provider").agg(F.count("*").alias("n")).groupBy("grp").agg(
        F.sum("n").alias("incoming_pairs"), F.count("*").alias("incoming_providers"))


def _quotient_sql(col):
    return graph(f"""
SELECT p.{col} AS from_grp, c.{col} AS to_grp, count(*) AS pair_count, count(DISTINCT provider) AS provider_count
FROM edges e JOIN decls p ON p.ref = e.provider JOIN decls c ON c.ref = e.consumer
WHERE p.{col} <> c.{col} GROUP BY ALL""")


@query("e4_quotient_by_module", _quotient_sql("scope_id"))
def quotient_by_module(spark, d):
    return G.quotient(acyclic_pairs(spark, d), D.decls(spark, d).select("ref", F.col("scope_id").alias("grp")))


@query("e4_quotient_by_folder", _quotient_sql("folder_id"))
def quotient_by_folder(spark, d):
    return G.quotient(acyclic_pairs(spark, d), D.decls(spark, d).select("ref", F.col("folder_id").alias("grp")))


@query("e4_internal_edges", graph("""
SELECT p.scope_id AS grp, provider, consumer FROM edges e JOIN decls p ON p.ref = e.provider
JOIN decls c ON c.ref = e.consumer WHERE p.scope_id = c.scope_id"""))
def internal_by_module(spark, d):
    return G.internal_edges(acyclic_pairs(spark, d), D.decls(spark, d).select("ref", F.col("scope_id").alias("grp")))


@query("e4_uncovered", graph("SELECT ref FROM decls WHERE technical"))
def uncovered(spark, d):
    decls = D.decls(spark, d)
    groups = decls.where("NOT technical").select("ref", F.col("scope_id").alias("grp"))
    return decls.select("ref").join(groups, "ref", "left_anti")


@query("d3_external_references", graph("""
SELECT DISTINCT c.repo_key, e.provider AS ref, p.repo_key AS provider_repo, p.name
FROM edges e JOIN decls c ON c.ref = e.consumer
LEFT JOIN (SELECT * FROM decls WHERE NOT technical) p ON p.ref = e.provider
WHERE p.repo_key IS NULL OR p.repo_key <> c.repo_key"""))
def external_references(spark, d):
    decls = D.decls(spark, d)
    refs = acyclic_pairs(spark, d).join(decls.select(F.col("ref").alias("consumer"), "repo_key"), "consumer").select(
        "repo_key", F.col("provider").alias("ref")).distinct()
    loaded = decls.where("NOT technical").select("ref", F.col("repo_key").alias("provider_repo"), "name")
    return refs.join(loaded, "ref", "left").where("provider_repo IS NULL OR provider_repo <> repo_key").select(
        "repo_key", "ref", "provider_repo", "name")


@query("e10_incoming_by_class", graph("""
SELECT d.ref, count(*) FILTER (p.repo_key = d.repo_key AND NOT p.technical) AS internal,
       count(*) FILTER (p.repo_key <> d.repo_key) AS external,
       count(*) FILTER (p.repo_key = d.repo_key AND p.technical) AS unresolved_local
FROM decls d LEFT JOIN edges e ON e.consumer = d.ref LEFT JOIN decls p ON p.ref = e.provider GROUP BY d.ref"""))
def incoming_by_class(spark, d):
    decls = D.decls(spark, d)
    met = acyclic_pairs(spark, d).join(
        decls.select(F.col("ref").alias("provider"), F.col("repo_key").alias("from_repo"), "technical"), "provider").join(
        decls.select(F.col("ref").alias("consumer"), "repo_key"), "consumer")
    same = F.col("from_repo") == F.col("repo_key")
    counts = met.groupBy(F.col("consumer").alias("ref")).agg(
        F.count_if(same & ~F.col("technical")).alias("internal"), F.count_if(~same).alias("external"),
        F.count_if(same & F.col("technical")).alias("unresolved_local"))
    return decls.select("ref").join(counts, "ref", "left").fillna(0, ["internal", "external", "unresolved_local"])


@query("e9_stub_repositories", graph("""
SELECT DISTINCT p.repo_key, 'unresolved' AS version_status, 'provider repository is not loaded' AS unresolved_reason
FROM edges e JOIN decls p ON p.ref = e.provider WHERE p.repo_key NOT IN ('AFRICA', 'ASIA')"""))
def stub_repositories(spark, d):
    loaded = D.repos(spark, d).where(F.col("repo_key").isin("AFRICA", "ASIA"))
    seen = acyclic_pairs(spark, d).select(F.col("provider").alias("ref")).distinct().join(
        D.decls(spark, d).select("ref", "repo_key"), "ref").select("repo_key").distinct()
    return seen.join(loaded, "repo_key", "left_anti").select(
        "repo_key", F.lit("unresolved").alias("version_status"),
        F.lit("provider repository is not loaded").alias("unresolved_reason"))


@query("e29_missing_bodies_per_repository", graph("""
SELECT p.repo_key, count(*) AS missing FROM (SELECT DISTINCT provider FROM edges) e JOIN decls p ON p.ref = e.provider
WHERE p.statement_text IS NULL GROUP BY p.repo_key"""))
def missing_bodies(spark, d):
    return acyclic_pairs(spark, d).select(F.col("provider").alias("ref")).distinct().join(
        D.decls(spark, d).where("statement_text IS NULL").select("ref", "repo_key"), "ref").groupBy("repo_key").agg(
        F.count("*").alias("missing"))


@query("h2_exact_cover", tree("""
SELECT parent AS grp, count(*) AS children, sum(n)::BIGINT AS refs, sum(n)::BIGINT - max(total) AS surplus FROM (
  SELECT s.parent, s.scope_id, count(d.ref) AS n FROM scopes s LEFT JOIN decls d
  ON d.scope_id = s.scope_id OR d.folder_id = s.scope_id WHERE s.parent IS NOT NULL GROUP BY ALL)
JOIN (SELECT folder_id AS g, count(*) AS total FROM decls GROUP BY 1 UNION ALL SELECT root_id, count(*) FROM decls GROUP BY 1) ON g = parent
GROUP BY parent"""))
def exact_cover(spark, d):
    decls = D.decls(spark, d)
    sizes = decls.groupBy(F.col("scope_id").alias("scope_id")).agg(F.count("*").alias("n")).unionAll(
        decls.groupBy("folder_id").agg(F.count("*")))
    totals = decls.groupBy(F.col("folder_id").alias("grp")).agg(F.count("*").alias("total")).unionAll(
        decls.groupBy("root_id").agg(F.count("*")))
    kids = D.scopes(spark, d).where("parent IS NOT NULL").join(sizes, "scope_id", "left").groupBy(
        F.col("parent").alias("grp")).agg(F.count("*").alias("children"), F.coalesce(F.sum("n"), F.lit(0)).alias("refs"))
    return kids.join(totals, "grp").select("grp", "children", "refs", (F.col("refs") - F.col("total")).alias("surplus"))


@query("h3_coverage_conflicts", tree("""
SELECT s.scope_id, count(*) FILTER (native) AS native_only, count(*) FILTER (NOT native) AS reading_only
FROM (SELECT d.scope_id, true AS native FROM decls d JOIN decls g ON g.ref = d.generated_from WHERE d.scope_id <> g.scope_id OR g.technical
      UNION ALL SELECT g.scope_id, false FROM decls d JOIN decls g ON g.ref = d.generated_from WHERE d.scope_id <> g.scope_id OR g.technical) s
GROUP BY s.scope_id"""))
def coverage_conflicts(spark, d):
    """Refs that a scope owns natively but reads elsewhere, counted both ways (a unit keeps what it generated)."""
    decls = D.decls(spark, d)
    moved = decls.where("generated_from IS NOT NULL").select("ref", "scope_id", F.col("generated_from").alias("home")).join(
        decls.select(F.col("ref").alias("home"), F.col("scope_id").alias("home_scope"), F.col("technical").alias("chained")), "home")
    # An owner that is itself generated is read under its own owner, not here.
    away = moved.where("scope_id <> home_scope OR chained")
    return away.select("scope_id", F.lit(True).alias("native")).unionAll(
        away.select("home_scope", F.lit(False))).groupBy("scope_id").agg(
        F.count_if("native").alias("native_only"), F.count_if(~F.col("native")).alias("reading_only"))


@query("h4_edge_set_difference", graph("""
SELECT provider, consumer, 'directed_only' AS side FROM (SELECT * FROM dedges EXCEPT SELECT * FROM edges)
UNION ALL SELECT provider, consumer, 'acyclic_only' FROM (SELECT * FROM edges EXCEPT SELECT * FROM dedges)"""))
def edge_set_difference(spark, d):
    a, b = acyclic_pairs(spark, d), D.edge_pairs(spark, d, directed=True)
    both = ["provider", "consumer"]
    # Both sets meet in one aggregation; pairs with a null end are in none.
    met = b.select(*both, F.lit(True).alias("directed")).unionAll(a.select(*both, F.lit(False))).groupBy(*both).agg(
        F.min("directed").alias("all"), F.max("directed").alias("any"))
    return met.where(F.col("all") == F.col("any")).select(*both, F.when(F.col("any"), "directed_only").otherwise("acyclic_only").alias("side"))


@query("h5_group_overlap", tree("""
SELECT ref, count(*) AS groups FROM (SELECT ref, kind AS g FROM decls UNION SELECT ref, 'PROMO' FROM decls WHERE outcome)
GROUP BY ref HAVING count(*) > 1"""))
def group_overlap(spark, d):
    decls = D.decls(spark, d)
    return G.overlapping(decls.select(F.col("kind").alias("grp"), "ref").unionAll(
        decls.where("outcome").select(F.lit("PROMO"), "ref")))


@query("h6_distinct_refs", graph("SELECT DISTINCT provider AS ref FROM occ"))
def distinct_refs(spark, d):
    return D.occurrences(spark, d).select(F.col("provider").alias("ref")).dropDuplicates()


@query("h7_publication_completeness", tree("""
SELECT repo_key, count(*) AS nodes, count(*) FILTER (statement_status = 'present') AS published,
       count(*) FILTER (statement_status <> 'present') AS missing, bool_and(statement_status = 'present') AS complete
FROM decls GROUP BY repo_key"""))
def publication_completeness(spark, d):
    decls = D.decls(spark, d)
    published = decls.where("statement_status = 'present'").select("ref", F.lit(1).alias("here"))
    return decls.select("ref", "repo_key").join(published, "ref", "left").groupBy("repo_key").agg(
        F.count("*").alias("nodes"), F.count("here").alias("published"),
        (F.count("*") - F.count("here")).alias("missing"), (F.count("*") == F.count("here")).alias("complete"))


@query("i2_repository_views", graph("""
SELECT r.r_name AS repo_key, 'r:' || r_regionkey AS root_scope,
       (SELECT count(*) FROM decls d WHERE d.repo_key = r.r_name) AS declarations,
       count(DISTINCT provider) FILTER (p.repo_key <> r.r_name) AS external_refs,
       count(*) FILTER (p.repo_key <> r.r_name) AS external_pairs
FROM region r JOIN decls c ON c.repo_key = r.r_name JOIN edges e ON e.consumer = c.ref JOIN decls p ON p.ref = e.provider
GROUP BY ALL"""))
def repository_views(spark, d):
    decls = D.decls(spark, d)
    owner = decls.select("ref", F.col("repo_key").alias("grp"))
    cross = G.owned(acyclic_pairs(spark, d), owner).where("from_grp <> to_grp").groupBy(
        F.col("to_grp").alias("repo_key"), "provider").agg(F.count("*").alias("n")).groupBy("repo_key").agg(
        F.count("*").alias("external_refs"), F.sum("n").alias("external_pairs"))
    size = decls.groupBy("repo_key").agg(F.count("*").alias("declarations"))
    return D.repos(spark, d).join(size, "repo_key").join(cross, "repo_key")


@query("i3_scope_children", graph("""
SELECT parent, from_child, to_child, count(*) AS pair_count, count(DISTINCT provider) AS provider_count FROM (
  SELECT p.scope_id AS parent, 'u:' || e.provider AS from_child, 'u:' || e.consumer AS to_child, provider
  FROM edges e JOIN decls p ON p.ref = e.provider JOIN decls c ON c.ref = e.consumer WHERE p.scope_id = c.scope_id
  UNION ALL SELECT p.folder_id, p.scope_id, c.scope_id, provider
  FROM edges e JOIN decls p ON p.ref = e.provider JOIN decls c ON c.ref = e.consumer WHERE p.folder_id = c.folder_id AND p.scope_id <> c.scope_id
  UNION ALL SELECT p.root_id, p.folder_id, c.folder_id, provider
  FROM edges e JOIN decls p ON p.ref = e.provider JOIN decls c ON c.ref = e.consumer WHERE p.root_id = c.root_id AND p.folder_id <> c.folder_id)
GROUP BY ALL"""))
def scope_children(spark, d):
    """Projection of every scope onto its children: an edge shows at the scope where its ends part."""
    from strandwork.operators.tree import sibling_edges
    from strandwork.plans.q_tree import scope_tree, unit_closure

    _, closure = scope_tree(spark, d)
    return sibling_edges(acyclic_pairs(spark, d), unit_closure(spark, d, closure))


@query("d11_edge_owners", graph("""
SELECT provider, consumer, p.scope_id AS from_grp, c.scope_id AS to_grp FROM edges JOIN decls p ON p.ref = provider JOIN decls c ON c.ref = consumer"""))
def edge_owners(spark, d):
    return G.owned(acyclic_pairs(spark, d), D.decls(spark, d).select("ref", F.col("scope_id").alias("grp"))).select("provider", "consumer", "from_grp", "to_grp")
