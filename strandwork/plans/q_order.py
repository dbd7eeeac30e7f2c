"""Sibling order, regions, helper absorption and order statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.operators import graph as G, helpers as H, iterate as I, regions as R, sibling as S, tree as T
from strandwork.operators.order_stats import adjacent_pairs, positions, weighted_quantile
from strandwork.plans.oracle_base import SRC, graph
from strandwork.plans.q_graph import acyclic_pairs
from strandwork.plans.q_tree import scope_tree, tree_nodes, unit_closure
from strandwork.plans.registry import query
from strandwork.session import dealt, kept, materialize
from strandwork.sources import derived as D

PROBLEM = f"""
prob AS (SELECT scope_id AS parent, ref, row_number() OVER (PARTITION BY scope_id ORDER BY {SRC}) - 1 AS rank,
                row_number() OVER (PARTITION BY scope_id ORDER BY ref) - 1 AS pos FROM decls),
pe AS (SELECT p.scope_id AS parent, e.provider, e.consumer FROM edges e JOIN decls p ON p.ref = e.provider
       JOIN decls c ON c.ref = e.consumer WHERE p.scope_id = c.scope_id),
sp AS (SELECT pe.*, a.pos AS fp, b.pos AS tp, b.pos - a.pos AS span FROM pe JOIN prob a ON a.ref = provider JOIN prob b ON b.ref = consumer)"""


def module_problem(spark, d):
    """One order problem per module: declarations by source key, edges inside the module, and the order by id."""
    return kept(spark, ("module problem", d), lambda: _module_problem(spark, d))


def _module_problem(spark, d):
    decls = D.decls(spark, d).select("ref", F.col("scope_id").alias("parent"), D.source_key().alias("k"))
    atom = F.col("ref").cast("string").alias("atom")
    atoms = materialize(positions(decls, ["parent"], ["k"], "rank").select("parent", atom, "rank", "ref"))
    by_id = materialize(positions(atoms, ["parent"], ["ref"], "pos").select("parent", "atom", "pos"))
    owner = D.decls(spark, d).select("ref", F.col("scope_id").alias("grp"))
    edges = G.internal_edges(acyclic_pairs(spark, d), owner).select(
        F.col("grp").alias("parent"), F.col("provider").cast("string").alias("provider"),
        F.col("consumer").cast("string").alias("consumer"), F.lit(1).cast("long").alias("weight"))
    return atoms.select("parent", "atom", "rank"), materialize(edges), by_id


def tree_problem(spark, d):
    """The order problems of all parents of the tree: sibling edges without those inside a cyclic group."""
    return kept(spark, ("tree problem", d), lambda: _tree_problem(spark, d))


def solved_tree(spark, d):
    atoms, edges, _ = tree_problem(spark, d)
    return atoms, edges, kept(spark, ("tree order", d), lambda: S.solve(atoms, edges))


def _tree_problem(spark, d):
    _, closure = scope_tree(spark, d)
    paths = materialize(unit_closure(spark, d, closure))
    edges = T.sibling_edges(acyclic_pairs(spark, d), paths).select(
        "parent", F.col("from_child").alias("provider"), F.col("to_child").alias("consumer"), F.col("pair_count").alias("weight"))
    keyed = D.decls(spark, d).select("ref", D.source_key().alias("k")).join(dealt(paths), "ref").select(
        F.explode("path").alias("node"), "k").groupBy("node").agg(F.min("k").alias("k"))
    kids = tree_nodes(spark, d).where("parent IS NOT NULL").select("parent", "node").join(dealt(keyed), "node", "left")
    atoms = positions(kids, ["parent"], [F.col("k").asc_nulls_last(), F.col("node")], "rank").select("parent", F.col("node").alias("atom"), "rank")
    atoms = materialize(atoms)
    edges = materialize(edges)
    return atoms, materialize(S.drop_cycle_edges(edges, atoms)), edges


@query("f4_source_displacement", graph("SELECT parent, sum(abs(pos - rank))::BIGINT AS displacement FROM prob GROUP BY parent", PROBLEM))
def source_displacement(spark, d):
    atoms, _, by_id = module_problem(spark, d)
    return S.displacements(atoms, by_id)


@query("e32_order_distance", graph("""
SELECT parent, sum(span)::BIGINT AS distance, sum(span)::BIGINT AS edge_distance, bool_and(span > 0) AS legal FROM sp GROUP BY parent""", PROBLEM))
def order_distance(spark, d):
    _, edges, by_id = module_problem(spark, d)
    return S.distances(edges, by_id)


@query("e32_soft_violations", graph("""
SELECT s.parent, count(*) FILTER (a.rank > b.rank) AS violations FROM pe s JOIN prob a ON a.ref = provider JOIN prob b ON b.ref = consumer GROUP BY s.parent""", PROBLEM))
def soft_violations(spark, d):
    atoms, edges, _ = module_problem(spark, d)
    return S.violations(edges, atoms.select("parent", "atom", F.col("rank").alias("pos")))


@query("e14_span_quantiles", graph("""
SELECT parent, min(span) FILTER (cum >= greatest(1, ceil(total * 0.5))) AS p50, min(span) FILTER (cum >= greatest(1, ceil(total * 0.9))) AS p90
FROM (SELECT parent, span, sum(n) OVER (PARTITION BY parent ORDER BY span) AS cum, sum(n) OVER (PARTITION BY parent) AS total
      FROM (SELECT parent, span, count(*) AS n FROM sp GROUP BY ALL)) GROUP BY parent""", PROBLEM))
def span_quantiles(spark, d):
    _, edges, by_id = module_problem(spark, d)
    met = S.spans(edges, by_id).withColumn("span", F.col("to_pos") - F.col("from_pos"))
    return weighted_quantile(met, ["parent"], "span", "weight", {"p50": 0.5, "p90": 0.9})


CURVE = """
curve AS (SELECT p.parent, p.pos, (SELECT count(*) FROM sp s WHERE s.parent = p.parent AND s.fp <= p.pos AND s.tp > p.pos) AS active
          FROM prob p WHERE p.pos < (SELECT max(pos) FROM prob q WHERE q.parent = p.parent))"""


@query("f5_frontier_curve", graph("SELECT parent, pos, active FROM curve", PROBLEM, CURVE))
def frontier_curve(spark, d):
    _, edges, by_id = module_problem(spark, d)
    return S.frontier(S.spans(edges, by_id), by_id)


@query("e13_order_metrics", graph("""
SELECT a.parent, a.displacement, edges, distance, max_span, last_use_sum, last_use_max, frontier_area, frontier_peak, round(frontier_mean, 6) AS frontier_mean
FROM (SELECT parent, sum(abs(pos - rank))::BIGINT AS displacement FROM prob GROUP BY parent) a
LEFT JOIN (SELECT parent, count(*) AS edges, sum(span)::BIGINT AS distance, max(span) AS max_span FROM sp GROUP BY parent) b ON b.parent = a.parent
LEFT JOIN (SELECT parent, sum(u)::BIGINT AS last_use_sum, max(u) AS last_use_max FROM (SELECT parent, provider, max(span) AS u FROM sp GROUP BY ALL) GROUP BY parent) l ON l.parent = a.parent
LEFT JOIN (SELECT parent, sum(active)::BIGINT AS frontier_area, max(active) AS frontier_peak, avg(active) AS frontier_mean FROM curve GROUP BY parent) c ON c.parent = a.parent""",
    PROBLEM, CURVE))
def order_metrics(spark, d):
    atoms, edges, by_id = module_problem(spark, d)
    return S.metrics(atoms, edges, by_id).select(
        "parent", "displacement", "edges", "distance", "max_span", "last_use_sum", "last_use_max", "frontier_area",
        "frontier_peak", F.round("frontier_mean", 6).alias("frontier_mean"))


@query("e13_role_inversions", graph("""
SELECT a.parent, a.local_public, count(*) AS inversions FROM (SELECT p.*, d.local_public FROM prob p JOIN decls d ON d.ref = p.ref) a
JOIN (SELECT p.*, d.local_public FROM prob p JOIN decls d ON d.ref = p.ref) b ON a.parent = b.parent AND a.local_public = b.local_public
 AND a.pos < b.pos AND a.rank > b.rank GROUP BY ALL""", PROBLEM))
def role_inversions(spark, d):
    from strandwork.operators.stats import inversions

    atoms, _, by_id = module_problem(spark, d)
    role = D.decls(spark, d).select(F.col("ref").cast("string").alias("atom"), "local_public")
    return inversions(atoms.join(by_id, ["parent", "atom"]).join(role, "atom"), ["parent", "local_public"], "pos", "rank").where("inversions > 0")


@query("f7_contiguous_windows", graph("""
SELECT parent, size, start, lo_rank, dist, dist_rank FROM (
  SELECT w.parent, w.size, w.start, min(p.rank) AS lo_rank, max(p.rank) - min(p.rank) + 1 AS spread,
         bool_or(p.rank - w.rmin <> p.pos - w.start) AS differs,
         (SELECT count(*) FROM sp s WHERE s.parent = w.parent AND s.fp >= w.start AND s.tp < w.start + w.size) AS n,
         (SELECT sum(s.span) FROM sp s WHERE s.parent = w.parent AND s.fp >= w.start AND s.tp < w.start + w.size)::BIGINT AS dist,
         (SELECT sum(b.rank - a.rank) FROM sp s JOIN prob a ON a.ref = s.provider JOIN prob b ON b.ref = s.consumer
          WHERE s.parent = w.parent AND s.fp >= w.start AND s.tp < w.start + w.size)::BIGINT AS dist_rank,
         (SELECT bool_and(b.rank > a.rank) FROM sp s JOIN prob a ON a.ref = s.provider JOIN prob b ON b.ref = s.consumer
          WHERE s.parent = w.parent AND s.fp >= w.start AND s.tp < w.start + w.size) AS legal
  FROM (SELECT p.parent, z.size, p.pos AS start, (SELECT min(q.rank) FROM prob q WHERE q.parent = p.parent AND q.pos >= p.pos AND q.pos < p.pos + z.size) AS rmin
        FROM prob p, (VALUES (3), (4), (5), (6)) z(size)) w
  JOIN prob p ON p.parent = w.parent AND p.pos >= w.start AND p.pos < w.start + w.size
  GROUP BY w.parent, w.size, w.start HAVING count(*) = w.size)
WHERE spread = size AND differs""", PROBLEM))
def contiguous_windows(spark, d):
    """Runs of 3 to 6 neighbours that are neighbours in the source order as well, in another sequence, with both distances."""
    atoms, edges, by_id = module_problem(spark, d)
    both = materialize(atoms.join(by_id, ["parent", "atom"]))
    # Every atom belongs to at most 3 + 4 + 5 + 6 windows.
    spread = both.select("*", F.explode(F.array(*[F.lit(s) for s in (3, 4, 5, 6)])).alias("size")).select(
        "*", F.explode(F.sequence(F.col("pos") - F.col("size") + 1, F.col("pos"))).alias("start")).where("start >= 0")
    shift = F.col("rank") - F.col("pos")
    runs = spread.groupBy("parent", "size", "start").agg(
        F.count("*").alias("n"), F.min("rank").alias("lo_rank"), F.max("rank").alias("hi_rank"),
        F.min(shift).alias("s0"), F.max(shift).alias("s1")).where(
        "n = size AND hi_rank - lo_rank + 1 = size AND s0 <> s1")
    runs = materialize(runs.select("parent", "size", "start", "lo_rank"))
    ranks = lambda end: atoms.select("parent", F.col("atom").alias(end), F.col("rank").alias(f"{end}_rank"))
    gap = F.col("to_pos") - F.col("from_pos")
    short = S.spans(edges, by_id).where(gap < 6).join(ranks("provider"), ["parent", "provider"]).join(ranks("consumer"), ["parent", "consumer"])
    inside = short.select("*", F.explode(F.array(*[F.lit(s) for s in (3, 4, 5, 6)])).alias("size")).where(gap < F.col("size")).select(
        "*", F.explode(F.sequence(F.col("to_pos") - F.col("size") + 1, F.col("from_pos"))).alias("start"))
    cost = inside.groupBy("parent", "size", "start").agg(
        F.sum(gap).alias("dist"), F.sum(F.col("consumer_rank") - F.col("provider_rank")).alias("dist_rank"))
    return runs.join(cost, ["parent", "size", "start"], "left")


@query("f1_adjacent_pairs", """
SELECT conv_id, turn AS pos, role AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations
QUALIFY after IS NOT NULL""")
def adjacent(spark, d):
    turns = D.table(spark, d, "conversations").select("conv_id", "turn", "role")
    return adjacent_pairs(turns, ["conv_id"], ["turn"], "role")


@query("i17_sibling_order")
def sibling_order(spark, d):
    """Positions of all siblings of all parents; checked in tests against a step-by-step solver."""
    return solved_tree(spark, d)[2]["order"]


def passage_wishes(spark, d):
    """Soft relations between siblings: what passages (orders) more often name first, two places apart."""
    line = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    later = line.select("l_orderkey", (F.col("l_linenumber") - 2).alias("l_linenumber"), F.col("l_partkey").alias("consumer"))
    named = line.withColumnRenamed("l_partkey", "provider").join(later, ["l_orderkey", "l_linenumber"]).where("provider <> consumer")
    _, closure = scope_tree(spark, d)
    told = T.sibling_edges(named.select("provider", "consumer"), materialize(unit_closure(spark, d, closure)))
    low, high = F.least("from_child", "to_child"), F.greatest("from_child", "to_child")
    net = told.groupBy("parent", low.alias("low"), high.alias("high")).agg(
        F.sum(F.when(F.col("from_child") < F.col("to_child"), F.col("pair_count")).otherwise(-F.col("pair_count"))).alias("net"))
    ahead = F.col("net") > 0
    return net.where("net <> 0").select("parent", F.when(ahead, F.col("low")).otherwise(F.col("high")).alias("provider"),
                                        F.when(ahead, F.col("high")).otherwise(F.col("low")).alias("consumer"))


def steered_tree(spark, d):
    atoms, edges, _ = tree_problem(spark, d)
    soft = kept(spark, ("passage wishes", d), lambda: materialize(passage_wishes(spark, d)))
    return atoms, edges, soft, kept(spark, ("steered order", d), lambda: S.solve(atoms, edges, soft=soft))


@query("i17_steered_order")
def steered_order(spark, d):
    """Positions of all siblings where passages steer both starts; checked in tests against a step-by-step solver."""
    return steered_tree(spark, d)[3]["order"]


@query("i17_steered_starts")
def steered_starts(spark, d):
    """Distance and wishes turned round of both starts, the chosen one and the final order, per parent and order."""
    _, edges, soft, out = steered_tree(spark, d)
    parts = [S.distances(edges, o).select("parent", "distance", "legal").join(S.violations(soft, o), "parent", "full").select(
        "parent", F.lit(name).alias("order"), "distance", "legal", "violations") for name, o in out.items()]
    told = parts[0]
    for p in parts[1:]:
        told = told.unionAll(p)
    return told


@query("i18_order_gain")
def order_gain(spark, d):
    """What single moves gained over the chosen start, per parent."""
    atoms, edges, out = solved_tree(spark, d)
    return S.distances(edges, out["start"]).select("parent", F.col("distance").alias("start_distance")).join(
        dealt(S.distances(edges, out["order"]).select("parent", "distance", "legal")), "parent")


@query("i19_protected_relations")
def protected_relations(spark, d):
    """Source-order neighbours of every module as protected relations, refused where they contradict dependencies."""
    atoms, edges, _ = module_problem(spark, d)
    rel = adjacent_pairs(atoms, ["parent"], ["rank"], "atom").select(
        "parent", F.col("pos").alias("seq"), F.col("before").alias("provider"), F.col("after").alias("consumer"))
    return S.accept_protected(atoms, edges, rel)


@query("e33_ready_widths")
def ready_widths(spark, d):
    atoms, edges, _ = module_problem(spark, d)
    return S.ready_widths(atoms, edges, materialize(S.source_start(atoms, edges)))


@query("k7_order_comparison")
def order_comparison(spark, d):
    """Start by source order against the solved order: distance, displacement, frontier sum."""
    atoms, edges, out = solved_tree(spark, d)
    a, b = (S.metrics(atoms, edges, out[k]).select("parent", F.col("distance").alias(f"{k}_distance"),
            F.col("displacement").alias(f"{k}_displacement"), F.col("frontier_area").alias(f"{k}_frontier")) for k in ("source", "order"))
    return a.join(dealt(b), "parent")


@query("k8_source_only_baseline")
def source_only(spark, d):
    """How many positions differ between the source-order start and the solved order, per parent."""
    atoms, edges, out = solved_tree(spark, d)
    return out["source"].select("parent", "pos", F.col("atom").alias("a")).join(
        dealt(out["order"].select("parent", "pos", F.col("atom").alias("b"))), ["parent", "pos"]).groupBy("parent").agg(
        F.count("*").alias("atoms"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


def order_census_rows(spark, d):
    atoms, edges, out = solved_tree(spark, d)
    diff = out["source"].select("parent", "pos", F.col("atom").alias("a")).join(
        dealt(out["order"].select("parent", "pos", F.col("atom").alias("b"))), ["parent", "pos"]).groupBy("parent").agg(
        F.count("*").alias("atoms"), F.count_if(F.col("a") != F.col("b")).alias("changed"))
    widths = S.ready_widths(atoms, edges, out["source"])
    legal = S.distances(edges, out["order"]).select("parent", "legal")
    return materialize(diff.join(dealt(widths), "parent").join(dealt(legal), "parent", "left"))


@query("e16_order_census")
def order_census(spark, d):
    rows = order_census_rows(spark, d)
    kind = F.split("parent", ":")[0].alias("level")
    return rows.groupBy(kind).agg(
        F.count("*").alias("scopes"), F.count_if(F.col("changed") == 0).alias("same"), F.count_if(F.col("changed") > 0).alias("different"),
        F.count_if(F.col("atoms").between(4, 12)).alias("mid_size"), F.count_if(F.col("atoms") > 12).alias("large"))


@query("c8_order_case_eligibility")
def order_cases(spark, d):
    return order_census_rows(spark, d).where("atoms BETWEEN 4 AND 12 AND changed > 0 AND coalesce(legal, true)").select("parent", "atoms", "changed")


@query("c9_census_candidates")
def census_candidates(spark, d):
    return order_census_rows(spark, d).where("atoms BETWEEN 4 AND 30 AND max_width > 1").select("parent", "atoms", "max_width")


@query("e31_atom_weights", graph("""
SELECT p.folder_id AS parent, p.scope_id AS provider, c.scope_id AS consumer, count(*) AS weight FROM edges e
JOIN decls p ON p.ref = e.provider JOIN decls c ON c.ref = e.consumer WHERE p.folder_id = c.folder_id AND p.scope_id <> c.scope_id GROUP BY ALL"""))
def atom_weights(spark, d):
    decls = D.decls(spark, d)
    both = decls.select("ref", F.struct("folder_id", "scope_id").alias("grp"))
    return G.quotient(acyclic_pairs(spark, d), both).where("from_grp.folder_id = to_grp.folder_id").select(
        F.col("from_grp.folder_id").alias("parent"), F.col("from_grp.scope_id").alias("provider"),
        F.col("to_grp.scope_id").alias("consumer"), F.col("pair_count").alias("weight"))


def _region_inputs(order, edges):
    met = S.spans(edges, order)
    weights = met.select("parent", F.least("from_pos", "to_pos").alias("a"), F.greatest("from_pos", "to_pos").alias("b"), "weight").groupBy(
        "parent", "a", "b").agg(F.sum("weight").alias("weight"))
    return materialize(weights)


@query("i20_region_costs")
def region_costs(spark, d):
    """Best interval regions over the id order of every module."""
    _, edges, by_id = module_problem(spark, d)
    return R.partition(by_id, _region_inputs(by_id, edges))[1]


@query("i20_regions")
def regions(spark, d):
    _, edges, by_id = module_problem(spark, d)
    return R.partition(by_id, _region_inputs(by_id, edges))[0]


@query("i20_balanced_regions", graph("""
SELECT parent, lo, hi FROM cut WHERE lo <> 0 OR hi <> n""", PROBLEM, """
sz AS (SELECT parent, count(*) AS n FROM prob GROUP BY parent),
cut(parent, n, lo, hi) AS (SELECT parent, n, 0::BIGINT, n FROM sz
  UNION ALL SELECT parent, n, CASE WHEN z.s = 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE WHEN z.s = 0 THEN lo + (hi - lo) // 2 ELSE hi END
  FROM cut, (VALUES (0), (1)) z(s) WHERE hi - lo > 6)""", recursive=True))
def balanced_regions(spark, d):
    _, _, by_id = module_problem(spark, d)
    sizes = by_id.groupBy("parent").agg(F.count("*").alias("n"))
    return R.balanced_regions(sizes, by_id).select("parent", "lo", "hi")


@query("i20_balanced_cost", graph("""
SELECT s.parent, sum(m)::BIGINT AS cost FROM (SELECT sp.parent, sp.provider, sp.consumer, min(c.hi - c.lo) AS m FROM sp
  JOIN cut c ON c.parent = sp.parent AND c.lo <= sp.fp AND sp.tp < c.hi GROUP BY ALL) s GROUP BY s.parent""", PROBLEM, """
sz AS (SELECT parent, count(*) AS n FROM prob GROUP BY parent),
cut(parent, n, lo, hi) AS (SELECT parent, n, 0::BIGINT, n FROM sz
  UNION ALL SELECT parent, n, CASE WHEN z.s = 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE WHEN z.s = 0 THEN lo + (hi - lo) // 2 ELSE hi END
  FROM cut, (VALUES (0), (1)) z(s) WHERE hi - lo > 6)""", recursive=True))
def balanced_cost(spark, d):
    _, edges, by_id = module_problem(spark, d)
    sizes = by_id.groupBy("parent").agg(F.count("*").alias("n"))
    return R.balanced_cost(sizes, _region_inputs(by_id, edges))


@query("i21_region_burdens")
def region_burdens(spark, d):
    """Regions with text size as tie-break, only in modules where every member has text."""
    _, edges, by_id = module_problem(spark, d)
    size = D.decls(spark, d).select(F.col("ref").cast("string").alias("atom"), F.length("statement_text").alias("burden"))
    burdens = by_id.join(size, "atom").select("parent", "pos", "burden")
    return R.partition(by_id, _region_inputs(by_id, edges), burdens=burdens)[1]


@query("i15_helper_absorption")
def helper_absorption(spark, d):
    groups, uses = H.group_tables(*helper_inputs(spark, d))
    return H.absorb(groups, uses)[0]


@query("i15_helper_refusals")
def helper_refusals(spark, d):
    groups, uses = H.group_tables(*helper_inputs(spark, d))
    return H.absorb(groups, uses)[1]


@query("i15_protected_refs", graph("""
SELECT ref FROM decls WHERE outcome
UNION SELECT ref FROM decls WHERE technical AND generated_from IS NULL
UNION SELECT e.provider FROM edges e JOIN decls p ON p.ref = e.provider JOIN decls c ON c.ref = e.consumer WHERE p.scope_id <> c.scope_id"""))
def protected_refs(spark, d):
    decls, owner, edges = helper_inputs(spark, d)
    return H.protected_refs(decls, owner, edges)


def helper_inputs(spark, d):
    return kept(spark, ("helper inputs", d), lambda: _helper_inputs(spark, d))


def _helper_inputs(spark, d):
    decls = D.decls(spark, d).withColumn("source_key", D.source_key()).withColumn(
        "size", (F.coalesce(F.length("statement_text"), F.lit(0)) + F.coalesce(F.length("proof_text"), F.lit(0))).cast("long"))
    decls = materialize(decls)
    return decls, materialize(T.generated_owners(decls)[0]), materialize(acyclic_pairs(spark, d))


@query("i22_hierarchy")
def hierarchy(spark, d):
    """The whole build: generated owners, absorption, compressed scopes, sibling order and regions as one node table."""
    decls, owner, edges = helper_inputs(spark, d)
    groups, uses = H.group_tables(decls, owner, edges)
    merged, _ = H.absorb(groups, uses)
    owner = materialize(owner.join(dealt(merged.select(F.col("grp").alias("owner"), "target")), "owner", "left").select(
        "ref", F.coalesce("target", "owner").alias("owner")))
    units = decls.join(dealt(owner.where("ref = owner").select("ref")), "ref", "left_semi").select(
        F.concat(F.lit("u:"), "ref").alias("node"), F.col("scope_id").alias("parent"), F.lit("unit").alias("kind"))
    scopes = D.scopes(spark, d).select(F.col("scope_id").alias("node"), "parent",
                                       F.when(F.col("parent").isNull(), "repo").otherwise("scope").alias("kind"))
    kept, _ = T.compress(scopes.unionAll(units))
    kept = materialize(kept)
    closure = materialize(I.ancestors(kept))
    paths = materialize(T.root_paths(closure).select(F.col("node").alias("unit"), "path").join(
        dealt(owner.select("ref", F.concat(F.lit("u:"), "owner").alias("unit"))), "unit").select("ref", "path"))
    full = materialize(T.sibling_edges(edges, paths).select(
        "parent", F.col("from_child").alias("provider"), F.col("to_child").alias("consumer"), F.col("pair_count").alias("weight")))
    keyed = decls.select("ref", "source_key").join(paths, "ref").select(F.explode("path").alias("node"), "source_key").groupBy("node").agg(
        F.min("source_key").alias("k"))
    kids = kept.where("parent IS NOT NULL").join(dealt(keyed), "node", "left")
    atoms = materialize(positions(kids, ["parent"], [F.col("k").asc_nulls_last(), F.col("node")], "rank").select("parent", F.col("node").alias("atom"), "rank"))
    order = S.solve(atoms, S.drop_cycle_edges(full, atoms))["order"]
    spans, _ = R.partition(order, _region_inputs(order, full))
    # A span of one item is the item itself, not a region.
    wide = spans.where("hi - lo > 1")
    name = lambda lo, hi: F.concat(F.lit("g:"), "parent", F.lit("/"), lo, F.lit("-"), hi)
    size = order.groupBy("parent").agg(F.count("*").alias("n"))
    regions_ = wide.join(dealt(size), "parent").select(
        name(F.col("lo"), F.col("hi")).alias("node"),
        F.when((F.col("up_lo") == 0) & (F.col("up_hi") == F.col("n")), F.col("parent")).otherwise(name(F.col("up_lo"), F.col("up_hi"))).alias("parent"),
        F.lit("region").alias("kind"), F.col("lo").alias("child_pos"))
    # Each item hangs under its smallest region: the leaf span that holds its position.
    leaves = spans.join(dealt(spans.select("parent", F.col("up_lo").alias("lo"), F.col("up_hi").alias("hi")).distinct()), ["parent", "lo", "hi"], "left_anti")
    covered = leaves.select("parent", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos"), "lo", "hi", "up_lo", "up_hi")
    items = order.join(dealt(covered), ["parent", "pos"], "left").join(dealt(size), "parent").join(dealt(kept.select(F.col("node").alias("atom"), "kind")), "atom").select(
        F.col("atom").alias("node"),
        F.when(F.col("lo").isNull(), F.col("parent"))
        .when(F.col("hi") - F.col("lo") > 1, name(F.col("lo"), F.col("hi")))
        .when((F.col("up_lo") == 0) & (F.col("up_hi") == F.col("n")), F.col("parent"))
        .otherwise(name(F.col("up_lo"), F.col("up_hi"))).alias("parent"), "kind", F.col("pos").alias("child_pos"))
    roots = kept.where("parent IS NULL").select("node", "parent", "kind", F.lit(0).cast("bigint").alias("child_pos"))
    return roots.unionAll(items).unionAll(regions_)
