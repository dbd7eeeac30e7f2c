"""Containment trees as (node, parent, kind, ...) tables with closures and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandwork.operators.iterate import jump_to_root, reach
from strandwork.operators.order_stats import positions, running
from strandwork.operators.products import every_pair
from strandwork.session import dealt, materialize, measured


def root_paths(closure: DataFrame) -> DataFrame:
    """(node, path) with the nodes from the root down to the node itself; as long as the tree is deep."""
    return closure.groupBy("node").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("depth")).alias("d"), "ancestor"))).alias("p")).select(
        "node", F.transform("p", lambda x: x["ancestor"]).alias("path"))


def sibling_edges(edge: DataFrame, ref_paths: DataFrame) -> DataFrame:
    """Project each edge to the parent where its two root paths part.

    One row per (parent, from_child, to_child) with pair and provider counts; a
    tree edge needs no per-ancestor rows, only the two paths.
    """
    k = F.size(F.array_intersect("pp", "cp"))
    parted = edge.select("provider", "consumer").join(
        dealt(ref_paths.select(F.col("ref").alias("provider"), F.col("path").alias("pp"))), "provider").join(
        dealt(ref_paths.select(F.col("ref").alias("consumer"), F.col("path").alias("cp"))), "consumer").withColumn("k", k)
    at = lambda c, i: F.get(F.col(c), i)
    split = parted.where((F.col("k") > 0) & (F.col("k") < F.size("pp")) & (F.col("k") < F.size("cp"))).select(
        at("pp", F.col("k") - 1).alias("parent"), at("pp", F.col("k")).alias("from_child"),
        at("cp", F.col("k")).alias("to_child"), "provider")
    return split.groupBy("parent", "from_child", "to_child", "provider").agg(F.count("*").alias("n")).groupBy(
        "parent", "from_child", "to_child").agg(F.sum("n").alias("pair_count"), F.count("*").alias("provider_count"))


def compress(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop wrappers: a non-root scope with one child gives way to it, and a root takes over an only scope child.

    ``nodes(node, parent, kind)`` with kinds repo / scope / unit.  Returns the kept
    nodes with new parents and the alias table (node, survivor) of the removed ones.
    """
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("n"), F.min("node").alias("only"))
    state = materialize(nodes.join(dealt(kids), "node", "left").select(
        "node", "parent", "kind", F.when(F.col("n") == 1, F.col("only")).alias("only"),
        ((F.col("kind") == "scope") & (F.coalesce("n", F.lit(0)) == 1)).alias("wrapper")))
    down = materialize(jump_to_root(state.select("node", F.when(F.col("wrapper"), F.col("only")).alias("target"))))
    up = materialize(jump_to_root(state.select("node", F.when(F.col("wrapper"), F.col("parent")).alias("target"))))
    kind = state.select(F.col("node").alias("root"), F.col("kind").alias("end_kind"))
    # A repository whose only child ends in a scope takes that scope's place.
    taken = state.where("kind = 'repo' AND only IS NOT NULL").select(F.col("node").alias("repo"), F.col("only").alias("node")).join(
        dealt(down), "node").join(dealt(kind), "root").where("end_kind = 'scope'").select(F.col("root").alias("gone"), "repo")
    taken = materialize(taken)
    moved = state.where("NOT wrapper").join(dealt(taken.select(F.col("gone").alias("node"))), "node", "left_anti").join(
        dealt(up.select(F.col("node").alias("parent"), F.col("root").alias("above"))), "parent", "left").join(
        dealt(taken.select(F.col("gone").alias("above"), "repo")), "above", "left")
    kept = moved.select("node", F.coalesce("repo", "above").alias("parent"), "kind")
    aliases = state.where("wrapper").select("node").join(down, "node").select("node", "root").unionAll(
        taken.select("gone", "gone")).join(taken.select(F.col("gone").alias("root"), "repo"), "root", "left").select(
        "node", F.coalesce("repo", "root").alias("survivor"))
    return kept, aliases


#: Readers that are given the rows of the one who stands for them together.
TOGETHER = 4096


def alike(kinds: DataFrame) -> DataFrame:
    """(view, reader, chunk, chunks) of ``kinds(view, kind)``, one row per view: the least view of its kind is the reader.

    Views of a kind are dealt into chunks of some ``TOGETHER``.
    """
    by = kinds.groupBy("kind").agg(F.min("view").alias("reader"), F.ceil(F.count("*") / F.lit(TOGETHER)).cast("long").alias("chunks"))
    return kinds.join(by, "kind").select("view", "reader", F.pmod(F.xxhash64("view"), F.col("chunks")).alias("chunk"), "chunks")


def for_alike(rows: DataFrame, readers: DataFrame) -> DataFrame:
    """``rows(view, ..)`` of the readers that stand for others, for every view of ``readers`` (see ``alike``).

    Rows meet the views of their reader chunk by chunk (see ``products.every_pair``, which reads ``rows`` twice), so one
    kind of many views is spread over many tasks and nothing is shuffled for single views.
    """
    views = readers.select(F.col("reader").alias("__r"), "chunk", "view")
    return every_pair(rows.withColumnRenamed("view", "__r"), views, ["__r"], "chunk").select(*rows.columns)


def visible(nodes: DataFrame, closure: DataFrame, views: DataFrame, expanded: DataFrame) -> DataFrame:
    """(view, node) on show: every proper ancestor of the node is expanded in the view.

    ``views(view, root)`` names the tree each view opens, ``expanded(view, node)``
    its expansion set.  Only children of open chains are generated, so a view
    costs what it shows plus its expansion set, never the whole tree.
    """
    above = closure.where("depth > 0")
    need = expanded.join(above.groupBy("node").agg(F.count("*").alias("need")), "node", "left")
    have = expanded.join(above, "node").join(
        expanded.select("view", F.col("node").alias("ancestor")), ["view", "ancestor"]).groupBy("view", "node").agg(
        F.count("*").alias("have"))
    chain = need.join(have, ["view", "node"], "left").where(
        F.coalesce("need", F.lit(0)) == F.coalesce("have", F.lit(0))).select("view", F.col("node").alias("parent"))
    shown = chain.join(nodes.select("node", "parent"), "parent").select("view", "node")
    return shown.unionAll(views.select("view", F.col("root").alias("node"))).distinct()


def frontier(shown: DataFrame, nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """Visible nodes that stand for themselves: not expanded, or leaves."""
    parents = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    return shown.join(expanded.join(parents, "node", "left_semi"), ["view", "node"], "left_anti")


def collapse(expanded: DataFrame, closure: DataFrame, shut: DataFrame) -> DataFrame:
    """Expansion sets after ``shut(view, node)``: the node and everything below it lose their flag."""
    below = shut.join(closure.select(F.col("ancestor").alias("node"), F.col("node").alias("below")), "node").select(
        "view", F.col("below").alias("node"))
    return expanded.join(below, ["view", "node"], "left_anti")


def path_to(nodes: DataFrame, closure: DataFrame, wanted: DataFrame, expanded: DataFrame) -> DataFrame:
    """Ancestors still to be expanded before ``wanted(view, node)`` shows, in order from the root."""
    chain = wanted.join(closure.where("depth > 0"), "node").select(
        "view", "node", F.col("ancestor").alias("expand"), "depth")
    return chain.join(expanded.select("view", F.col("node").alias("expand")), ["view", "expand"], "left_anti")


def child_positions(nodes: DataFrame, order: list[Column | str]) -> DataFrame:
    """Position of every node among its siblings; roots are ordered among themselves."""
    return positions(nodes, ["parent"], order, "child_pos")


def position_paths(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(node, depth, sort_path): child positions from the root; sorting by it is depth-first order."""
    steps = closure.join(nodes.select(F.col("node").alias("ancestor"), "child_pos"), "ancestor")
    return steps.groupBy("node").agg(F.max("depth").alias("depth"), F.array_sort(F.collect_list(
        F.struct((-F.col("depth")).alias("d"), "child_pos"))).alias("p")).select(
        "node", "depth", F.transform("p", lambda x: x["child_pos"]).alias("sort_path"))


def generated_owners(decls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owner of every declaration after following ``generated_from`` inside one scope.

    ``decls(ref, scope_id, generated_from)``.  Returns (ref, owner) and the refs whose
    chain leaves the scope, leaves the loaded declarations or runs in a circle.
    """
    known = decls.select(F.col("ref").alias("generated_from"), F.lit(True).alias("loaded"))
    links = materialize(decls.join(dealt(known), "generated_from", "left").select(
        F.col("ref").alias("node"), "scope_id", "generated_from",
        F.when(F.col("loaded"), F.col("generated_from")).alias("target"),
        (F.col("generated_from").isNotNull() & F.col("loaded").isNull()).alias("lost")))
    ends = materialize(jump_to_root(links.select("node", "target")))
    home = links.select(F.col("node").alias("root"), F.col("scope_id").alias("end_scope"), F.col("lost").alias("end_lost"))
    met = links.select("node", "scope_id", "generated_from").join(dealt(ends), "node").join(dealt(home), "root", "left")
    good = F.col("root").isNotNull() & ~F.col("end_lost") & (F.col("end_scope") == F.col("scope_id"))
    owner = met.select(F.col("node").alias("ref"), F.when(F.coalesce(good, F.lit(False)), F.col("root")).otherwise(F.col("node")).alias("owner"))
    lost = met.where("generated_from IS NOT NULL").where(~F.coalesce(good, F.lit(False))).select(F.col("node").alias("ref"))
    return owner, lost


def shortest_paths(edges: DataFrame, starts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Breadth-first tree from ``starts(keys, node)``: (keys, node, path), ties broken by the smallest path."""
    cols = [*keys, "node"]
    found = materialize(starts.select(*cols, F.array("node").alias("path")))
    front = found
    while True:
        step = front.join(edges, F.col("node") == F.col("provider")).select(
            *keys, F.col("consumer").alias("node"), F.concat("path", F.array("consumer")).alias("path"))
        front, new = measured(step.groupBy(*cols).agg(F.min("path").alias("path")).join(found.select(*cols), cols, "left_anti"), n=F.count("*"))
        if not new["n"]:
            return found
        found = materialize(found.unionAll(front))


def neighbourhood(nodes: DataFrame, closure: DataFrame, jobs: DataFrame) -> DataFrame:
    """What a writing job on ``jobs(job, node)`` may look at: its subtree, its ancestors and their earlier siblings."""
    below = jobs.join(closure.select(F.col("ancestor").alias("node"), F.col("node").alias("seen")), "node").select("job", "seen")
    chain = jobs.join(closure, "node").select("job", F.col("ancestor").alias("seen"))
    placed = nodes.select("node", "parent", "child_pos")
    spot = chain.join(placed.withColumnRenamed("node", "seen"), "seen").where("parent IS NOT NULL").select(
        "job", "parent", F.col("child_pos").alias("limit"))
    earlier = spot.join(placed, "parent").where(F.col("child_pos") < F.col("limit")).select("job", F.col("node").alias("seen"))
    return below.unionAll(chain).unionAll(earlier).distinct()


def neighbourhood_sizes(nodes: DataFrame, closure: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job, seen): how many nodes ``neighbourhood`` shows to each job, counted and not listed.

    Where every node has one parent and every job one node, the subtree, the ancestors and their
    earlier siblings have only the node itself in common, so their sizes add up; other trees are listed.
    """
    spots = materialize(nodes.groupBy("node", "parent").agg(F.min("child_pos").alias("lo"), F.max("child_pos").alias("hi")))
    jobs = materialize(jobs.select("job", "node").distinct())
    several = spots.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(1).alias("x")).unionAll(
        jobs.groupBy("job").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(1)))
    if several.take(1):
        return neighbourhood(nodes, closure, jobs).groupBy("job").agg(F.count("*").alias("seen"))
    spots = spots.where("parent IS NOT NULL")
    # Nodes of a parent that begin before a place, by one running total over the places asked for.
    asked = spots.select("parent", F.col("hi").alias("at"), F.lit(0).cast("long").alias("one"), "node", F.col("lo").alias("own")).unionAll(
        spots.select("parent", "lo", F.lit(1).cast("long"), "node", F.lit(None).cast(spots.schema["lo"].dataType)))
    earlier = running(asked, ["parent"], ["at", "one", "node"], {"before": F.col("one")}).where("one = 0").select(
        "node", (F.col("before") - (F.col("own") < F.col("at")).cast("long")).alias("before"))
    pairs = closure.select("node", "ancestor").distinct()
    above = pairs.join(dealt(earlier.withColumnRenamed("node", "ancestor")), "ancestor", "left").groupBy("node").agg(
        (F.count("*") + F.coalesce(F.sum("before"), F.lit(0))).alias("up"))
    below = pairs.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("down"))
    return jobs.join(dealt(above), "node").join(dealt(below), "node").select("job", (F.col("up") + F.col("down") - 1).alias("seen"))


def provider_closure(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets and everything they depend on, directly or not."""
    back = edges.select(F.col("consumer").alias("provider"), F.col("provider").alias("consumer"))
    return reach(back, targets)
