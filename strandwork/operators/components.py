"""Strongly connected components and one closed walk through each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwork.operators.iterate import reach, waves
from strandwork.operators.products import every_pair
from strandwork.operators.tree import shortest_paths
from strandwork.session import dealt, materialize, measured


def _spread_minimum(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Push the smallest label along the edges until nothing changes; only changed nodes send."""
    state = materialize(state.withColumn("fresh", F.lit(True)))
    while True:
        told = state.where("fresh").join(dealt(edges), F.col("node") == F.col("provider")).groupBy(
            F.col("consumer").alias("node")).agg(F.min("label").alias("offer"))
        better = F.col("offer") < F.col("label")
        state, seen = measured(state.join(dealt(told), "node", "left").select(
            "node", F.when(better, F.col("offer")).otherwise(F.col("label")).alias("label"),
            F.coalesce(better, F.lit(False)).alias("fresh")), fresh=F.count_if("fresh"))
        if not seen["fresh"]:
            return state.select("node", "label")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("consumer").alias("provider"), F.col("provider").alias("consumer"))


def _chains(edges: DataFrame) -> DataFrame:
    """(node, first, ring, low) of the nodes with one way in and one way out.

    ``first`` is the first node of their chain; a chain that closes is a ring, named by its least node ``low``.
    Pointers are doubled, so a chain of n nodes takes log2(n) rounds.
    """
    into = edges.groupBy(F.col("consumer").alias("node")).agg(F.count("*").alias("ins"), F.min("provider").alias("before"))
    out = edges.groupBy(F.col("provider").alias("node")).agg(F.count("*").alias("outs"))
    inner = materialize(into.join(dealt(out), "node").where("ins = 1 AND outs = 1").select("node", "before"))
    known = inner.select(F.col("node").alias("before"), F.lit(True).alias("k"))
    state, seen = measured(inner.join(dealt(known), "before", "left").select(
        "node", F.when(F.col("k"), F.col("before")).otherwise(F.col("node")).alias("first"), F.coalesce("k", F.lit(False)).alias("ring"),
        F.col("node").alias("low"), F.lit(False).alias("fresh")), open=F.count_if("ring"))
    left = -1
    while seen["open"] and (seen["open"] != left or seen["fresh"]):
        left = seen["open"]
        ahead = state.select(F.col("node").alias("first"), F.col("first").alias("next"), F.col("ring").alias("more"), F.col("low").alias("lower"))
        state, seen = measured(state.join(dealt(ahead), "first").select(
            "node", F.when(F.col("ring"), F.col("next")).otherwise(F.col("first")).alias("first"), (F.col("ring") & F.col("more")).alias("ring"),
            F.least("low", "lower").alias("low"), (F.col("ring") & F.col("more") & (F.col("lower") < F.col("low"))).alias("fresh")),
            open=F.count_if("ring"), fresh=F.count_if("fresh"))
    return state.select("node", "first", "ring", "low")


def cyclic_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of every node on a cycle; the component is named by its smallest member.

    Nodes before and behind all cycles are peeled off first, and chains of nodes with one way
    in and out become one edge.  On the rest each node takes the smallest label among its
    ancestors; a node that keeps its own label owns a component, made of the nodes of that
    label that can reach it.  A chain belongs to a component that has both of its ends.
    """
    edges = materialize(edges.select("provider", "consumer").distinct())
    loops = edges.where("provider = consumer").select(F.col("provider").alias("node"))
    live = edges.where("provider <> consumer")
    left = nodes.select("node")
    parts: list[DataFrame] = []
    chains: list[DataFrame] = []
    while True:
        for turn in (live, _turned(live)):
            left = materialize(waves(left, _inside(turn, left)).where("level IS NULL").select("node"))
        if not left.take(1):
            break
        live = materialize(_inside(live, left))
        inner = _chains(live)
        if inner.take(1):
            rings = inner.where("ring").select("node", F.col("low").alias("component"))
            parts.append(rings)
            left = materialize(left.join(dealt(inner.select("node")), "node", "left_anti"))
            first = inner.where("NOT ring").select("node", "first")
            from_ = live.join(dealt(first.select(F.col("node").alias("provider"), F.col("first").alias("chain"))), "provider", "left").join(
                dealt(first.select(F.col("node").alias("consumer"), F.col("first").alias("to_chain"))), "consumer", "left").join(
                dealt(rings.select(F.col("node").alias("consumer"))), "consumer", "left_anti")
            from_ = materialize(from_)
            # A chain leads from what comes before its first node to what comes behind its last one.
            heads = from_.where("consumer = to_chain").select(F.col("to_chain").alias("chain"), F.col("provider").alias("head"))
            tails = from_.where("chain IS NOT NULL AND to_chain IS NULL").select("chain", F.col("consumer").alias("tail"))
            spans = materialize(heads.join(dealt(tails), "chain"))
            chains.append(materialize(first.withColumnRenamed("first", "chain").join(dealt(spans), "chain").select("node", "head", "tail")))
            live = materialize(from_.where("chain IS NULL AND to_chain IS NULL").select("provider", "consumer").unionAll(
                spans.where("head <> tail").select("head", "tail")).distinct())
        label = materialize(_spread_minimum(left.withColumn("label", F.col("node")), live))
        ends = label.select(F.col("node").alias("consumer"), F.col("label").alias("to_label"))
        same = live.join(dealt(label.select(F.col("node").alias("provider"), F.col("label").alias("from_label"))), "provider").join(
            dealt(ends), "consumer").where("from_label = to_label").select("provider", "consumer")
        owners = label.where("node = label").select("node", "label")
        found = materialize(reach(_turned(materialize(same)), owners.select("label", "node"), ("label",)).select(
            "node", F.col("label").alias("component")))
        parts.append(found)
        left = materialize(left.join(dealt(found), "node", "left_anti"))
        live = materialize(_inside(live, left))
    out = left.select("node", F.col("node").alias("component")).where("false")
    for p in parts:
        out = out.unionAll(p)
    # What was drawn together last is taken apart first: its ends may lie on chains drawn before.
    for chain in reversed(chains):
        out = materialize(out)
        closing = chain.where("head = tail").select(F.col("head").alias("node")).distinct().join(dealt(out), "node", "left_anti")
        out = materialize(out.unionAll(closing.select("node", F.col("node").alias("component"))))
        at = lambda end: out.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
        out = out.unionAll(chain.join(dealt(at("head")), "head").join(dealt(at("tail")), "tail").where("head_c = tail_c").select(
            "node", F.col("head_c").alias("component")))
    out = materialize(out) if chains else out
    out = out.unionAll(loops.join(dealt(out), "node", "left_anti").select("node", F.col("node").alias("component")))
    named = out.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    return out.join(dealt(named), "component").join(loops.withColumn("loop", F.lit(True)), "node", "left").where("n > 1 OR loop").select(
        "node", F.col("least").alias("component"))


def reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node) for every one of ``nodes(node)``: the node itself and all that can be reached from it.

    Nodes of one component reach the same, so only components are followed; their pairs are
    listed at the end (see ``products.every_pair``).
    """
    edges = materialize(edges.select("provider", "consumer").distinct())
    ends = edges.select(F.col("provider").alias("node")).unionAll(edges.select("consumer"))
    known = materialize(nodes.select("node").unionAll(ends).where("node IS NOT NULL").distinct())
    found = cyclic_components(known, edges)
    home = materialize(known.join(dealt(found), "node", "left").select("node", F.coalesce("component", "node").alias("home")))
    side = lambda end: dealt(home.select(F.col("node").alias(end), F.col("home").alias(f"{end}_home")))
    between = edges.join(side("provider"), "provider").join(side("consumer"), "consumer").where("provider_home <> consumer_home").select(
        F.col("provider_home").alias("provider"), F.col("consumer_home").alias("consumer")).distinct()
    starts = home.join(dealt(nodes.select("node").distinct()), "node", "left_semi").select(F.col("node").alias("start"), "home")
    seeds = starts.select("home").distinct().select("home", F.col("home").alias("node"))
    met = materialize(reach(materialize(between), seeds, ("home",)).select("home", F.col("node").alias("seen")))
    # The nodes that a component sees are listed once, and its starts meet them in packs.
    sent = materialize(met.join(dealt(home.select("node", F.col("home").alias("seen"))), "seen").select("home", "node"))
    lost = nodes.where("node IS NULL").select(F.col("node").alias("start"), "node").distinct()
    return every_pair(sent, materialize(starts), ["home"]).select("start", "node").unionAll(lost)


def _inside(edges: DataFrame, left: DataFrame) -> DataFrame:
    return edges.join(dealt(left.select(F.col("node").alias("provider"))), "provider", "left_semi").join(
        dealt(left.select(F.col("node").alias("consumer"))), "consumer", "left_semi").select("provider", "consumer")


def witnesses(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, walk): from the first member to its smallest successor and back by the shortest way."""
    at = materialize(components)
    inner = edges.join(at.select(F.col("node").alias("provider"), F.col("component").alias("c1")), "provider").join(
        at.select(F.col("node").alias("consumer"), F.col("component").alias("c2")), "consumer").where("c1 = c2").select(
        F.col("c1").alias("component"), "provider", "consumer")
    inner = materialize(inner)
    starts = inner.where("provider = component").groupBy("component").agg(F.min("consumer").alias("node"))
    back = shortest_paths(inner.select("provider", "consumer"), starts, ("component",)).where("node = component")
    return back.select("component", F.concat(F.array("component"), "path").alias("walk"))
