"""Resolution of names: namespaces from the inside out, then opened namespaces, with aliases, under visibility.

Nothing is listed for a module before it is asked for: candidate names are folded to distinct
(module, name) pairs, looked up by name, and what is met is held against the import closure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandwork.session import materialize

ROOT = "_root_."
#: A name that more declarations share is looked up module by module along the import closure instead.
CROWDED = 64


def prefixes(namespace: Column) -> Column:
    """(tier, prefix) of a dotted namespace, the longest first and the root last."""
    parts = F.filter(F.split(namespace, r"\."), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(
        i.alias("tier"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), ".").alias("prefix")))


def inside(prefix: Column, name: Column) -> Column:
    return F.concat(F.when(prefix != "", F.concat(prefix, F.lit("."))).otherwise(""), name)


def looked_up(wanted: DataFrame, symbols: DataFrame, visible: DataFrame) -> DataFrame:
    """(module, name, lo, hi): least and greatest ref that ``wanted(module, name)`` can mean there.

    ``symbols(ref, module, name, public)``; ``visible(module, seen)`` is the import closure with the
    module itself.  A declaration is met if it is public in a visible module, or in the same module.
    """
    declared = symbols.select(F.col("module").alias("home"), "name", "ref", "public")
    shared = declared.groupBy("name").agg(F.count("*").alias("k"))
    asked = wanted.distinct().join(shared, "name")
    own = F.col("public") | (F.col("home") == F.col("module"))
    seen = visible.select("module", F.col("seen").alias("home")).distinct()
    few = asked.where(F.col("k") <= CROWDED).select("module", "name").join(declared, "name").where(own).join(seen, ["module", "home"], "left_semi")
    many = asked.where(F.col("k") > CROWDED).select("module", "name").join(seen, "module").join(declared, ["home", "name"]).where(own)
    return few.select("module", "name", "ref").unionAll(many.select("module", "name", "ref")).groupBy("module", "name").agg(
        F.min("ref").alias("lo"), F.max("ref").alias("hi"))


def opened_namespaces(contexts: DataFrame, symbols: DataFrame, visible: DataFrame) -> DataFrame:
    """(context, module, namespace) that the opens of each context lead to.

    An open is read from the namespace it stands in: the longest prefix under which a visible module
    declares such a namespace wins, and one that leads nowhere opens nothing.
    """
    every = contexts.select("context", "module", F.posexplode("opens").alias("n", "open"))
    rooted = F.col("open.name").startswith(ROOT)
    plain = every.where(rooted).select("context", "module", F.expr(f"substr(open.name, {len(ROOT) + 1})").alias("namespace"))
    asked = every.where(~rooted).select("context", "module", "n", "open", F.explode(prefixes(F.col("open.at"))).alias("p")).select(
        "context", "module", "n", F.col("p.tier").alias("tier"), inside(F.col("p.prefix"), F.col("open.name")).alias("name"))
    parent = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    declared = symbols.select("module", F.explode(prefixes(parent)).alias("p")).where("p.prefix <> ''").select(
        F.col("module").alias("ref"), "module", F.col("p.prefix").alias("name"), F.lit(True).alias("public")).distinct()
    met = asked.join(looked_up(asked.select("module", "name"), declared, visible), ["module", "name"], "left_semi")
    best = met.groupBy("context", "module", "n").agg(F.min_by("name", "tier").alias("namespace"))
    return plain.unionAll(best.select("context", "module", "namespace")).distinct()


def _named(asked: DataFrame, opened: DataFrame, keep: list[str], level: str) -> DataFrame:
    """Candidate names of ``asked(.., context, module, token, namespace)`` with their ``level``: prefixes first, opened namespaces last."""
    rooted = F.col("token").startswith(ROOT)
    root = asked.where(rooted).select(*keep, F.lit(0).alias(level), F.expr(f"substr(token, {len(ROOT) + 1})").alias("name"))
    loose = asked.where(~rooted)
    scoped = loose.select(*keep, "token", F.explode(prefixes(F.col("namespace"))).alias("p")).select(
        *keep, F.col("p.tier").alias(level), inside(F.col("p.prefix"), F.col("token")).alias("name"))
    # The opened namespaces are one tier together, behind the root.
    last = F.size(prefixes(F.col("namespace")))
    open_ = loose.withColumn(level, last).join(opened.select("context", F.col("namespace").alias("open")), "context").select(
        *keep, level, inside(F.col("open"), F.col("token")).alias("name"))
    return root.unionAll(scoped).unionAll(open_)


def resolve(tokens: DataFrame, contexts: DataFrame, symbols: DataFrame, visible: DataFrame, aliases: DataFrame) -> DataFrame:
    """(context, token, status, ref, tier) of every distinct token of a context.

    ``tokens(context, token)``; ``contexts(context, module, namespace, opens array<struct<at, name>>)``;
    ``aliases(module, alias, target)``.  The first tier that means anything decides: one declaration is
    an edge, several are ambiguous; a token that means nothing is unresolved.  An alias means what
    its target means where the alias was made.
    """
    contexts = materialize(contexts)
    opened = materialize(opened_namespaces(contexts, symbols, visible))
    tokens = materialize(tokens.distinct())
    place = contexts.select("context", "module", "namespace")
    keep = ["context", "module", "asked"]
    direct = _named(tokens.join(place, "context").withColumn("asked", F.col("token")), opened, keep, "tier")
    nothing = F.lit(None).cast("string")
    direct = materialize(direct.withColumn("via", nothing).withColumn("step", F.lit(0)))
    met = direct.join(aliases.withColumnRenamed("alias", "name"), ["module", "name"]).select(
        *keep, "tier", F.col("name").alias("via"), F.col("target").alias("token"), F.regexp_extract("name", r"^(.*)\.[^.]*$", 1).alias("namespace"))
    indirect = _named(met, opened, [*keep, "tier", "via"], "step")
    columns = ["context", "module", "asked", "tier", "via", "step", "name"]
    every = direct.select(columns).unionAll(indirect.select(columns))
    found = looked_up(every.select("module", "name"), symbols, visible)
    hits = every.join(found, ["module", "name"])
    # Of an alias its first step that means anything; then of a token its first tier.
    steps = hits.groupBy("context", "asked", "tier", "via", "step").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    meant = steps.groupBy("context", "asked", "tier", "via").agg(F.min(F.struct("step", "lo", "hi")).alias("m"))
    tiers = meant.groupBy("context", "asked", "tier").agg(F.min("m.lo").alias("lo"), F.max("m.hi").alias("hi"))
    best = tiers.groupBy("context", F.col("asked").alias("token")).agg(F.min(F.struct("tier", "lo", "hi")).alias("b"))
    one = F.col("b.lo") == F.col("b.hi")
    return tokens.join(best, ["context", "token"], "left").select(
        "context", "token", F.when(F.col("b").isNull(), "unresolved").when(one, "edge").otherwise("ambiguous").alias("status"),
        F.when(one, F.col("b.lo")).alias("ref"), F.col("b.tier").alias("tier"))
