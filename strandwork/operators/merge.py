"""Merging sources: unique matches, authority-ranked fields, coverage and keep/hide decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strandwork.operators.names import looked_up

# Field authority by source.
FORMAL = ("module", "native_scope", "statement.formal", "proof.formal", "source_refs", "source_context")
KERNEL = ("lean_name", "module", "kind", "kernel_kind", "generated_from", "statement.deps", "proof.deps")
PROJECT = ("native_scope", "local_public", "completion_status")
# Providers whose declarations may be hidden, and coverage ranks.
AMBIENT = ("lean", "batteries", "mathlib")
COVERAGE = ("unknown", "partial", "complete")


def authority_rank(field: str = "field", authority: str = "authority") -> Column:
    f, a = F.col(field), F.col(authority)
    return (F.when(a == "lean_source", 110).when(a == "lc_catalog", 100)
            .when(a == "lean_environment", F.when(f.isin(*KERNEL), 100).otherwise(20))
            .when(a.isin("source", "text_ast"), F.when(f.isin(*FORMAL), 100).otherwise(30))
            .when(a.isin("project_metadata", "project_profile"), F.when(f.isin(*PROJECT), 80).otherwise(10))
            .when(a == "generated", 0).otherwise(50))


def merge_fields(contributions: DataFrame) -> DataFrame:
    """Winner of every (ref, field): highest authority, then backend, method, value; plus a conflict flag.

    Two small aggregations instead of a window, so a field with any number of
    contributions is folded before the shuffle.
    """
    present = contributions.where("state = 'present'").withColumn("authority_rank", authority_rank())
    level = present.groupBy("ref", "field", "authority_rank").agg(
        F.min(F.struct("backend", "method", "value")).alias("first"), (F.min("value") != F.max("value")).alias("conflict"))
    best = level.groupBy("ref", "field").agg(F.max(F.struct("authority_rank", "first", "conflict")).alias("b"))
    return best.select("ref", "field", F.col("b.first.value").alias("value"), F.col("b.first.backend").alias("backend"),
                       F.col("b.conflict").alias("conflict"))


def unique_by(df: DataFrame, keys: Sequence[str], ref: str, name: str) -> DataFrame:
    """(keys, name): the ref of keys that point to exactly one."""
    return df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(
        F.min(ref).alias(name), F.max(ref).alias("__hi")).where(F.col(name) == F.col("__hi")).drop("__hi")


def match_sources(source: DataFrame, semantic: DataFrame) -> DataFrame:
    """(ref, target, how): unique (module, name), else unique (module, range), else a name unique in the source and unknown to the other side."""
    by_name = unique_by(semantic, ["module", "name"], "ref", "m1")
    by_range = unique_by(semantic, ["module", "start_line", "end_line"], "ref", "m2")
    own = unique_by(source, ["name"], "ref", "m3").join(semantic.select("name").distinct(), "name", "left_anti")
    met = source.join(by_name, ["module", "name"], "left").join(by_range, ["module", "start_line", "end_line"], "left").join(own, "name", "left")
    return met.select("ref", F.coalesce("m1", "m2", "m3").alias("target"),
                      F.when(F.col("m1").isNotNull(), "name").when(F.col("m2").isNotNull(), "range")
                      .when(F.col("m3").isNotNull(), "source_only").otherwise("unmatched").alias("how"))


def coverage_status(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best status per key; not_applicable may only meet unknown, anything else is a conflict."""
    s = F.col("status")
    rank = F.when(s == "complete", 2).when(s == "partial", 1).otherwise(0)
    seen = values.groupBy(*keys).agg(F.max(rank).alias("r"), F.bool_or(s == "not_applicable").alias("na"))
    return seen.select(*keys, F.when(F.col("na"), "not_applicable").otherwise(F.element_at(F.array(*map(F.lit, COVERAGE)), F.col("r") + 1)).alias("status"),
                       (F.col("na") & (F.col("r") > 0)).alias("conflict"))


def provider_name(repo: Column) -> Column:
    """Provider alias: the last dependency tail, or lean for any ``.../lean``, in lower case."""
    tail = F.regexp_extract(repo, r"(?s)^.*/dependency/(.*)$", 1)
    return F.when(repo.contains("/dependency/"), F.lower(tail)).when(F.lower(repo).endswith("/lean"), "lean").otherwise(F.lower(repo))


def dotted_prefixes(name: Column, sep: str = ".") -> Column:
    """Every prefix of a dotted name, the name itself included."""
    parts = F.split(name, r"\." if sep == "." else sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def match_catalog(repos: DataFrame, catalog: DataFrame) -> DataFrame:
    """(repo_key, catalog_id) where exactly one catalog entry agrees on everything the repository knows."""
    c = catalog.select("catalog_id", "provider_name", "toolchain", F.col("revision").alias("c_rev"), F.col("digest").alias("c_dig"))
    met = repos.join(c, ["provider_name", "toolchain"]).where(
        (F.col("revision").isNull() | (F.col("revision") == F.col("c_rev"))) & (F.col("digest").isNull() | (F.col("digest") == F.col("c_dig"))))
    return unique_by(met, ["repo_key"], "catalog_id", "only").withColumnRenamed("only", "catalog_id")


def pair_evidence(evidence: DataFrame) -> DataFrame:
    """Per pair: which parts occur, the lowest and highest module, and whether a module is missing."""
    return evidence.groupBy("provider", "consumer").agg(
        F.bool_or(F.col("part") == "statement").alias("in_statement"), F.bool_or(F.col("part") == "proof").alias("in_proof"),
        F.min("provider_module").alias("m_lo"), F.max("provider_module").alias("m_hi"),
        F.bool_or(F.col("provider_module").isNull()).alias("no_module"))


def decide(pairs: DataFrame, repos: DataFrame, decls: DataFrame, catalog: DataFrame, entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Keep or hide every pair, with the first reason that applies.

    ``pairs`` from ``pair_evidence``; ``repos(repo_key, provider_name, version_status,
    toolchain, revision, digest, is_target)``; ``decls(ref, repo_key, outcome)``;
    ``entries(catalog_id, ref, classification, for_statement, for_proof)``;
    ``rules(provider_name, prefix, seq, rule_id)``.
    """
    hit = match_catalog(repos, catalog)
    named = catalog.select("provider_name", F.lit(True).alias("named")).distinct()
    prov = repos.join(hit, "repo_key", "left").join(named, "provider_name", "left").select(
        F.col("repo_key").alias("p_repo"), "provider_name", "version_status", "toolchain", "catalog_id", "named")
    target = repos.select(F.col("repo_key").alias("c_repo"), "is_target")
    p = decls.select(F.col("ref").alias("provider"), F.col("repo_key").alias("p_repo"), "outcome")
    c = decls.select(F.col("ref").alias("consumer"), F.col("repo_key").alias("c_repo"))
    met = pairs.join(p, "provider", "left").join(c, "consumer").join(prov, "p_repo", "left").join(target, "c_repo", "left")
    met = met.join(entries.withColumnRenamed("ref", "provider"), ["catalog_id", "provider"], "left")
    modules = pairs.where("m_lo = m_hi AND NOT no_module").select(F.col("m_lo").alias("module")).distinct()
    ruled = modules.select("module", F.explode(dotted_prefixes(F.col("module"))).alias("prefix")).join(rules, "prefix").groupBy(
        "provider_name", "module").agg(F.min(F.struct("seq", "rule_id")).alias("rule"))
    met = met.join(ruled.withColumnRenamed("module", "m_lo"), ["provider_name", "m_lo"], "left")
    entry = F.col("classification").isNotNull()
    fits = (~F.col("in_statement") | F.col("for_statement")) & (~F.col("in_proof") | F.col("for_proof"))
    one = ~F.col("no_module") & (F.col("m_lo") == F.col("m_hi"))
    reason = (
        F.when(~F.coalesce("is_target", F.lit(False)), "outside_target_repository")
        .when(F.col("p_repo") == F.col("c_repo"), "target_internal")
        .when(~F.coalesce(F.col("provider_name").isin(*AMBIENT), F.lit(False)), "other_project")
        .when(F.col("version_status").isNull() | (F.col("version_status") != "fixed") | F.col("toolchain").isNull(), "provider_unresolved")
        .when(F.col("outcome"), "important_outcome")
        .when(F.col("classification") == "reviewed_keep", "reviewed_keep")
        .when(entry & ~fits, "foundation_not_applicable_to_occurrence")
        .when(F.col("m_lo") != F.col("m_hi"), "provider_module_conflict")
        .when(one & F.col("rule").isNotNull(), F.concat(F.lit("source_module:"), "rule.rule_id"))
        .when(entry, "ambient_foundation")
        .when(F.col("catalog_id").isNotNull(), "foundation_unknown")
        .when(F.col("named"), "catalog_identity_mismatch").otherwise("catalog_missing"))
    out = met.withColumn("reason", reason)
    hidden = F.col("reason").startswith("source_module:") | (F.col("reason") == "ambient_foundation")
    return out.select("provider", "consumer", (~hidden).alias("keep"), "reason")


def resolve_tokens(tokens: DataFrame, symbols: DataFrame, visible: DataFrame) -> DataFrame:
    """Resolve names tier by tier: one candidate is an edge, several are ambiguous, none is unresolved.

    ``tokens(item, module, tier, name, token)`` lists the candidate names of a token;
    ``symbols(ref, module, name, public)``; ``visible(module, seen)`` the import
    closure.  Only (module, name) pairs that a token asks for are looked up, by name first.
    """
    met = tokens.join(looked_up(tokens.select("module", "name"), symbols, visible), ["module", "name"], "left")
    # Names of one tier together: lowest and highest ref over the tier tell none, one, or several.
    tier = met.groupBy("item", "token", "tier").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = F.when(F.col("lo").isNotNull(), F.struct("tier", "lo", "hi"))
    best = tier.groupBy("item", "token").agg(F.min(found).alias("b"))
    return best.select("item", "token", F.when(F.col("b").isNull(), "unresolved").when(F.col("b.lo") < F.col("b.hi"), "ambiguous").otherwise("edge").alias("status"),
                       F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).alias("ref"))


def type_head(text: Column) -> Column:
    """First name of a type text; null when it starts with a bracket or binder or has an operator outside brackets.

    One fold over the characters keeps the bracket depth, so brackets nest to any depth.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("compound"))

    def step(s, c):
        opens, shuts = c.isin(*"([{⟨"), c.isin(*")]}⟩")
        return F.struct(F.greatest(s["depth"] + F.when(opens, 1).when(shuts, -1).otherwise(0), F.lit(0)).alias("depth"),
                        (s["compound"] | ((s["depth"] == 0) & c.isin(*"→=≤≥<>∈∉≠↔∧∨"))).alias("compound"))

    compound = F.aggregate(F.split(text, ""), start, step)["compound"]
    name = F.nullif(F.regexp_extract(text, r"^\s*([\p{L}_][^\s()\[\]{}⟨⟩]*)", 1), F.lit(""))
    return F.when(~text.rlike(r"^\s*[(\[{⟨_∀]") & ~compound & (name != "fun"), name)


def method_calls(calls: DataFrame, symbols: DataFrame, parameters: DataFrame) -> DataFrame:
    """Outcome of ``Type.method`` calls: one confirmed candidate is an edge.

    ``calls(module, method)`` with the resolved receiver type, ``symbols(ref, name)``,
    ``parameters(ref, head)``.  Candidates are folded per name and receiver first.
    """
    takes = parameters.distinct().withColumn("takes", F.lit(True))
    heads = symbols.withColumn("head", F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)).join(takes, ["ref", "head"], "left")
    folded = heads.groupBy("name").agg(F.count("*").alias("n"), F.count("takes").alias("ok"), F.min(F.when(F.col("takes"), F.col("ref"))).alias("ref"))
    met = calls.withColumn("name", F.concat("module", F.lit("."), "method")).join(folded, "name", "left")
    return met.select("module", "method", F.when(F.col("n").isNull(), "unresolved").when(F.col("ok") == 0, "method_signature_unknown")
                      .when(F.col("ok") == 1, "edge").otherwise("ambiguous").alias("status"), F.when(F.col("ok") == 1, F.col("ref")).alias("ref"))
