"""Text functions, page and section extraction, document expansion and bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.functions import text as X
from strandwork.operators import materials as MT, merge as M, scopes as S
from strandwork.operators.order_stats import positions
from strandwork.plans.oracle_base import LINES, tree
from strandwork.plans.registry import query
from strandwork.session import kept, materialize
from strandwork.sources import derived as D


def docs(spark, d):
    return D.table(spark, d, "documents")


@query("b1_qualified_ids", tree("SELECT ref, to_json([repo_key, CAST(ref AS VARCHAR)])::VARCHAR AS id FROM decls"))
def qualified_ids(spark, d):
    return D.decls(spark, d).select("ref", X.qualified_id(F.col("repo_key"), F.col("ref").cast("string")).alias("id"))


@query("b2_row_digests", tree("SELECT ref, sha256(json_object('name', name, 'ref', ref, 'repo_key', repo_key)::VARCHAR) AS digest FROM decls"))
def row_digests(spark, d):
    return D.decls(spark, d).select("ref", X.digest("name", "ref", "repo_key").alias("digest"))


@query("b2_table_digest", """
WITH d AS (SELECT sha256(json_object('doc_id', doc_id, 'lang', lang, 'n_chars', n_chars, 'source', source, 'text_sha', sha256(text))::VARCHAR) AS h FROM documents)
SELECT count(*) AS rows, sum(('0x' || substr(h, 1, 8))::BIGINT)::BIGINT AS sum0, sum(('0x' || substr(h, 9, 8))::BIGINT)::BIGINT AS sum1, sum(('0x' || substr(h, 17, 8))::BIGINT)::BIGINT AS sum2, sum(('0x' || substr(h, 25, 8))::BIGINT)::BIGINT AS sum3, sum(('0x' || substr(h, 33, 8))::BIGINT)::BIGINT AS sum4, sum(('0x' || substr(h, 41, 8))::BIGINT)::BIGINT AS sum5, sum(('0x' || substr(h, 49, 8))::BIGINT)::BIGINT AS sum6, sum(('0x' || substr(h, 57, 8))::BIGINT)::BIGINT AS sum7 FROM d""")
def table_digest(spark, d):
    """Order-free digest of a table: the sums of all eight slices of every row digest, over all columns."""
    rows = docs(spark, d).select("doc_id", "lang", "n_chars", "source", F.sha2("text", 256).alias("text_sha")).select(
        X.digest("doc_id", "lang", "n_chars", "source", "text_sha").alias("h"))
    part = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("rows"), *[F.sum(part(i)).alias(f"sum{i}") for i in range(8)])


@query("b3_stable_ids", tree("SELECT ref, 'unit:' || substr(sha256(name), 1, 24) AS id FROM decls"))
def stable_ids(spark, d):
    return D.decls(spark, d).select("ref", X.stable_id(F.lit("unit"), F.col("name")).alias("id"))


@query("b4_provider_aliases", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN lower('Dep' || page_id) WHEN page_id % 3 = 1 THEN 'lean' ELSE lower(url) END AS provider FROM pages""")
def provider_aliases(spark, d):
    key = F.col("page_id")
    raw = F.when(key % 3 == 0, F.concat("url", F.lit("/dependency/Dep"), "page_id")).when(key % 3 == 1, F.concat("url", F.lit("/Lean"))).otherwise(F.col("url"))
    return D.table(spark, d, "pages").select("page_id", M.provider_name(raw).alias("provider"))


@query("b6_line_ranges", """
SELECT doc_id, substr(array_to_string(p[1:2], chr(10)), 3, greatest(0, length(array_to_string(p[1:2], chr(10))) - 2 - greatest(0, length(p[2]) - 4))) AS slice
FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) WHERE len(p) >= 2""")
def line_ranges(spark, d):
    """From line 1 column 3 up to line 2 column 5."""
    two = docs(spark, d).where(F.size(F.split("text", "\n")) >= 2)
    return two.select("doc_id", X.slice_lines(F.col("text"), F.lit(1), F.lit(3), F.lit(2), F.lit(5)).alias("slice"))


@query("b7_tokens", rf"""WITH {LINES}, t AS (SELECT doc_id, line_no, regexp_extract_all(line, '\p{{L}}+') AS f, string_split_regex(line, '\p{{L}}+') AS g FROM lines)
SELECT doc_id, sum(len(f))::BIGINT AS tokens, coalesce(sum(list_sum([list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(y) for y in f[1:i-1]]), 0) + 1 for i in range(1, len(f) + 1)])), 0)::BIGINT AS columns
FROM t GROUP BY doc_id""")
def tokens(spark, d):
    """Tokens per document and the sum of their columns."""
    found = X.tokens_with_columns(D.lines(spark, d), ["doc_id", "line_no"], "line", r"\p{L}+").groupBy("doc_id").agg(
        F.count("*").alias("tokens"), F.sum("col").alias("columns"))
    return docs(spark, d).select("doc_id").join(found, "doc_id", "left").fillna(0, ["tokens", "columns"])


@query("b8_name_parts", tree("SELECT ref, part FROM (SELECT ref, unnest(string_split(replace(name, '#', '.'), '.')) AS part FROM decls) WHERE NOT regexp_matches(part, '^[0-9]')"))
def name_parts(spark, d):
    return D.decls(spark, d).select("ref", F.explode(X.name_parts(F.replace("name", F.lit("#"), F.lit(".")))).alias("part"))


@query("b9_stripped_comments")
def stripped_comments(spark, d):
    """Documents with commas and sentence ends turned into comment marks; nesting is checked in tests."""
    source = F.replace(F.replace("text", F.lit(", "), F.lit(" /- ")), F.lit(". "), F.lit(" -/ "))
    return docs(spark, d).select("doc_id", F.length(X.strip_comments(source)).alias("size"))


@query("b10_unwrapped_source", "SELECT doc_id, trim(text, ' ') AS body FROM documents")
def unwrapped(spark, d):
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("head\n-- source-begin\n /--\n# generated note "), F.col("lang"), F.lit(" -/"), F.col("text"))).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", F.trim(X.unwrap(wrapped, "-- source-begin\n", "# generated note")).alias("body"))


@query("b11_html_text", r"""
SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')), '') AS body FROM pages""")
def html_text(spark, d):
    return D.table(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("body"))


@query("b12_prose_diagnostics", r"""
SELECT doc_id, 'control_character' AS code FROM documents WHERE regexp_matches(text, '[\x00-\x09\x0B-\x1F\x7F-\x9F]')
UNION ALL SELECT doc_id, 'raw_identifier' FROM documents WHERE regexp_matches(text, '(?:unit|scope|region|root|repo|node|edge|decl)[-:][A-Za-z0-9_.:/-]+|(?:/root/|/tmp/|[\w.-]+\.lean\b)')
UNION ALL SELECT doc_id, 'synopsis_length' FROM documents WHERE len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) NOT BETWEEN 80 AND 160
UNION ALL SELECT doc_id, 'many_displays' FROM documents WHERE (length(text) - length(replace(text, '$$', ''))) // 2 // 2 > 2""")
def prose_diagnostics(spark, d):
    text = F.col("text")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    rules = (("control_character", text.rlike(r"[\x00-\x09\x0B-\x1F\x7F-\x9F]")),
             ("raw_identifier", text.rlike(r"(?:unit|scope|region|root|repo|node|edge|decl)[-:][A-Za-z0-9_.:/-]+|(?:/root/|/tmp/|[\w.-]+\.lean\b)")),
             ("synopsis_length", ~words.between(80, 160)),
             ("many_displays", F.floor((F.length(text) - F.length(F.replace(text, F.lit("$$"), F.lit("")))) / 4) > 2))
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return docs(spark, d).select("doc_id", F.explode(found).alias("code"))


@query("b13_shortened", r"""
SELECT doc_id, CASE WHEN length(t) <= 360 THEN t ELSE substr(t, 1, 359) || '…' END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def shortened(spark, d):
    return docs(spark, d).select("doc_id", X.shorten(F.col("text")).alias("short"))


@query("b15_normal_paths", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/b/' || page_id WHEN 1 THEN 'a/b/' || page_id WHEN 2 THEN 'b/' || page_id WHEN 3 THEN NULL ELSE NULL END AS path FROM pages""")
def normal_paths(spark, d):
    key = F.col("page_id")
    raw = F.concat(F.when(key % 5 == 0, "a/b/").when(key % 5 == 1, "a\\./x/../b//").when(key % 5 == 2, "a/../b/").when(key % 5 == 3, "a/../../").otherwise("/"), "page_id")
    return D.table(spark, d, "pages").select("page_id", X.normal_path(raw).alias("path"))


@query("b16_format_checks", """
SELECT count(*) FILTER (regexp_full_match(sha256(text), '[0-9a-f]{40}|[0-9a-f]{64}')) AS digests, count(*) FILTER (regexp_full_match(text, '[0-9a-f]{40}|[0-9a-f]{64}')) AS plain FROM documents""")
def format_checks(spark, d):
    form = r"^[0-9a-f]{40}$|^[0-9a-f]{64}$"
    return docs(spark, d).agg(F.count_if(F.sha2("text", 256).rlike(form)).alias("digests"), F.count_if(F.col("text").rlike(form)).alias("plain"))


@query("b17_flattened_json", """
SELECT event_id, path, value FROM (SELECT event_id, 'props.k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events
UNION ALL SELECT event_id, 'tags.0', event_type FROM events UNION ALL SELECT event_id, 'tags.1', CAST(user_id AS VARCHAR) FROM events)""")
def flattened_json(spark, d):
    from strandwork.functions.variant import flatten

    rows = D.table(spark, d, "events").select("event_id", F.parse_json(F.concat(
        F.lit('{"props":'), "props", F.lit(',"tags":["'), "event_type", F.lit('",'), F.col("user_id").cast("string"), F.lit("]}"))).alias("v"))
    return flatten(rows, "event_id", "v")


@query("b18_module_prefix", "SELECT page_id, host = 'm' OR starts_with(host, 'm.') AS inside FROM (SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages)")
def module_prefix(spark, d):
    host = F.split(F.split("url", "//")[1], "/")[0]
    return D.table(spark, d, "pages").select("page_id", ((host == "m") | host.startswith("m.")).alias("inside"))


@query("b20_kind_and_visibility", tree("""
SELECT ref, CASE WHEN ref % 3 = 0 THEN 'private' ELSE 'public' END AS visibility, CASE ref % 4 WHEN 0 THEN 'theorem' WHEN 1 THEN 'def' WHEN 2 THEN 'lemma' ELSE 'structure' END AS kind FROM decls"""))
def kind_and_visibility(spark, d):
    ref = F.col("ref")
    head = F.concat(F.when(ref % 5 == 0, "@[simp] ").otherwise(""), F.when(ref % 3 == 0, "private ").otherwise(""), F.when(ref % 7 == 0, "noncomputable ").otherwise(""),
                    F.when(ref % 4 == 0, "theorem").when(ref % 4 == 1, "def").when(ref % 4 == 2, "lemma").otherwise("structure"), F.lit(" "), "name")
    kinds = "theorem|lemma|def|abbrev|axiom|constant|instance|structure|class|inductive|opaque"
    before = rf"^(?:@\[[^\]]*\]\s*)*((?:(?:private|protected|noncomputable|unsafe|partial)\s+)*)({kinds})\b"
    return D.decls(spark, d).select("ref", F.when(F.regexp_extract(head, before, 1).contains("private"), "private").otherwise("public").alias("visibility"),
                                    F.regexp_extract(head, before, 2).alias("kind"))


@query("b21_target_status", tree("""
SELECT o.l_orderkey, o.l_linenumber, count(*) FILTER (d.ref IS NOT NULL) AS exact, count(*) FILTER (d.ref IS NULL) AS unresolved
FROM lineitem o LEFT JOIN (SELECT ref FROM decls WHERE statement_text IS NOT NULL) d ON d.ref = o.l_partkey GROUP BY ALL"""))
def target_status(spark, d):
    known = D.decls(spark, d).where("statement_text IS NOT NULL").select(F.col("ref").alias("l_partkey"), F.lit("exact").alias("status"))
    met = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(known, "l_partkey", "left")
    return met.groupBy("l_orderkey", "l_linenumber").agg(F.count("status").alias("exact"), F.count_if(F.col("status").isNull()).alias("unresolved"))


@query("b22_position_conversion", tree("""
SELECT ref, CASE WHEN start_line < end_line OR (start_line = end_line AND coalesce(start_column, 0) < coalesce(end_column, 0)) THEN coalesce(start_column, 0) + 1 END AS start_column,
 CASE WHEN start_line < end_line OR (start_line = end_line AND coalesce(start_column, 0) < coalesce(end_column, 0)) THEN coalesce(end_column, 0) + 1 END AS end_column FROM decls"""))
def position_conversion(spark, d):
    zero = lambda c: F.coalesce(c, F.lit(0))
    s = X.span_or_null(F.col("start_line"), zero("start_column"), F.col("end_line"), zero("end_column"))
    return D.decls(spark, d).select("ref", s.alias("s")).select("ref", "s.start_column", "s.end_column")


@query("b23_material_text", tree("""
SELECT ref, CASE WHEN repo_key = 'ASIA' THEN coalesce(proof_text, statement_text, '') ELSE coalesce(statement_text, '') || coalesce(proof_text, '') END AS formal,
 concat_ws(chr(10), statement_text, proof_text) AS nl FROM decls"""))
def material_text(spark, d):
    s, p = F.col("statement_text"), F.col("proof_text")
    formal = F.when(F.col("repo_key") == "ASIA", F.coalesce(p, s, F.lit(""))).otherwise(F.concat(F.coalesce(s, F.lit("")), F.coalesce(p, F.lit(""))))
    return D.decls(spark, d).select("ref", formal.alias("formal"), F.concat_ws("\n", s, p).alias("nl"))


@query("b24_record_identity", f"""WITH {LINES} SELECT doc_id, count(DISTINCT sha256(json_object('doc_id', doc_id, 'line_no', line_no, 'line', line)::VARCHAR)) AS records FROM lines GROUP BY doc_id""")
def record_identity(spark, d):
    ids = D.lines(spark, d).select("doc_id", X.digest("doc_id", "line_no", "line").alias("id")).distinct()
    return ids.groupBy("doc_id").agg(F.count("*").alias("records"))


@query("b25_substring_position", f"""WITH {LINES} SELECT doc_id, min(line_no) AS line_no, arg_min(strpos(line, ' de '), line_no) AS col FROM lines WHERE contains(line, ' de ') GROUP BY doc_id""")
def substring_position(spark, d):
    hit = D.lines(spark, d).where(F.col("line").contains(" de ")).select("doc_id", "line_no", F.locate(" de ", "line").alias("col"))
    return hit.groupBy("doc_id").agg(F.min("line_no").alias("line_no"), F.min_by("col", "line_no").alias("col"))


@query("a11_module_scopes", "SELECT DISTINCT host_prefix AS scope FROM (SELECT unnest([array_to_string(p[1:i], '.') for i in range(1, len(p) + 1)]) AS host_prefix FROM (SELECT string_split(split_part(split_part(url, '//', 2), '/', 1), '.') AS p FROM pages))")
def module_scopes(spark, d):
    host = F.split(F.split("url", "//")[1], "/")[0]
    return D.table(spark, d, "pages").select(F.explode(M.dotted_prefixes(host)).alias("scope")).distinct()


@query("a12_provisional_ids", tree("""
SELECT ref, sha256(to_json([module, name, CAST(start_line AS VARCHAR)])::VARCHAR) AS id, count(*) OVER (PARTITION BY module, name, start_line) > 1 AS duplicate FROM decls"""))
def provisional_ids(spark, d):
    rows = D.decls(spark, d).select("ref", F.sha2(F.to_json(F.array("module", "name", F.col("start_line").cast("string"))), 256).alias("id"))
    twice = rows.groupBy("id").agg(F.count("*").alias("n"))
    return rows.join(twice, "id").select("ref", "id", (F.col("n") > 1).alias("duplicate"))


@query("a13_published_graph", f"""WITH {LINES} SELECT doc_id, line_no - 1 AS node, (line_no - 1) * 3 + doc_id % 7 AS target FROM lines""")
def published_graph(spark, d):
    """Adjacency published as offsets and targets per document (one target per line), read back into edges."""
    from strandwork.sources.published import csr_edges

    lines = docs(spark, d).select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    ints = lambda hi, f: F.array_join(F.transform(F.sequence(F.lit(0), hi), lambda i: f(i).cast("string")), ",")
    text = F.concat(F.lit("window.EDGES={off:["), ints(F.col("n"), lambda i: i), F.lit("],dst:["), ints(F.col("n") - 1, lambda i: i * 3 + F.col("doc_id") % 7), F.lit("]};"))
    return csr_edges(lines.select("doc_id", text.alias("text")), "doc_id", "text", "EDGES")


@query("a14_callback_shards", r"""
WITH RECURSIVE f(name, i, h) AS (SELECT s_name, 0, 2166136261::UBIGINT FROM supplier UNION ALL
 SELECT name, i + 1, (xor(h, ord(substr(name, i + 1, 1))::UBIGINT) * 16777619::UBIGINT) & 4294967295::UBIGINT FROM f WHERE i < length(name))
SELECT name, (h % 256)::INTEGER AS shard FROM f WHERE i = length(name)""")
def callback_shards(spark, d):
    return D.table(spark, d, "supplier").select(F.col("s_name").alias("name"), X.fnv_shard(F.col("s_name")).alias("shard"))


@query("a15_page_attributes", r"""
SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS links FROM pages""")
def page_attributes(spark, d):
    return D.table(spark, d, "pages").select(
        "page_id", F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        F.size(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1))).alias("links"))


@query("a15_page_links", """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/?([^"]*)"', 1)) AS target FROM pages""")
def page_links(spark, d):
    return D.table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="/?([^"]*)"'), 1))).alias("target"))


MARKED = f"{LINES}, marked AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 2 THEN '## ' || line || ' `' || split_part(line, ' ', 1) || '`' ELSE line END AS line FROM lines)"


def marked_lines(spark, d):
    head = F.concat(F.lit("## "), "line", F.lit(" `"), F.split("line", " ")[0], F.lit("`"))
    return D.lines(spark, d).withColumn("line", F.when(F.col("line_no") % 5 == 2, head).otherwise(F.col("line")))


@query("a16_heading_sections", rf"""WITH {MARKED}, s AS (SELECT *, sum((regexp_matches(line, '^#{{1,6}}\s+\S'))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section,
 max((regexp_matches(line, '^#{{1,6}}\s+\S'))::INT) OVER (PARTITION BY doc_id) AS any_h FROM marked)
SELECT doc_id, section, min(line_no) AS start_line, max(line_no) AS end_line, length(string_agg(line, chr(10) ORDER BY line_no)) AS size FROM s WHERE section > 0 OR any_h = 0 GROUP BY ALL""")
def heading_sections(spark, d):
    heading = F.col("line").rlike(r"^#{1,6}\s+\S")
    title = F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*#*$", 1)
    return MT.sections(marked_lines(spark, d), heading, title).select("doc_id", "section", "start_line", "end_line", F.length("text").alias("size"))


@query("a16_section_landmarks", rf"""WITH {MARKED} SELECT DISTINCT doc_id, unnest(regexp_extract_all(line, '`([^`]+)`', 1)) AS name FROM marked""")
def section_landmarks(spark, d):
    return marked_lines(spark, d).select("doc_id", F.explode(F.regexp_extract_all("line", F.lit("`([^`]+)`"), 1)).alias("name")).distinct()


@query("a17_alignment_entries", r"""
WITH e AS (SELECT DISTINCT page_id AS entry, unnest(regexp_extract_all(html, 'href="/([^";]*)"', 1)) AS name FROM pages),
w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS name FROM benchmark), k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS name FROM conversations)
SELECT e.entry, e.name, k.name IS NOT NULL AS bound FROM e JOIN w ON w.name = e.name LEFT JOIN k ON k.name = e.name""")
def alignment_entries(spark, d):
    """Entries that list several names in one field, split, filtered by an allow-list and bound."""
    words = lambda t: D.table(spark, d, t).select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("name")).distinct()
    field = F.array_join(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="/([^";]*)"'), 1)), "; ")
    names = D.table(spark, d, "pages").select(F.col("page_id").alias("entry"), F.explode(F.split(field, r"\s*;\s*")).alias("name")).distinct()
    known = words("conversations").withColumn("hit", F.lit(True))
    return names.join(words("benchmark"), "name", "left_semi").join(known, "name", "left").select("entry", "name", F.col("hit").isNotNull().alias("bound"))


@query("a18_text_sections", rf"""WITH {LINES}, s AS (SELECT *, sum((length(line) < 60)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section, max((length(line) < 60)::INT) OVER (PARTITION BY doc_id) AS any_h FROM lines)
SELECT doc_id, section, count(*) AS lines FROM s WHERE section > 0 OR any_h = 0 GROUP BY ALL""")
def text_sections(spark, d):
    """Plain text cut at short lines."""
    cut = MT.sections(D.lines(spark, d), F.length("line") < 60, F.col("line"))
    return cut.select("doc_id", "section", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))


INCLUDE = """
nd AS (SELECT count(*) AS n FROM documents),
inc AS (SELECT doc_id AS file, k AS seq, doc_id * 2 + k AS target FROM documents, (VALUES (1), (2)) v(k), nd WHERE doc_id * 2 + k < n
        UNION ALL SELECT doc_id, 3, 1 FROM documents WHERE doc_id % 100 = 30),
occ AS (SELECT 0::BIGINT AS file, [0::BIGINT] AS chain, CAST([] AS BIGINT[]) AS key
        UNION ALL SELECT i.target, list_append(o.chain, i.target), o.key || [1::BIGINT, i.seq::BIGINT] FROM occ o JOIN inc i ON i.file = o.file WHERE NOT list_contains(o.chain, i.target))"""


@query("a19_expanded_documents", f"""WITH RECURSIVE {LINES}, {INCLUDE},
ev AS (SELECT o.file, l.line_no, row_number() OVER (ORDER BY o.key || [l.line_no]) - 1 AS position FROM occ o JOIN lines l ON l.doc_id = o.file)
SELECT file, line_no, position FROM ev WHERE NOT (line_no = 1 AND file IN (SELECT file FROM inc))""")
def expanded_documents(spark, d):
    """All documents hung under the first one by includes on line 1, some included twice."""
    tables, reached = _included(spark, d)
    events = kept(spark, ("expanded", d), lambda: MT.expand_includes(*tables, reached)[0])
    return events.select("file", "line_no", "position")


@query("a19_include_diagnostics", f"""WITH RECURSIVE {INCLUDE} SELECT i.target AS file, 'include_cycle' AS code, count(*) AS n FROM occ o JOIN inc i ON i.file = o.file WHERE list_contains(o.chain, i.target) GROUP BY ALL""")
def include_diagnostics(spark, d):
    return _included(spark, d)[1][2].groupBy("file", "code").agg(F.sum("n").alias("n"))


def _included(spark, d):
    """The lines, includes and root of ``documents``, and what the root reaches."""
    def build():
        n = docs(spark, d).agg(F.count("*")).scalar()
        base = docs(spark, d).select(F.col("doc_id").alias("file")).withColumn("n", n)
        kids = base.select("file", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "n").withColumn("target", F.col("file") * 2 + F.col("seq")).where("target < n")
        again = base.where("file % 100 = 30").select("file", F.lit(3).alias("seq"), F.lit(1).cast("long").alias("target"))
        includes = kids.select("file", F.lit(1).alias("line_no"), "seq", "target").unionAll(again.select("file", F.lit(1), "seq", "target"))
        lines = D.lines(spark, d).select(F.col("doc_id").alias("file"), "line_no")
        roots = base.where("file = 0").select(F.col("file").alias("root"))
        tables = materialize(lines), materialize(includes), roots
        return tables, MT.include_states(*tables)

    return kept(spark, ("included", d), build)


TEX = rf"""
nl AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM lines),
tex AS (SELECT source AS root, n.doc_id * 4294967296 + line_no AS pos, n.doc_id, CASE WHEN line_no = 1 AND n.doc_id % 10 = 0 THEN 'chapter' WHEN line_no = 1 THEN 'section' WHEN line_no % 6 = 2 THEN 'subsection' END AS hk,
  CASE WHEN line_no % 6 = 3 AND line_no + 2 <= total THEN CASE WHEN line_no % 12 = 3 THEN 'theorem' ELSE 'proof' END END AS opens,
  line_no % 6 = 4 AND line_no + 1 <= total AND line_no % 12 = 4 AS names, line_no % 6 = 5 AS closes, trim(line) = '' AND line_no > 1 AND line_no % 6 IN (0, 1) AS blank FROM nl n JOIN documents d ON d.doc_id = n.doc_id),
ol AS (SELECT *, CASE hk WHEN 'chapter' THEN 2 WHEN 'section' THEN 3 WHEN 'subsection' THEN 4 END AS level FROM tex WHERE NOT blank),
pr AS (SELECT *, max(CASE WHEN level IS NOT NULL THEN pos END) OVER w AS any_h, max(CASE WHEN level < 3 THEN pos END) OVER w AS h3, max(CASE WHEN level < 4 THEN pos END) OVER w AS h4,
   max(CASE WHEN opens IS NOT NULL THEN pos END) OVER w AS lo, max(CASE WHEN closes THEN pos END) OVER (PARTITION BY root ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc
   FROM ol WINDOW w AS (PARTITION BY root ORDER BY pos))"""


def tex_rows(spark, d):
    """Documents of one source as one long document with heading, environment and name commands on fixed lines."""
    n = F.col("line_no")
    # Of a text only which lines are blank is told, so documents meet their sources and line counts as short rows.
    told = docs(spark, d).where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.trim(x) == "").alias("blank"))
    total = told.groupBy("doc_id").agg(F.sum(F.size("blank")).alias("total"))
    text = (F.when((n == 1) & (F.col("doc_id") % 10 == 0), F.concat(F.lit("\\chapter{C"), "doc_id", F.lit("}")))
            .when(n == 1, F.concat(F.lit("\\section{S"), "doc_id", F.lit("} % note")))
            .when(n % 6 == 2, F.concat(F.lit("\\subsection*{L"), "line_no", F.lit("}")))
            .when((n % 6 == 3) & (n + 2 <= F.col("total")), F.concat(F.lit("\\begin{"), F.when(n % 12 == 3, "theorem").otherwise("proof"), F.lit("}\\label{t"), "doc_id", F.lit("}")))
            .when((n % 12 == 4) & (n + 1 <= F.col("total")), F.concat(F.lit("\\lean{W"), "doc_id", F.lit(", V"), "line_no", F.lit("}")))
            .when(n % 6 == 5, F.concat(F.lit("\\end{"), F.when(n % 12 == 5, "theorem").otherwise("proof"), F.lit("}")))
            .when(n % 6 > 1, F.lit("plain")).when(F.col("blank"), F.lit("")).otherwise(F.lit("words")))
    whole = told.join(total, "doc_id").join(docs(spark, d).select("doc_id", F.col("source").alias("root")), "doc_id")
    return whole.select("doc_id", "root", "total", F.posexplode("blank").alias("at", "blank")).withColumn("line_no", F.col("at") + 1).select(
        "root", (F.shiftleft("doc_id", 32) + n).alias("pos"), text.alias("text"))


def outlined(spark, d):
    return kept(spark, ("outline", d), lambda: materialize(MT.outline(tex_rows(spark, d))))


@query("a20_document_outline", f"""WITH {LINES}, {TEX}
SELECT root, pos, level, CASE WHEN level IS NULL THEN any_h WHEN level = 2 THEN NULL WHEN level = 3 THEN h3 ELSE h4 END AS parent_pos,
 CASE WHEN lo IS NOT NULL AND (lc IS NULL OR lc < lo) THEN lo END AS opened FROM pr""")
def document_outline(spark, d):
    return outlined(spark, d).select("root", "pos", "level", "parent_pos", "opened")


@query("f11_heading_parents", f"""WITH {LINES}, {TEX}
SELECT root, level, count(*) AS headings, count(CASE WHEN level = 2 THEN NULL WHEN level = 3 THEN h3 ELSE h4 END) AS nested FROM pr WHERE level IS NOT NULL GROUP BY ALL""")
def heading_parents(spark, d):
    return outlined(spark, d).where("level IS NOT NULL").groupBy("root", "level").agg(F.count("*").alias("headings"), F.count("parent_pos").alias("nested"))


@query("a21_environment_bindings", f"""WITH {LINES}, {TEX},
env AS (SELECT root, pos AS opened, opens AS environment, doc_id FROM ol WHERE opens IS NOT NULL),
nm AS (SELECT e.root, e.opened, e.environment, unnest(['W' || o.doc_id, 'V' || (o.pos % 4294967296)]) AS name FROM env e JOIN ol o ON o.root = e.root AND o.names AND o.pos = e.opened + 1),
pv AS (SELECT *, max(CASE WHEN environment <> 'proof' THEN opened END) OVER (PARTITION BY root ORDER BY opened) AS prior FROM env)
SELECT root, opened, environment, name FROM nm UNION SELECT p.root, p.opened, p.environment, n.name FROM pv p JOIN nm n ON n.root = p.root AND n.opened = p.prior WHERE p.environment = 'proof'""")
def environment_bindings(spark, d):
    return MT.bind_environments(outlined(spark, d))


@query("a22_linked_ranges", rf"""WITH {LINES}, s AS (SELECT *, sum((length(line) < 60)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM lines),
r AS (SELECT doc_id, section, min(line_no) AS a, max(line_no) AS b FROM s WHERE section > 0 GROUP BY ALL)
SELECT l.doc_id, r.section, l.doc_id % 9 + 1 AS link_line FROM labels l JOIN r ON r.doc_id = l.doc_id AND l.doc_id % 9 + 1 BETWEEN r.a AND r.b""")
def linked_ranges(spark, d):
    """Links to a line of a document, bound to the section that covers the line."""
    cut = MT.sections(D.lines(spark, d), F.length("line") < 60, F.col("line")).where("section > 0").select("doc_id", "section", "start_line", "end_line")
    links = D.table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 9 + 1).alias("link_line"))
    return links.join(cut, "doc_id").where("link_line BETWEEN start_line AND end_line").select("doc_id", "section", "link_line")


@query("a23_attached_materials", tree("""
SELECT d.ref, count(*) AS attached FROM (SELECT conv_id, turn, (conv_id * 7 + turn) % (SELECT count(*) FROM part) AS ref FROM conversations WHERE turn % 4 <> 3) b JOIN decls d ON d.ref = b.ref WHERE d.statement_text IS NOT NULL GROUP BY d.ref"""))
def attached_materials(spark, d):
    n = D.table(spark, d, "part").agg(F.count("*")).scalar()
    bind = D.table(spark, d, "conversations").where("turn % 4 <> 3").withColumn("n", n).select(((F.col("conv_id") * 7 + F.col("turn")) % F.col("n")).alias("ref"))
    return bind.join(D.decls(spark, d).where("statement_text IS NOT NULL").select("ref"), "ref", "left_semi").groupBy("ref").agg(F.count("*").alias("attached"))


@query("a24_combined_materials", """
WITH RECURSIVE r AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '/' || turn AS record, CASE WHEN turn > 0 THEN CAST(conv_id AS VARCHAR) || '/' || (turn - 1) END AS parent,
  ('0x' || substr(sha256(text), 1, 15))::BIGINT::HUGEINT AS o0, ('0x' || substr(sha256(text), 16, 15))::BIGINT::HUGEINT AS o1, ('0x' || substr(sha256(text), 31, 15))::BIGINT::HUGEINT AS o2, ('0x' || substr(sha256(text), 46, 15))::BIGINT::HUGEINT AS o3 FROM conversations),
c(record, h0, h1, h2, h3) AS (SELECT record, o0, o1, o2, o3 FROM r WHERE turn = 0
  UNION ALL SELECT r.record, (c.h0 * 1000003 + r.o0) % 2305843009213693951, (c.h1 * 1000033 + r.o1) % 2305843009213693951, (c.h2 * 1000037 + r.o2) % 2305843009213693951, (c.h3 * 1000039 + r.o3) % 2305843009213693951 FROM c JOIN r ON r.parent = c.record)
SELECT record, sha256(record || ':' || h0 || ':' || h1 || ':' || h2 || ':' || h3) AS new_id FROM c""")
def combined_materials(spark, d):
    """Conversation turns as nested records: the id of a record covers the chain above it."""
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("/"), t.cast("string"))
    turn = F.col("turn")
    rows = D.table(spark, d, "conversations").select(name(turn).alias("record"), F.when(turn > 0, name(turn - 1)).alias("parent"), F.col("text").alias("body"))
    return MT.rebased(materialize(rows))


@query("a25_published_kinds", tree("SELECT ref, 'theorem' AS kind, 'published' AS origin FROM decls WHERE outcome"))
def published_kinds(spark, d):
    said = F.concat(F.lit("theorem "), "name", F.lit(" : True"))
    return D.decls(spark, d).where("outcome").select("ref", F.regexp_extract(said, r"^\s*(theorem|lemma|def)\b", 1).alias("kind"), F.lit("published").alias("origin"))


@query("a29_source_contributions", tree("""
SELECT ref, field, value FROM (SELECT ref, 'lean_name' AS field, name AS value FROM decls UNION ALL SELECT ref, 'statement.formal', statement_text FROM decls
 UNION ALL SELECT ref, 'proof.formal', proof_text FROM decls WHERE kind IN ('PROMO', 'ECONOMY')) WHERE value IS NOT NULL"""))
def source_contributions(spark, d):
    rows = D.decls(spark, d).select("ref", F.col("name").alias("lean_name"), F.col("statement_text").alias("statement.formal"),
                                    F.when(F.col("kind").isin("PROMO", "ECONOMY"), F.col("proof_text")).alias("proof.formal"))
    return rows.unpivot("ref", ["lean_name", "`statement.formal`", "`proof.formal`"], "field", "value").where("value IS NOT NULL")


@query("a30_wide_to_fields", tree("""
SELECT ref, field, value, 'catalog' AS authority FROM (SELECT ref, 'module' AS field, module AS value FROM decls UNION ALL SELECT ref, 'kind', kind FROM decls UNION ALL SELECT ref, 'local_public', CAST(local_public AS VARCHAR) FROM decls)"""))
def wide_to_fields(spark, d):
    rows = D.decls(spark, d).select("ref", "module", "kind", F.col("local_public").cast("string").alias("local_public"))
    return rows.unpivot("ref", ["module", "kind", "local_public"], "field", "value").withColumn("authority", F.lit("catalog"))


@query("a31_locked_dependencies", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'unfixed_revision' WHEN c_custkey % 7 = 0 THEN 'missing_directory' WHEN rn > 1 THEN 'duplicate' END AS reason
FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS rn FROM customer)""")
def locked_dependencies(spark, d):
    rows = D.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    first = rows.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("lead"))
    k = F.col("c_custkey")
    return rows.join(first, ["c_nationkey", "c_mktsegment"]).select("c_custkey", F.when(k % 4 == 0, "unfixed_revision").when(k % 7 == 0, "missing_directory").when(k != F.col("lead"), "duplicate").alias("reason"))


@query("a32_order_hints", """
SELECT c.conv_id, c.turn, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS pos FROM conversations c
WHERE c.turn % 3 <> 1 AND (SELECT count(*) FROM conversations q WHERE q.conv_id = c.conv_id AND q.turn % 3 <> 1) >= 2""")
def order_hints(spark, d):
    """Order positions kept in record payloads become sequences of at least two members."""
    payload = F.parse_json(F.to_json(F.struct(F.struct(F.when(F.col("turn") % 3 != 1, F.col("turn")).alias("position")).alias("order"))))
    rows = D.table(spark, d, "conversations").select("conv_id", "turn", F.try_variant_get(payload, "$.order.position", "long").alias("hint")).where("hint IS NOT NULL")
    big = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where("n >= 2").select("conv_id")
    return positions(rows.join(big, "conv_id", "left_semi"), ["conv_id"], ["hint"], "pos").select("conv_id", "turn", "pos")


@query("a33_configured_sequences", tree("SELECT folder_id AS sequence, module AS member, row_number() OVER (PARTITION BY folder_id ORDER BY module) - 1 AS pos FROM (SELECT DISTINCT 'n:' || n_nationkey AS folder_id, module FROM homes)"))
def configured_sequences(spark, d):
    rows = D.homes(spark, d).select(F.concat(F.lit("n:"), "n_nationkey").alias("sequence"), F.col("module").alias("member")).distinct()
    return positions(rows, ["sequence"], ["member"], "pos")


@query("e11_source_summary", tree("""
SELECT scope_id, count(*) AS members, count(path) AS located, count(DISTINCT CASE WHEN path IS NOT NULL THEN struct_pack(a := start_line, b := end_line) END) AS ranges,
 min(CASE WHEN path IS NOT NULL THEN start_line END) AS first, max(CASE WHEN path IS NOT NULL THEN start_line END) AS last FROM decls GROUP BY scope_id"""))
def source_summary(spark, d):
    line = F.when(F.col("path").isNotNull(), F.col("start_line"))
    return D.decls(spark, d).groupBy("scope_id").agg(
        F.count("*").alias("members"), F.count("path").alias("located"),
        F.count_distinct(F.when(F.col("path").isNotNull(), F.struct("start_line", "end_line"))).alias("ranges"), F.min(line).alias("first"), F.max(line).alias("last"))


@query("e12_interval_union", tree("""
SELECT path, sum(greatest(0, e - greatest(s, coalesce(m, 0))))::BIGINT AS size FROM (SELECT path, start_line AS s, end_line + 1 AS e,
 max(end_line + 1) OVER (PARTITION BY path ORDER BY start_line, end_line, ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM decls WHERE path IS NOT NULL) GROUP BY path"""))
def interval_union(spark, d):
    """Lines covered per file, overlaps counted once; a file may hold any number of ranges."""
    from strandwork.operators.order_stats import running

    rows = D.decls(spark, d).where("path IS NOT NULL").select("path", "ref", F.col("start_line").alias("s"), (F.col("end_line") + 1).alias("e"))
    upto = materialize(positions(running(rows, ["path"], ["s", "e", "ref"], {"m": F.col("e")}, fold="max"), ["path"], ["s", "e", "ref"], "i"))
    before = upto.select("path", (F.col("i") + 1).alias("i"), F.col("m").alias("prev"))
    return upto.join(before, ["path", "i"], "left").groupBy("path").agg(
        F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("prev", F.lit(0))))).alias("size"))


@query("b19_line_contexts", f"""WITH {LINES} SELECT doc_id, line_no, CASE WHEN (line_no - 1) % 9 < 2 OR (line_no - 1) % 9 IN (4, 5) THEN 'A' || (line_no - (line_no - 1) % 9)
 WHEN (line_no - 1) % 9 IN (2, 3) THEN 'A' || (line_no - (line_no - 1) % 9) || '.B' || (line_no - (line_no - 1) % 9 + 2) ELSE '' END AS namespace FROM lines""")
def line_contexts(spark, d):
    """Namespace at every line, from opening and closing commands on fixed lines."""
    r = (F.col("line_no") - 1) % 9
    command = (F.when(r == 0, F.concat(F.lit("namespace A"), "line_no")).when(r == 2, F.concat(F.lit("namespace B"), "line_no"))
               .when(r.isin(4, 6), F.lit("end")).otherwise(F.lit("x")))
    return MT.namespaces(D.lines(spark, d).select("doc_id", "line_no", command.alias("line")))


@query("d26_type_heads", tree("""
SELECT ref, scope_id AS head FROM decls WHERE start_line % 4 IN (0, 3)"""))
def type_heads(spark, d):
    """Head declaration of a type text, unless an operator at the top level makes it a compound."""
    r = F.col("start_line") % 4
    text = F.concat(F.when(r == 2, "(").otherwise(""), "module", F.when(r == 0, " (a -> [b = c])").when(r == 1, " -> (x)").when(r == 2, ") y").otherwise(""))
    modules = D.scopes(spark, d).where("kind = 'module'").select(F.col("name").alias("token"), F.col("scope_id").alias("head"))
    heads = M.unique_by(modules, ["token"], "head", "only").withColumnRenamed("only", "head")
    return D.decls(spark, d).select("ref", M.type_head(text).alias("token")).where("token IS NOT NULL").join(heads, "token").select("ref", "head")


@query("d17_method_lookup", tree("""
SELECT module, method, CASE WHEN count(ref) = 0 THEN 'unresolved' WHEN count(ref) FILTER (takes) = 0 THEN 'method_signature_unknown' WHEN count(ref) FILTER (takes) = 1 THEN 'edge' ELSE 'ambiguous' END AS status
FROM call LEFT JOIN cand ON cand.name = module || '.' || method GROUP BY ALL""", """
cand AS (SELECT module || '.' || kind AS name, ref, path IS NOT NULL AND local_public AS takes FROM decls), call AS (SELECT DISTINCT module, CASE WHEN l_linestatus = 'O' THEN 'PROMO' ELSE 'ECONOMY' END AS method
  FROM lineitem JOIN homes ON s_suppkey = l_suppkey)"""))
def method_lookup(spark, d):
    """``Type.method`` calls: candidates by name, confirmed when a parameter is of the receiver's type."""
    homes = D.homes(spark, d).select(F.col("s_suppkey").alias("l_suppkey"), "module")
    calls = D.table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_linestatus") == "O", "PROMO").otherwise("ECONOMY").alias("method")).distinct().join(homes, "l_suppkey").select("module", "method")
    decls = D.decls(spark, d)
    symbols = decls.select("ref", F.concat("module", F.lit("."), "kind").alias("name"))
    params = decls.where("path IS NOT NULL AND local_public").select("ref", F.col("module").alias("head"))
    return M.method_calls(calls, symbols, params).select("module", "method", "status")


SCOPED_LINES = rf"""{LINES},
words AS (SELECT doc_id, line_no, regexp_extract_all(line, '[a-zA-Z]+') AS w FROM lines),
said AS (SELECT doc_id, line_no, coalesce(w[2], '') AS word,
   CASE WHEN len(w) < 2 THEN '' ELSE ['namespace', 'section', 'end', 'open', 'public section', 'end named', 'module', 'import', 'namespace', '', 'open', 'import'][1 + length(w[1]) % 12] END AS command FROM words),
turn(doc_id, line_no, stack) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, [{{'name': '', 'ns': '', 'opens': '', 'public': true}}] FROM lines
  UNION ALL
  SELECT t.doc_id, s.line_no, CASE
    WHEN command = 'namespace' THEN list_append(stack, {{'name': word, 'ns': CASE WHEN stack[-1].ns = '' THEN word ELSE stack[-1].ns || '.' || word END, 'opens': stack[-1].opens, 'public': stack[-1].public}})
    WHEN command = 'section' THEN list_append(stack, {{'name': word, 'ns': stack[-1].ns, 'opens': stack[-1].opens, 'public': stack[-1].public}})
    WHEN command = 'public section' THEN list_append(stack, {{'name': '', 'ns': stack[-1].ns, 'opens': stack[-1].opens, 'public': true}})
    WHEN command = 'open' AND word NOT IN ('in', 'scoped') THEN list_append(stack[:-2], {{'name': stack[-1].name, 'ns': stack[-1].ns, 'opens': stack[-1].opens || stack[-1].ns || '>' || word || ';', 'public': stack[-1].public}})
    WHEN command = 'module' THEN list_append(stack[:-2], {{'name': stack[-1].name, 'ns': stack[-1].ns, 'opens': stack[-1].opens, 'public': false}})
    WHEN command = 'end' AND len(stack) > 1 THEN stack[:-2]
    WHEN command = 'end named' THEN stack[:coalesce(list_max(list_filter(range(2, len(stack) + 1), lambda k: array_to_string(list_transform(stack[k:], lambda f: f.name), '.') = word)) - 1, len(stack))]
    ELSE stack END
  FROM turn t JOIN said s ON s.doc_id = t.doc_id AND s.line_no = t.line_no + 1)"""


def scoped_lines(spark, d):
    """Every line of the documents as the command that its first word's length stands for, on its second word."""
    words = F.regexp_extract_all("line", F.lit("([a-zA-Z]+)"), 1)
    word = F.coalesce(F.get("w", F.lit(1)), F.lit(""))
    command = F.array(*map(F.lit, ("namespace", "section", "end", "open", "public section", "end named", "module", "import", "namespace", "", "open", "import")))
    said = F.when(F.size("w") < 2, "").otherwise(F.get(command, F.length(F.get("w", F.lit(0))) % 12))
    rows = D.lines(spark, d).select("doc_id", "line_no", words.alias("w")).select("doc_id", "line_no", word.alias("word"), said.alias("command"))
    c = F.col("command")
    line = F.when(c == "end named", F.concat(F.lit("end "), "word")).when(c.isin("namespace", "section", "open", "import"), F.concat(c, F.lit(" "), "word")).otherwise(c)
    return rows.select("doc_id", "line_no", line.alias("line"))


@query("b19_scope_contexts", f"""WITH RECURSIVE {SCOPED_LINES}
SELECT doc_id, line_no, stack[-1].ns AS namespace, stack[-1].opens AS opens, stack[-1].public AS public FROM turn WHERE line_no > 0""")
def scope_contexts(spark, d):
    """Namespace, opened namespaces and visibility after every line, from commands that nest and close by name."""
    opens = F.array_join(F.transform("opens", lambda o: F.concat(o["at"], F.lit(">"), o["name"], F.lit(";"))), "")
    return S.contexts(scoped_lines(spark, d)).select("doc_id", "line_no", "namespace", opens.alias("opens"), "public")


@query("b19_imports", f"""WITH RECURSIVE {SCOPED_LINES} SELECT DISTINCT doc_id, word AS module FROM said WHERE command = 'import'""")
def line_imports(spark, d):
    return S.imports(scoped_lines(spark, d))
