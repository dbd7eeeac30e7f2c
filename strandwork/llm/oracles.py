"""Checking SQL (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_VERDICTS = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM cut
), parts AS (
  SELECT page_id, """ + LOWER.format("coalesce(raw_host, '')") + """ AS host,
         coalesce(regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*'), '') AS path FROM hosts
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM (
  SELECT *, (SELECT arg_max({'rule': rule_host || rule_path, 'verdict': rule_verdict}, length(rule_host || rule_path)) FROM rules
             WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM parts)
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BENCHMARK_LEAKS = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '{_WORD}'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWER.format("text")}, '{_WORD}') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), spots AS (
  SELECT item_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM sized
), windows AS (
  SELECT DISTINCT item_id, n, w[i:i + n - 1] AS win FROM spots
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT row, n, w, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM d, sizes WHERE len(w) >= n
), met AS (
  SELECT p.row, p.i, p.n, x.item_id FROM places p JOIN windows x ON x.n = p.n AND x.win = p.w[p.i:p.i + p.n - 1]
), hits AS (
  SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM met) GROUP BY row
), items AS (
  SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM met) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN items USING (row)
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
_BASE = [
    ("assign", rf"""({_KEYWORDS})[""'']?\x20*[:=]\x20*[""'']?([A-Za-z0-9+/_.=-]+)""".replace('""', '"'), 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
]


def _found(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: matches and the gaps between them give the places."""
    return f"""
  SELECT row, {number} AS k, '{kind}' AS kind, length(f) AS size, length(v) >= {least} AS kept,
         list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS start
  FROM (SELECT row, g, m, unnest(m) AS f, unnest(v) AS v, unnest(range(1, (len(m) + 1)::BIGINT)) AS i
        FROM (SELECT row, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v,
                     string_split_regex(text, '{pattern}') AS g FROM d))"""


#: The tables hold no token with a checksum, so the added kind is empty here.
SECRET_SCAN = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_found(i, *b) for i, b in enumerate(_BASE))}),
lists AS (
  SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, k) AS spans
  FROM found WHERE kept GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, 0::BIGINT AS n_checked,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lists USING (row)
"""

NEAR_GROUPS = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE [w[i:i + 2] for i in range(1, (len(w) - 1)::BIGINT)] END) AS s FROM d
), sized AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.x, b.y FROM reach r JOIN ways b ON b.x = r.y
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN sized USING (doc_id) JOIN least ON least.x = d.doc_id
"""

_BLANK = r"[^\x20\x09-\x0D]+"
FILTER_ORDERS = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{_BLANK}') AS words FROM d
), firsts AS (
  SELECT text, min(doc_id) AS least FROM d GROUP BY text
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT w.row, part,
         {{'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
           'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
           'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(least < w.doc_id, false)}} AS f,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w JOIN firsts USING (text) LEFT JOIN marks ON marks.doc_id = w.doc_id
), cells AS (
  SELECT part, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END,
                      CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM judged GROUP BY ALL
), ways(way) AS (
  SELECT '' UNION ALL SELECT way || x FROM ways, unnest(['A', 'B', 'C', 'D', 'E']) AS t(x) WHERE NOT contains(way, x)
), steps AS (
  SELECT way AS filter_order, k::INTEGER AS step, substr(way, 1, k - 1) AS earlier, substr(way, k, 1) AS own
  FROM ways, range(1, 6) AS r(k) WHERE length(way) = 5
), met AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS failing, fails = own AS only_it,
         earlier <> '' AND regexp_matches(fails, '[' || earlier || '-]') AS before
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT failing AND NOT before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing AND NOT before), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (failing AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_it), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (failing AND NOT before), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (failing AND NOT before), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SOURCE_DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{_TERM}') AS w FROM documents
), found AS (
  SELECT row, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS whole FROM found GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), sizes AS (
  SELECT g.lang, coalesce(v, 0) AS v, coalesce(whole_total, 0) AS whole_total
  FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN (SELECT lang, count(*) AS v, sum(whole) AS whole_total FROM kept GROUP BY lang) USING (lang)
), counts AS (
  SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(total, 0) AS total, v, whole_total
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN sizes USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p,
         1 + (1000000000::HUGEINT * (whole + 1)) // (whole_total + v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM dense a JOIN dense b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), listed AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM dense WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM listed
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES = {
    "op11_filter_orders": FILTER_ORDERS,
    "op13_source_divergence": SOURCE_DIVERGENCE,
    "op3_secret_scan": SECRET_SCAN,
    "op4_benchmark_leaks": BENCHMARK_LEAKS,
    "op6_near_groups": NEAR_GROUPS,
    "op10_url_verdicts": URL_VERDICTS,
}
