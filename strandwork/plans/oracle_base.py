"""Common table expressions of the derived fact tables for the checking SQL."""

HOMES = """
homes AS (SELECT s_suppkey, s_name AS module, r_name AS repo_key, n_nationkey, n_name, r_regionkey
          FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
scopes AS (SELECT 'r:' || r_regionkey AS scope_id, r_name AS repo_key, 'root' AS kind, r_name AS name,
                  CAST(NULL AS VARCHAR) AS parent FROM region
           UNION ALL SELECT 'n:' || n_nationkey, r_name, 'folder', n_name, 'r:' || r_regionkey
                     FROM nation JOIN region ON n_regionkey = r_regionkey
           UNION ALL SELECT 's:' || s_suppkey, repo_key, 'module', module, 'n:' || n_nationkey FROM homes),
decls AS (SELECT p_partkey AS ref, repo_key, 's:' || s_suppkey AS scope_id, 'n:' || n_nationkey AS folder_id,
                 'r:' || r_regionkey AS root_id, module,
                 p_brand || '.' || replace(p_name, ' ', '_') || '.' || (p_partkey % 7) AS name,
                 p_type AS kind, p_size % 2 = 0 AS local_public, p_partkey % 10 = 0 AS technical,
                 p_size >= 48 AS outcome,
                 CASE WHEN p_partkey % 10 = 0 AND p_partkey >= ns THEN p_partkey - ns END AS generated_from,
                 CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS statement_text,
                 CASE WHEN p_partkey % 13 = 0 THEN 'missing' ELSE 'present' END AS statement_status,
                 CASE WHEN p_size % 3 <> 0 THEN p_brand END AS proof_text,
                 CASE WHEN p_size % 3 = 0 THEN 'not_applicable' ELSE 'present' END AS proof_status,
                 CASE WHEN p_partkey % 17 <> 0 THEN 'src/' || n_name || '/' || module END AS path,
                 p_size * 10 + p_partkey % 10 AS start_line,
                 CASE WHEN p_partkey % 7 <> 0 THEN 1 + p_partkey % 3 END AS start_column,
                 p_size * 10 + p_partkey % 10 + p_partkey % 5 AS end_line,
                 CASE WHEN p_partkey % 7 <> 0 THEN 4 + p_partkey % 11 END AS end_column
          FROM part, (SELECT count(*) AS ns FROM supplier) JOIN homes ON s_suppkey = p_partkey % ns)"""

OCC = """
neighbours AS (SELECT a.l_partkey AS ap, b.l_partkey AS bp, a.l_suppkey AS asupp, a.l_linenumber AS ln,
                      b.l_returnflag AS rf, b.l_linestatus AS ls
               FROM lineitem a JOIN lineitem b
               ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber AND a.l_partkey <> b.l_partkey),
occ AS (SELECT least(ap, bp) AS provider, greatest(ap, bp) AS consumer,
               CASE WHEN rf = 'R' THEN 'proof' ELSE 'statement' END AS part,
               CASE WHEN ls = 'O' THEN 'lean_type' ELSE 'lean_value' END AS evidence_kind,
               CASE WHEN ln > 1 THEN 'Supplier#' || lpad(CAST(asupp AS VARCHAR), 9, '0') END AS provider_module
        FROM neighbours),
edges AS (SELECT DISTINCT provider, consumer FROM occ),
docc AS (SELECT ap AS provider, bp AS consumer FROM neighbours),
dedges AS (SELECT DISTINCT provider, consumer FROM docc)"""

LABELS = """
said AS (SELECT l.doc_id AS sample_id, d.lang AS project,
                CASE WHEN l.doc_id % 5 = 0 THEN 'boundary' ELSE 'random' END AS stratum,
                CASE WHEN l.doc_id % 17 = 0 THEN 'uncertain' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS first,
                CASE WHEN l.doc_id % 17 = 0 THEN 'uncertain' WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS second,
                d.n_chars, d.source
         FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

LINES = """
lines AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


def graph(body: str, *more: str, recursive: bool = False) -> str:
    """``body`` after the graph tables and any further table expressions."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join([HOMES, OCC, *more]) + "\n" + body


def tree(body: str, *more: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join([HOMES, *more]) + "\n" + body


SRC = ("path IS NULL, path, CASE WHEN path IS NULL THEN 0 ELSE start_line END, "
       "CASE WHEN path IS NULL THEN 0 ELSE coalesce(start_column, 0) END, CASE WHEN path IS NULL THEN 0 ELSE end_line END, "
       "CASE WHEN path IS NULL THEN 0 ELSE coalesce(end_column, 0) END, ref")
