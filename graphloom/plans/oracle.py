"""DuckDB oracle SQL: expected results computed from the tables, never by parsing Java.

The corpus CTEs evaluate the same per-method / per-file SQL templates the Spark
renderer uses (``graphloom.sources.corpus``), and every expectation about the
extracted structure comes from the closed-form rules of the rendering
(stereotype by s % 6, mapping by p % 8, calls from p, ...).
"""
from __future__ import annotations

from graphloom.sources import corpus as C

# ---------------------------------------------------------------------------
# corpus CTEs (DuckDB dialect; every CTE name is prefixed with c_)
CORPUS_CTES = f"""
c_k AS (SELECT (SELECT count(*) FROM supplier) AS n_sup, (SELECT count(*) FROM part) AS n_part),
c_sup AS (
  SELECT s_suppkey AS s, s_nationkey AS nk, s_name AS sname, (SELECT n_sup FROM c_k) AS n_sup FROM supplier
),
c_file AS (
  SELECT s, nk, n_sup, {C.PATH_SQL} AS path, {C.CLASS_NAME_SQL} AS class_name,
         {C.STEREOTYPE_SQL} AS stereotype, {C.FILE_HEADER_SQL} AS header
  FROM c_sup
),
c_part AS (
  SELECT p_partkey AS p, p_name AS pname, p_partkey % (SELECT n_sup FROM c_k) AS s,
         (SELECT n_sup FROM c_k) AS n_sup, (SELECT n_part FROM c_k) AS n_part
  FROM part
),
c_method AS (
  SELECT f.path, f.class_name, m.p, m.s,
         row_number() OVER (PARTITION BY m.s ORDER BY m.p) AS ord,
         {C.METHOD_NAME_SQL} AS name, {C.HTTP_METHOD_SQL} AS http_method, {C.ENDPOINT_SQL} AS endpoint,
         {C.METHOD_SOURCE_SQL} AS source_code, {C.METHOD_BLOCK_SQL} AS block,
         {C.CALL_A_SQL} AS call_a, {C.CALL_B_SQL} AS call_b
  FROM c_part m JOIN c_file f ON f.s = m.s
),
c_content AS (
  SELECT f.path, f.class_name,
         f.header || coalesce((SELECT string_agg(m.block, '' ORDER BY m.p) FROM c_method m WHERE m.s = f.s), '')
           || '}}' || chr(10) AS content
  FROM c_file f
),
c_dep AS (
  SELECT path, class_name, 1 AS ord, {C.DEP1_SQL} AS dep FROM c_file
  UNION ALL SELECT path, class_name, 2, {C.DEP2_SQL} FROM c_file
  UNION ALL SELECT path, class_name, 3, {C.DEP3_SQL} FROM c_file WHERE s % 7 = 0
),
c_call AS (
  SELECT path, p, name AS src_name, class_name AS src_class, 1 AS call_ord, call_a AS callee FROM c_method
  UNION ALL SELECT path, p, name, class_name, 2, call_b FROM c_method
  UNION ALL SELECT path, p, name, class_name, 3, 'log' FROM c_method
),
-- method nodes: last definition (max position) wins
c_def1 AS (SELECT name, class_name, min(path) AS dpath, min(p) AS dp FROM c_method GROUP BY name, class_name),
c_name_def1 AS (SELECT name, min((dpath, dp)) AS d FROM c_def1 GROUP BY name),
c_name_call1 AS (SELECT callee AS name, min((path, p)) AS c FROM c_call GROUP BY callee),
c_mstub AS (
  SELECT c.name FROM c_name_call1 c LEFT JOIN c_name_def1 d ON d.name = c.name
  WHERE d.d IS NULL OR c.c < d.d
),
c_mnode AS (
  SELECT name, class_name, http_method, endpoint, source_code
  FROM (SELECT *, row_number() OVER (PARTITION BY name, class_name ORDER BY path DESC, p DESC) AS rn FROM c_method)
  WHERE rn = 1
  UNION ALL SELECT name, NULL, NULL, NULL, NULL FROM c_mstub
),
c_calls_first AS (
  SELECT DISTINCT c.src_name, c.src_class, c.callee AS dst_name, d.class_name AS dst_class
  FROM c_call c JOIN c_def1 d ON d.name = c.callee AND (d.dpath, d.dp) <= (c.path, c.p)
  UNION
  SELECT DISTINCT c.src_name, c.src_class, c.callee, NULL FROM c_call c JOIN c_mstub s ON s.name = c.callee
),
c_calls_settled AS (
  SELECT DISTINCT c.src_name, c.src_class, c.callee AS dst_name, n.class_name AS dst_class
  FROM c_call c JOIN c_mnode n ON n.name = c.callee
),
-- class nodes: one per file; deps bind by name
c_cname_ref1 AS (SELECT dep AS name, min(path) AS r FROM c_dep GROUP BY dep),
c_cstub AS (
  SELECT r.name FROM c_cname_ref1 r LEFT JOIN (SELECT class_name AS name, min(path) AS d FROM c_file GROUP BY 1) d
    ON d.name = r.name
  WHERE d.d IS NULL OR r.r < d.d
),
c_cnode AS (
  SELECT class_name AS name, path AS file_path, stereotype FROM c_file
  UNION ALL SELECT name, NULL, NULL FROM c_cstub
),
c_dep_first AS (
  SELECT DISTINCT d.class_name AS src_name, d.path AS src_file_path, d.dep AS dst_name, f.path AS dst_file_path
  FROM c_dep d JOIN c_file f ON f.class_name = d.dep AND f.path <= d.path
  UNION
  SELECT DISTINCT d.class_name, d.path, d.dep, NULL FROM c_dep d JOIN c_cstub s ON s.name = d.dep
),
c_dep_settled AS (
  SELECT DISTINCT d.class_name AS src_name, d.path AS src_file_path, d.dep AS dst_name, n.file_path AS dst_file_path
  FROM c_dep d JOIN c_cnode n ON n.name = d.dep
)
"""


def with_corpus(body: str) -> str:
    return "WITH " + CORPUS_CTES.strip() + ",\n" + body


def corpus_select(select: str) -> str:
    """A plain SELECT over the corpus CTEs."""
    return "WITH " + CORPUS_CTES.strip() + "\n" + select


def trails_sql(edges_cte: str) -> str:
    """CTEs c_edge (edges with the destination endpoint) and c_trail (seed, hop, callee, class, endpoint)."""
    return f"""
c_edge AS (
  SELECT e.src_name, e.src_class, e.dst_name, e.dst_class, n.endpoint AS dst_endpoint
  FROM {edges_cte} e LEFT JOIN c_mnode n ON n.name = e.dst_name AND n.class_name IS NOT DISTINCT FROM e.dst_class
),
c_trail AS (
  SELECT e1.src_name AS seed, 1 AS hop, e1.dst_name AS callee, e1.dst_class AS class, e1.dst_endpoint AS endpoint
  FROM c_edge e1
  UNION ALL
  SELECT e1.src_name, 2, e2.dst_name, e2.dst_class, e2.dst_endpoint
  FROM c_edge e1 JOIN c_edge e2
    ON e2.src_name = e1.dst_name AND e2.src_class IS NOT DISTINCT FROM e1.dst_class
  WHERE NOT (e2.src_name = e1.src_name AND e2.src_class IS NOT DISTINCT FROM e1.src_class
             AND e2.dst_name = e1.dst_name AND e2.dst_class IS NOT DISTINCT FROM e1.dst_class)
  UNION ALL
  SELECT e1.src_name, 3, e3.dst_name, e3.dst_class, e3.dst_endpoint
  FROM c_edge e1 JOIN c_edge e2
    ON e2.src_name = e1.dst_name AND e2.src_class IS NOT DISTINCT FROM e1.dst_class
  JOIN c_edge e3
    ON e3.src_name = e2.dst_name AND e3.src_class IS NOT DISTINCT FROM e2.dst_class
  WHERE NOT (e2.src_name = e1.src_name AND e2.src_class IS NOT DISTINCT FROM e1.src_class
             AND e2.dst_name = e1.dst_name AND e2.dst_class IS NOT DISTINCT FROM e1.dst_class)
    AND NOT (e3.src_name = e1.src_name AND e3.src_class IS NOT DISTINCT FROM e1.src_class
             AND e3.dst_name = e1.dst_name AND e3.dst_class IS NOT DISTINCT FROM e1.dst_class)
    AND NOT (e3.src_name = e2.src_name AND e3.src_class IS NOT DISTINCT FROM e2.src_class
             AND e3.dst_name = e2.dst_name AND e3.dst_class IS NOT DISTINCT FROM e2.dst_class)
)"""


ORACLES: dict[str, str] = {}


def _corpus(key: str, select: str, extra_ctes: str = "") -> None:
    if extra_ctes:
        ORACLES[key] = with_corpus(extra_ctes.strip() + "\n" + select)
    else:
        ORACLES[key] = corpus_select(select)


# ---------------------------------------------------------------- extraction
_corpus("token_table", """
SELECT f.path,
  CAST(1 + CASE WHEN f.s % 6 IN (0, 1) THEN 1 ELSE 0 END
       + coalesce(sum(CASE WHEN m.p % 8 IN (3, 7) THEN 6 ELSE 7 END), 0) AS BIGINT) AS n_lparen,
  CAST(1 + coalesce(sum(CASE WHEN m.p % 8 = 5 THEN 3 ELSE 2 END), 0) AS BIGINT) AS n_lbrace,
  CAST(CASE WHEN count(m.p) > 0 THEN 3 ELSE 1 END AS BIGINT) AS max_depth
FROM c_file f LEFT JOIN c_method m ON m.s = f.s
GROUP BY f.path, f.s""")
_corpus("class_names", "SELECT path, class_name FROM c_file")
_corpus("stereotypes", "SELECT path, stereotype FROM c_file")
_corpus("autowired_deps", "SELECT path, CAST(ord AS BIGINT) AS ord, dep FROM c_dep")
_corpus("methods", "SELECT path, class_name, ord, name FROM c_method")
_corpus("http_mappings", "SELECT path, ord, name, http_method FROM c_method")
_corpus("endpoints", "SELECT path, ord, name, endpoint FROM c_method")
_corpus("call_names", """
SELECT m.path, m.ord, CAST(c.call_ord AS BIGINT) AS call_ord, c.callee
FROM c_call c JOIN c_method m ON m.path = c.path AND m.p = c.p""")
_corpus("method_source", "SELECT path, ord, source_code FROM c_method")
_corpus("parse_errors", "SELECT path, 'No such file or directory' AS error FROM c_file WHERE s % 7 = 3")
_corpus("parsed_files", """
SELECT f.path, f.class_name, f.stereotype,
  CAST(2 + CASE WHEN f.s % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_deps,
  CAST(count(m.p) AS BIGINT) AS n_methods, CAST(NULL AS VARCHAR) AS error
FROM c_file f LEFT JOIN c_method m ON m.s = f.s
GROUP BY f.path, f.class_name, f.stereotype, f.s""")
_corpus("ingest_summary", """
SELECT count(*) AS total_files, count_if(s % 7 <> 3)::BIGINT AS success_files, count_if(s % 7 = 3)::BIGINT AS failed_files,
  count_if(s % 7 <> 3)::BIGINT AS total_classes, (SELECT count(*) FROM c_method WHERE s % 7 <> 3) AS total_methods,
  count_if(s % 7 = 3)::BIGINT AS n_errors FROM c_file""")

# --------------------------------------------------------------------- graph
_corpus("file_nodes", "SELECT path, class_name || '.java' AS name FROM c_file")
_corpus("class_nodes", "SELECT name, file_path, stereotype FROM c_cnode")
_corpus("method_nodes", "SELECT name, class_name, http_method, endpoint, source_code FROM c_mnode")
_corpus("contains_edges", "SELECT path AS file_path, class_name FROM c_file")
_corpus("defines_edges", "SELECT DISTINCT class_name, path AS file_path, name AS method_name FROM c_method")
_corpus("calls_edges", "SELECT src_name, src_class, dst_name, dst_class FROM c_calls_first")
_corpus("calls_edges_settled", "SELECT src_name, src_class, dst_name, dst_class FROM c_calls_settled")
_corpus("depends_on_edges", "SELECT src_name, src_file_path, dst_name, dst_file_path FROM c_dep_first")
_corpus("depends_on_settled", "SELECT src_name, src_file_path, dst_name, dst_file_path FROM c_dep_settled")
_corpus("build_graph", """
SELECT 'file_nodes' AS "table", count(*) AS rows FROM c_file
UNION ALL SELECT 'class_nodes', count(*) FROM c_cnode
UNION ALL SELECT 'method_nodes', count(*) FROM c_mnode
UNION ALL SELECT 'contains', count(*) FROM c_file
UNION ALL SELECT 'defines', count(*) FROM (SELECT DISTINCT class_name, path, name FROM c_method)
UNION ALL SELECT 'calls', count(*) FROM c_calls_first
UNION ALL SELECT 'depends_on', count(*) FROM c_dep_first""")

# ----------------------------------------------------------------- traversal
_corpus("call_graph", "SELECT t.seed, t.callee, t.class, t.endpoint FROM c_trail t",
        trails_sql("c_calls_settled").strip())
_corpus("call_graph_all", "SELECT t.seed, CAST(t.hop AS BIGINT) AS hop, t.callee, t.class, t.endpoint FROM c_trail t",
        trails_sql("c_calls_first").strip())
_corpus("call_reach", """
SELECT t.seed, t.callee, t.class, count(*) AS paths FROM c_trail t GROUP BY t.seed, t.callee, t.class""",
        trails_sql("c_calls_settled").strip())
_corpus("find_by_endpoint", """
SELECT r.request_id, r.route, n.name AS method, n.class_name AS class, n.http_method, n.source_code
FROM (SELECT CAST(n_nationkey * 2 AS BIGINT) AS request_id, '/r' || CAST(n_nationkey AS VARCHAR) AS route FROM nation
      UNION ALL
      SELECT CAST(n_nationkey * 2 + 1 AS BIGINT), '/nation' || CAST(n_nationkey AS VARCHAR) FROM nation) r
JOIN c_mnode n ON n.endpoint = r.route""")


# -------------------------------------------------------------------- search
from graphloom.functions import lexicon as LX  # noqa: E402

PAT = LX.ANALYZER_STANDARD.replace("'", "''")
STOP = ", ".join("'" + w + "'" for w in LX.STOP_WORDS)


def index_ctes(p: str, docs: str, keys: list[str]) -> str:
    """BM25 index CTEs named {p}_tok/_dl/_tf/_df/_fs over ``docs`` (keys..., field, txt)."""
    k = ", ".join(keys)
    return f"""
{p}_arr AS (SELECT {k}, field, regexp_extract_all(lower(txt), '{PAT}') AS t FROM ({docs})),
{p}_tok AS (SELECT {k}, field, unnest(t) AS term, unnest(range(len(t))) AS pos FROM {p}_arr),
{p}_dl AS (SELECT {k}, field, count(*) AS dl FROM {p}_tok GROUP BY {k}, field),
{p}_tf AS (SELECT {k}, field, term, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM {p}_tok GROUP BY {k}, field, term),
{p}_df AS (SELECT field, term, count(*) AS df, sum(tf) AS cf FROM {p}_tf GROUP BY field, term),
{p}_fs AS (SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM {p}_dl GROUP BY field)"""


def query_ctes(q: str, raw: str) -> str:
    """{q}_qt (qkey, qpos, tpos, term) from ``raw`` (qkey, words LIST)."""
    return f"""
{q}_w AS (SELECT qkey, unnest(words) AS w, unnest(range(len(words))) AS qpos FROM ({raw})),
{q}_a AS (SELECT qkey, qpos, regexp_extract_all(lower(w), '{PAT}') AS t FROM {q}_w),
{q}_qt AS (SELECT qkey, qpos, unnest(range(len(t))) AS tpos, unnest(t) AS term FROM {q}_a)"""


def score_ctes(s: str, p: str, q: str, keys: list[str], fields: str = "") -> str:
    """{s}_sc (qkey, keys..., score, matched) BM25 of query terms {q}_qt over index {p}."""
    k = ", ".join(f"t.{c}" for c in keys)
    kk = ", ".join(keys)
    fld = f"AND d.field IN ({fields})" if fields else ""
    return f"""
{s}_w AS (
  SELECT q.qkey, q.term, d.field,
         ln(1 + (f.n_docs - d.df + CAST(0.5 AS DOUBLE)) / (d.df + CAST(0.5 AS DOUBLE))) AS idf, f.avgdl
  FROM {q}_qt q JOIN {p}_df d ON d.term = q.term {fld} JOIN {p}_fs f ON f.field = d.field),
{s}_h AS (
  SELECT w.qkey, w.term, {k},
         w.idf * (t.tf / (t.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * l.dl / w.avgdl))) AS s
  FROM {s}_w w JOIN {p}_tf t ON t.field = w.field AND t.term = w.term
  JOIN {p}_dl l ON l.field = t.field AND {" AND ".join(f"l.{c} IS NOT DISTINCT FROM t.{c}" for c in keys)}),
{s}_sc AS (SELECT qkey, {kk}, sum(s) AS score, count(DISTINCT term) AS matched FROM {s}_h GROUP BY qkey, {kk})"""


def top_k(src: str, keys: list[str], k: int = 5) -> str:
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in keys)
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY round(score, 9) DESC, {order}) AS rank
   FROM {src}) WHERE rank <= {k})"""


DOCS = "SELECT doc_id, 'text' AS field, text AS txt FROM documents"

KEY_TERMS_CTES = f"""
kt_src AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS question_id, text AS question FROM conversations WHERE role = 'user'),
kt_w AS (
  SELECT question_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT question_id, regexp_split_to_array(replace(replace(lower(question), '?', ''), ',', ''), '\\s+') AS ws FROM kt_src)),
kt_f AS (SELECT question_id, w, min(i) AS i FROM kt_w WHERE length(w) > 2 AND w NOT IN ({STOP}) GROUP BY question_id, w),
kt AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY i) AS BIGINT) AS term_pos, w AS term FROM kt_f
       QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY i) <= 3)"""


def _plain(key: str, ctes: str, select: str) -> None:
    ORACLES[key] = "WITH " + ctes.strip().rstrip(",") + "\n" + select


_plain("analyze_text", "x AS (SELECT doc_id, regexp_extract_all(lower(text), '" + PAT + "') AS t FROM documents)",
       "SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM x")
_plain("postings", index_ctes("d", DOCS, ["doc_id"]),
       "SELECT doc_id, term, tf, positions FROM d_tf")
_plain("term_stats", index_ctes("d", DOCS, ["doc_id"]),
       "SELECT x.term, x.df, CAST(x.cf AS BIGINT) AS cf, f.n_docs, round(f.avgdl, 6) AS avgdl FROM d_df x JOIN d_fs f USING (field)")

_conv_q = """
kq AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qkey, regexp_split_to_array(text, '\\s+') AS words
       FROM conversations WHERE role = 'user'),
dw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '""" + PAT + """')) AS word FROM conversations WHERE role = 'user')"""

_plain("search_any", _conv_q + "," + index_ctes("d", DOCS, ["doc_id"]) + "," + query_ctes("q", "SELECT * FROM kq")
       + "," + score_ctes("s", "d", "q", ["doc_id"]),
       f"SELECT qkey AS query_id, rank, doc_id, round(score, 6) AS score FROM {top_k('s_sc', ['doc_id'])}")

_bool_all = (_conv_q + "," + index_ctes("d", DOCS, ["doc_id"]) + "," + query_ctes("q", "SELECT * FROM kq")
             + "," + score_ctes("s", "d", "q", ["doc_id"])
             + ",\nneed AS (SELECT qkey, count(DISTINCT term) AS n FROM q_qt GROUP BY qkey),"
             + "\nall_sc AS (SELECT s.* FROM s_sc s JOIN need USING (qkey) WHERE s.matched = need.n),"
             + "\nnq AS (SELECT qkey, list_slice(words, 1, 1) AS must, list_slice(words, 2, len(words)) AS must_not FROM kq WHERE len(words) >= 2),"
             + query_ctes("m", "SELECT qkey, must AS words FROM nq") + ","
             + query_ctes("x", "SELECT qkey, must_not AS words FROM nq") + ","
             + score_ctes("ms", "d", "m", ["doc_id"])
             + ",\nexcl AS (SELECT DISTINCT x.qkey, t.doc_id FROM x_qt x JOIN d_tf t ON t.term = x.term),"
             + "\nnot_sc AS (SELECT m.* FROM ms_sc m WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.qkey = m.qkey AND e.doc_id = m.doc_id))")
_plain("search_bool", _bool_all,
       f"""SELECT qkey AS query_id, 'all' AS mode, rank, doc_id, round(score, 6) AS score FROM {top_k('all_sc', ['doc_id'])}
UNION ALL
SELECT qkey AS query_id, 'not' AS mode, rank, doc_id, round(score, 6) AS score FROM {top_k('not_sc', ['doc_id'])}""")

_phrase = (index_ctes("d", DOCS, ["doc_id"]) + ","
           + query_ctes("q", "SELECT item_id AS qkey, regexp_split_to_array(text, '\\s+') AS words FROM benchmark")
           + f""",
q_off AS (SELECT qkey, term, CAST(row_number() OVER (PARTITION BY qkey ORDER BY qpos, tpos) AS BIGINT) - 1 AS off FROM q_qt),
q_n AS (SELECT qkey, count(*) AS n FROM q_off GROUP BY qkey),
starts AS (SELECT o.qkey, t.field, t.doc_id, t.pos - o.off AS st, o.off FROM q_off o JOIN d_tok t ON t.term = o.term),
m AS (SELECT s.qkey, s.field, s.doc_id, s.st FROM starts s GROUP BY s.qkey, s.field, s.doc_id, s.st
      HAVING count(DISTINCT s.off) = (SELECT n FROM q_n WHERE q_n.qkey = s.qkey)),
pf AS (SELECT qkey, field, doc_id, count(*) AS pf FROM m GROUP BY qkey, field, doc_id),
isum AS (SELECT o.qkey, d.field, sum(ln(1 + (f.n_docs - d.df + CAST(0.5 AS DOUBLE)) / (d.df + CAST(0.5 AS DOUBLE)))) AS idf, any_value(f.avgdl) AS avgdl
         FROM q_off o JOIN d_df d ON d.term = o.term JOIN d_fs f ON f.field = d.field GROUP BY o.qkey, d.field),
ph_sc AS (SELECT p.qkey, p.doc_id, sum(i.idf * (p.pf / (p.pf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * l.dl / i.avgdl)))) AS score
          FROM pf p JOIN isum i ON i.qkey = p.qkey AND i.field = p.field JOIN d_dl l ON l.field = p.field AND l.doc_id = p.doc_id
          GROUP BY p.qkey, p.doc_id)""")
_plain("search_phrase", _phrase,
       f"SELECT CAST(qkey AS BIGINT) AS query_id, rank, doc_id, round(score, 6) AS score FROM {top_k('ph_sc', ['doc_id'])}")

_prefix = (_conv_q + "," + index_ctes("d", DOCS, ["doc_id"]) + """,
pre_t AS (SELECT w.word AS qkey, d.term FROM dw w JOIN d_df d ON starts_with(d.term, w.word)),
pre_sc AS (SELECT DISTINCT p.qkey, t.doc_id, CAST(1.0 AS DOUBLE) AS score FROM pre_t p JOIN d_tf t ON t.term = p.term)""")
_plain("search_prefix", _prefix,
       f"SELECT qkey AS query_id, rank, doc_id, score FROM {top_k('pre_sc', ['doc_id'])}")

# DuckDB's levenshtein counts bytes: characters beyond ASCII become spare ASCII ones, which no lower-case term holds
_fuzzy = (_conv_q + "," + index_ctes("d", DOCS, ["doc_id"]) + """,
beyond AS (SELECT DISTINCT c FROM (SELECT unnest(string_split(term, '')) AS c FROM d_df UNION ALL SELECT unnest(string_split(word, '')) FROM dw) WHERE unicode(c) > 127),
spare AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS f, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ!"#$%&()*+,-/:;<=>?@[]^`{|}~', 1, count(*)::INT) AS t FROM beyond),
fz_w AS (SELECT word, translate(word, f, t) AS e FROM dw, spare),
fz_d AS (SELECT term, translate(term, f, t) AS e FROM d_df, spare),
f_qt AS (SELECT w.word AS qkey, d.term FROM fz_w w JOIN fz_d d ON abs(strlen(w.e) - strlen(d.e)) <= 2 AND levenshtein(w.e, d.e) <= 2)"""
          + "," + score_ctes("fs", "d", "f", ["doc_id"]))
_plain("search_fuzzy", _fuzzy,
       f"SELECT qkey AS query_id, rank, doc_id, round(score, 6) AS score FROM {top_k('fs_sc', ['doc_id'])}")

# code index over the corpus method nodes
CODE_DOCS = ("SELECT name, class_name, 'source_code' AS field, source_code AS txt FROM c_mnode WHERE source_code IS NOT NULL "
             "UNION ALL SELECT name, class_name, 'name' AS field, name AS txt FROM c_mnode")
_code_idx = index_ctes("ci", CODE_DOCS, ["name", "class_name"])

ORACLES["search_code"] = with_corpus(
    _code_idx.strip() + "," + query_ctes("q", "SELECT p_partkey AS qkey, string_split(p_name, ' ') AS words FROM part")
    + "," + score_ctes("s", "ci", "q", ["name", "class_name"]) + f"""
SELECT CAST(t.qkey AS BIGINT) AS query_id, t.rank, t.name AS method, t.class_name AS class, n.http_method, n.endpoint,
       round(t.score, 6) AS score
FROM {top_k('s_sc', ['name', 'class_name'])} t
LEFT JOIN c_mnode n ON n.name = t.name AND n.class_name IS NOT DISTINCT FROM t.class_name""")

ORACLES["search_field"] = with_corpus(
    _code_idx.strip() + "," + query_ctes("q", "SELECT p_partkey AS qkey, ['op' || CAST(p_size AS VARCHAR)] AS words FROM part")
    + "," + score_ctes("s", "ci", "q", ["name", "class_name"], fields="'name'") + f"""
SELECT CAST(qkey AS BIGINT) AS query_id, rank, name AS method, class_name AS class, round(score, 6) AS score
FROM {top_k('s_sc', ['name', 'class_name'])}""")

# ------------------------------------------------------------------- context
ORACLES["key_terms"] = "WITH " + KEY_TERMS_CTES.strip() + "\nSELECT question_id, term_pos, term FROM kt"

_Q_ALL = KEY_TERMS_CTES.replace(
    "kt_src AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS question_id, text AS question FROM conversations WHERE role = 'user')",
    "kt_src AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS question_id, text AS question FROM conversations WHERE role = 'user'\n"
    "  UNION ALL SELECT 'part:' || CAST(min(p_partkey) AS VARCHAR), 'Where is the ' || p_name || ' handled?' FROM part GROUP BY p_name)",
)
_hits_ctes = (
    _Q_ALL.strip() + "," + _code_idx + ","
    + query_ctes("q", "SELECT DISTINCT term AS qkey, [term] AS words FROM kt")
    + "," + score_ctes("s", "ci", "q", ["name", "class_name"]) + f""",
top_t AS {top_k('s_sc', ['name', 'class_name'])},
hits AS (
  SELECT k.question_id, k.term_pos, k.term, t.rank, t.name AS method, t.class_name AS class, n.http_method, n.endpoint,
         round(t.score, 6) AS score, t.score AS score_raw
  FROM kt k JOIN top_t t ON t.qkey = k.term
  LEFT JOIN c_mnode n ON n.name = t.name AND n.class_name IS NOT DISTINCT FROM t.class_name),
firsts AS (SELECT * FROM hits WHERE method IS NOT NULL AND method <> ''
           QUALIFY row_number() OVER (PARTITION BY question_id, method ORDER BY term_pos, rank) = 1),
qm AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY term_pos, rank) AS BIGINT) AS ord FROM firsts
       QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY term_pos, rank) <= 15),
""" + trails_sql("c_calls_settled").strip() + """,
qc AS (SELECT m.question_id, m.ord, m.method, CAST(t.hop AS BIGINT) AS hop, t.callee, t.class, t.endpoint
       FROM qm m JOIN c_trail t ON t.seed = m.method WHERE m.ord <= 5)"""
)
ORACLES["question_hits"] = with_corpus(
    _hits_ctes + "\nSELECT question_id, term_pos, term, rank, method, class, http_method, endpoint, score FROM hits")
ORACLES["question_methods"] = with_corpus(
    _hits_ctes + "\nSELECT question_id, ord, method, class, http_method, endpoint, score FROM qm")
ORACLES["question_chains"] = with_corpus(
    _hits_ctes + "\nSELECT question_id, ord, method, hop, callee, class, endpoint FROM qc")


def _repr_list(col: str) -> str:
    one = ("CASE WHEN contains(x, '''') AND NOT contains(x, '\"') THEN '\"' || replace(x, '\\', '\\\\') || '\"' "
           "ELSE '''' || replace(replace(x, '\\', '\\\\'), '''', '\\''') || '''' END")
    return f"('[' || array_to_string(list_transform({col}, lambda x: {one}), ', ') || ']')"


_RULE = "=" * 60
_ctx = _hits_ctes + f""",
lines AS (
  SELECT question_id, ord, hop,
         '    → ' || coalesce(nullif(callee, ''), '?') || '  [' || coalesce(nullif(class, ''), '?') || ']'
         || CASE WHEN coalesce(endpoint, '') <> '' THEN '  →  ' || endpoint ELSE '' END AS line
  FROM qc),
s2 AS (
  SELECT m.question_id, m.ord,
         chr(10) || chr(10) || m.method || ' calls:' || chr(10)
         || coalesce((SELECT string_agg(l.line, chr(10) ORDER BY l.hop, l.line) FROM lines l
                      WHERE l.question_id = m.question_id AND l.ord = m.ord), '{LX.MSG_NO_CALLS}') AS b
  FROM qm m WHERE m.ord <= 5),
s1 AS (
  SELECT question_id, ord,
         chr(10) || chr(10) || '[' || CAST(ord AS VARCHAR) || '] ' || method
         || chr(10) || '    Class    : ' || coalesce(nullif(class, ''), 'unknown')
         || CASE WHEN coalesce(http_method, '') <> '' AND coalesce(endpoint, '') <> ''
                 THEN chr(10) || '    Endpoint : ' || http_method || ' ' || endpoint
                 WHEN coalesce(endpoint, '') <> '' THEN chr(10) || '    Endpoint : ' || endpoint ELSE '' END
         || chr(10) || '    Score    : ' || printf('%.3f', coalesce(score_raw, 0.0)) AS b
  FROM qm),
qterms AS (SELECT s.question_id, s.question, coalesce((SELECT list(term ORDER BY term_pos) FROM kt WHERE kt.question_id = s.question_id), []::VARCHAR[]) AS terms
           FROM kt_src s),
ctx AS (
  SELECT q.question_id,
         CASE WHEN len(q.terms) = 0 THEN 'no_terms'
              WHEN NOT EXISTS (SELECT 1 FROM qm WHERE qm.question_id = q.question_id) THEN 'no_hits' ELSE 'ok' END AS status,
         {_repr_list('q.terms')} AS terms_repr, q.question
  FROM qterms q),
out AS (
  SELECT c.question_id, c.status,
         CASE c.status WHEN 'no_terms' THEN '{LX.MSG_NO_TERMS.replace("'", "''")}'
                       WHEN 'no_hits' THEN '{LX.MSG_NO_HITS_PREFIX}' || c.terms_repr || '{LX.MSG_NO_HITS_SUFFIX}' END AS message,
         'QUESTION: ' || c.question || chr(10) || 'KEY TERMS EXTRACTED: ' || c.terms_repr || chr(10) || '{_RULE}'
         || chr(10) || chr(10) || '── SECTION 1: MATCHING METHODS ──'
         || coalesce((SELECT string_agg(b, '' ORDER BY ord) FROM s1 WHERE s1.question_id = c.question_id), '')
         || chr(10) || chr(10) || '── SECTION 2: CALL CHAINS ──'
         || coalesce((SELECT string_agg(b, '' ORDER BY ord) FROM s2 WHERE s2.question_id = c.question_id), '')
         || chr(10) || chr(10) || '{_RULE}' || chr(10) || '{LX.MSG_NOTE}' AS body
  FROM ctx c)"""
ORACLES["question_context"] = with_corpus(_ctx + "\nSELECT question_id, status, coalesce(message, body) AS context FROM out")
ORACLES["question_status"] = with_corpus(_ctx + "\nSELECT question_id, status, message FROM out")


# ------------------------------------------------------------ sources / sinks
ORACLES["decode_text"] = (
    "SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(65533) || chr(10) AS text "
    "FROM documents")

_URL = r"^[a-z]+://[^/]+(/[^?#]*)"
ORACLES["scan_files"] = """
WITH t AS (SELECT doc_id % 6 AS kind, CAST(doc_id AS VARCHAR) AS i, doc_id % 10 AS d, text FROM documents WHERE text IS NOT NULL),
f AS (SELECT CASE kind WHEN 0 THEN '/a/' WHEN 1 THEN '/a/' WHEN 2 THEN '/.hidden/b/' WHEN 3 THEN '/_build/' ELSE '/a/Folder' || d || '.java/' END AS folder,
    CASE kind WHEN 0 THEN 'Doc' WHEN 1 THEN '_Doc' WHEN 2 THEN '.Doc' WHEN 3 THEN 'Empty' ELSE 'Doc' END || i || '.java' AS name,
    CASE WHEN kind = 3 THEN '' ELSE text END AS text FROM t WHERE kind <> 5)
SELECT folder || name AS path, name, CAST(strlen(text) AS BIGINT) AS length, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS content,
  CAST(NULL AS VARCHAR) AS error FROM f"""
ORACLES["path_parts"] = f"""
WITH x AS (SELECT page_id, regexp_extract(url, '{_URL}', 1) AS path FROM pages),
y AS (SELECT page_id, path, string_split(path, '/')[-1] AS name FROM x)
SELECT page_id, path, name, regexp_replace(name, '^(.+)\\.[^.]+$', '\\1') AS stem FROM y"""

ORACLES["read_files"] = corpus_select("""
, r AS (
  SELECT CAST(s_suppkey * 2 AS BIGINT) AS request_id,
         '/repo/src/pkg' || CAST(s_nationkey AS VARCHAR) || '/Supplier' || CAST(s_suppkey AS VARCHAR) || '.java' AS file_path
  FROM supplier
  UNION ALL
  SELECT CAST(s_suppkey * 2 + 1 AS BIGINT),
         '/repo/src/pkg' || CAST((s_nationkey + 1) % 25 AS VARCHAR) || '/Supplier' || CAST(s_suppkey AS VARCHAR) || '.java'
  FROM supplier)
SELECT r.request_id, r.file_path, CASE WHEN c.path IS NULL THEN 'not_found' ELSE 'ok' END AS status,
       coalesce(c.content, 'ERROR: File not found: ' || r.file_path) AS content
FROM r LEFT JOIN c_content c ON c.path = r.file_path""".replace("\n, r AS", ",\nr AS", 1)).replace(
    "WITH " + CORPUS_CTES.strip() + "\n,", "WITH " + CORPUS_CTES.strip() + ",")

_ROOTS = ["/repo/src", "/repo/en", "/repo/de"]
_INSIDE = " OR ".join(f"starts_with(target, '{r}')" for r in _ROOTS)
_BLOCKED = ", ".join(f"'{s}'" for s in LX.BLOCKED_SUFFIXES)
POLICY_CTES = f"""
w_src AS (
  SELECT CAST(e.event_id AS BIGINT) AS seq, e.user_id, e.event_type, e.props,
         regexp_extract(p.url, '{_URL}', 1) AS url_path, s.s_nationkey
  FROM events e LEFT JOIN pages p ON p.page_id = e.user_id LEFT JOIN supplier s ON s.s_suppkey = e.user_id),
w AS (
  SELECT seq,
    CASE event_type
      WHEN 'view' THEN coalesce('/repo/src/pkg' || CAST(s_nationkey AS VARCHAR) || '/Supplier' || CAST(user_id AS VARCHAR) || '.java',
                                '/repo/src/new/User' || CAST(user_id AS VARCHAR) || '.java')
      WHEN 'signup' THEN '/repo' || coalesce(url_path, '/misc') || '/.env'
      WHEN 'click' THEN '/repo' || coalesce(url_path, '/misc') || '/../.git/config'
      WHEN 'error' THEN '/repo/./' || coalesce(url_path, '/misc') || '/notes.txt'
      ELSE 'logs/' || coalesce(url_path, '/misc') || '/key.PEM' END AS file_path,
    CASE WHEN event_type = 'view'
      THEN 'public class Supplier' || CAST(user_id AS VARCHAR) || ' {{' || chr(10) || '    public void ping() {{' || chr(10)
           || '        log(1);' || chr(10) || '    }}' || chr(10) || '}}' || chr(10)
      ELSE props END AS content
  FROM w_src),
w_n AS (
  SELECT seq, file_path, content,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      CASE WHEN starts_with(file_path, '/') THEN file_path ELSE '/' || file_path END,
      '/+', '/', 'g'), '/\\./', '/', 'g'), '/\\./', '/', 'g'), '/\\.$', ''), '/[^/]+/\\.\\./', '/', 'g'), '/[^/]+/\\.\\.$', '') AS t0
  FROM w),
w_t AS (SELECT seq, file_path, content, CASE WHEN t0 = '' THEN '/' ELSE t0 END AS target FROM w_n),
w_f AS (
  SELECT *, string_split(target, '/')[-1] AS name,
         lower(regexp_extract(string_split(target, '/')[-1], '^.+(\\.[^.]+)$', 1)) AS suffix,
         ({_INSIDE}) AS inside
  FROM w_t),
pol AS (
  SELECT seq, file_path, target, content, name, suffix,
    CASE WHEN NOT inside THEN 'Path ' || target || ' is outside allowed roots.'
         WHEN suffix IN ({_BLOCKED}) OR name = '.env' THEN 'Writing to ' || name || ' is blocked.'
         WHEN list_contains(string_split(target, '/'), '.git') THEN 'Writing inside .git is blocked.' END AS reason
  FROM w_f),
res AS (
  SELECT seq, file_path, target, content, CASE WHEN reason IS NULL THEN 'success' ELSE 'error' END AS status, reason,
    CASE WHEN reason IS NULL THEN CAST(strlen(content) AS BIGINT) END AS bytes_written,
    CASE WHEN reason IS NULL AND suffix = '.java' THEN 'Graph is stale for ' || name || '{LX.MSG_STALE}' END AS warning
  FROM pol)"""

ORACLES["normalize_path"] = "WITH " + POLICY_CTES.strip() + "\nSELECT seq, file_path, target FROM res"
ORACLES["write_policy"] = "WITH " + POLICY_CTES.strip() + "\nSELECT seq, target, status, reason FROM res"
ORACLES["write_result"] = ("WITH " + POLICY_CTES.strip()
                           + "\nSELECT seq, status, CASE WHEN status = 'success' THEN target END AS path, bytes_written, warning, reason,"
                           + "\n  CAST(CASE WHEN status = 'error' THEN json_object('status', status, 'reason', reason)"
                           + "\n       WHEN warning IS NULL THEN json_object('status', status, 'path', target, 'bytes_written', bytes_written)"
                           + "\n       ELSE json_object('status', status, 'path', target, 'bytes_written', bytes_written, 'warning', warning) END"
                           + " AS VARCHAR) AS result FROM res")
ORACLES["apply_writes"] = with_corpus(POLICY_CTES.strip() + """,
acc AS (SELECT target AS path, content FROM res WHERE status = 'success'
        QUALIFY row_number() OVER (PARTITION BY target ORDER BY seq DESC) = 1)
SELECT c.path, 'original' AS origin, c.content FROM c_content c WHERE c.path NOT IN (SELECT path FROM acc)
UNION ALL
SELECT a.path, CASE WHEN c.content IS NOT NULL AND c.content = a.content THEN 'original' ELSE 'write' END, a.content
FROM acc a LEFT JOIN c_content c ON c.path = a.path""")
ORACLES["stale_nodes"] = with_corpus(POLICY_CTES.strip() + """,
jw AS (SELECT DISTINCT target FROM res WHERE status = 'success' AND lower(target) LIKE '%.java')
SELECT DISTINCT 'method' AS kind, m.name, m.class_name FROM c_method m JOIN jw ON jw.target = m.path WHERE m.name <> 'ping'""")
ORACLES["stale_edges"] = with_corpus(POLICY_CTES.strip() + """,
jw AS (SELECT DISTINCT target AS path FROM res WHERE status = 'success' AND lower(target) LIKE '%.java'),
rm AS (SELECT path, class_name FROM c_file WHERE s % 9 = 5 AND path NOT IN (SELECT path FROM jw)),
touched AS (SELECT path, class_name FROM c_file WHERE path IN (SELECT path FROM jw) UNION ALL SELECT path, class_name FROM rm)
SELECT 'calls' AS kind, src_name, src_class AS src_owner, dst_name, dst_class AS dst_owner FROM c_calls_first
  WHERE src_class IN (SELECT class_name FROM touched) OR dst_class IN (SELECT class_name FROM touched)
UNION ALL SELECT 'depends_on', src_name, src_file_path, dst_name, dst_file_path FROM c_dep_first
  WHERE src_file_path IN (SELECT path FROM touched) OR dst_file_path IN (SELECT path FROM rm)
UNION ALL SELECT 'contains', path, NULL, class_name, path FROM rm
UNION ALL SELECT DISTINCT 'defines', m.class_name, m.path, m.name, m.class_name FROM c_method m WHERE m.path IN (SELECT path FROM touched)""")
ORACLES["upsert_graph"] = ORACLES["build_graph"]
ORACLES["stream_ingest"] = ORACLES["build_graph"]
ORACLES["reingest_graph"] = with_corpus(POLICY_CTES.strip() + r""",
jw AS (SELECT DISTINCT target AS path, regexp_extract(content, 'class (\w+) ', 1) AS class_name
       FROM res WHERE status = 'success' AND lower(target) LIKE '%.java'),
src AS (SELECT 'public void ping() {' || chr(10) || '        log(1);' || chr(10) || '    }' AS ping)
SELECT 'file_nodes' AS "table", path AS k1, string_split(path, '/')[-1] AS k2, CAST(NULL AS VARCHAR) AS k3, CAST(NULL AS VARCHAR) AS k4,
       CAST(NULL AS VARCHAR) AS k5 FROM (SELECT path FROM c_file UNION SELECT path FROM jw)
UNION ALL SELECT 'class_nodes', c.name, c.file_path, CASE WHEN jw.path IS NULL THEN c.stereotype END, NULL, NULL
  FROM c_cnode c LEFT JOIN jw ON jw.path = c.file_path AND jw.class_name = c.name
UNION ALL SELECT 'class_nodes', class_name, path, NULL, NULL, NULL FROM jw WHERE (class_name, path) NOT IN (SELECT class_name, path FROM c_file)
UNION ALL SELECT 'method_nodes', name, class_name, http_method, endpoint, source_code FROM c_mnode
UNION ALL SELECT 'method_nodes', 'ping', class_name, NULL, NULL, ping FROM (SELECT DISTINCT class_name FROM jw), src
UNION ALL SELECT 'contains', path, class_name, NULL, NULL, NULL FROM (SELECT path, class_name FROM c_file UNION SELECT path, class_name FROM jw)
UNION ALL SELECT 'defines', class_name, path, name, NULL, NULL
  FROM (SELECT class_name, path, name FROM c_method UNION SELECT class_name, path, 'ping' FROM jw)
UNION ALL SELECT 'calls', src_name, src_class, dst_name, dst_class, NULL FROM c_calls_first
UNION ALL SELECT DISTINCT 'calls', 'ping', jw.class_name, 'log', n.class_name, NULL FROM jw JOIN c_mnode n ON n.name = 'log'
UNION ALL SELECT 'depends_on', src_name, src_file_path, dst_name, dst_file_path, NULL FROM c_dep_first""")
