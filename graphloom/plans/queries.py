"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator key.

Every query reads the given tables (the Java corpus is rendered from ``supplier``
and ``part``; prose from ``documents``; questions from ``conversations`` and
``part``; paths from ``pages``; write sequence from ``events``), so its work
grows with them.  Column names match ``graphloom.plans.oracle``.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import extract as X
from graphloom.operators import graph as G
from graphloom.operators import provenance as PR
from graphloom.operators import tokens as TK
from graphloom.operators import traverse as TR
from graphloom.plans import pipeline as P
from graphloom.session import ensure_checkpoint_dir, scratch_path
from graphloom.sources import files as SRC

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(key: str):
    def deco(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)

        REGISTRY[key] = run
        return run

    return deco


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


# ---------------------------------------------------------------- extraction
@register("token_table")
def q_token_table(spark, sf_dir):
    keyed = TK.key_files(P.files(spark, sf_dir))
    return TK.token_digest(TK.token_table(keyed), keyed)


def _records(spark, sf_dir) -> DataFrame:
    """The parsed records where a query reads a few columns: as written, if they are; else what makes these columns is run."""
    return P.known(spark, sf_dir, "parsed") or X.parse(P.files(spark, sf_dir))


@register("class_names")
def q_class_names(spark, sf_dir):
    return _records(spark, sf_dir).select("path", "class_name")


@register("stereotypes")
def q_stereotypes(spark, sf_dir):
    return _records(spark, sf_dir).select("path", "stereotype")


@register("autowired_deps")
def q_autowired_deps(spark, sf_dir):
    return X.flat_deps(_records(spark, sf_dir)).select("path", "ord", "dep")


@register("methods")
def q_methods(spark, sf_dir):
    return P.methods(spark, sf_dir).select("path", "class_name", "ord", "name")


@register("http_mappings")
def q_http_mappings(spark, sf_dir):
    return P.methods(spark, sf_dir).select("path", "ord", "name", "http_method")


@register("endpoints")
def q_endpoints(spark, sf_dir):
    return P.methods(spark, sf_dir).select("path", "ord", "name", "endpoint")


@register("call_names")
def q_call_names(spark, sf_dir):
    return X.flat_calls(P.methods(spark, sf_dir)).select("path", "ord", "call_ord", "callee")


@register("method_source")
def q_method_source(spark, sf_dir):
    return P.methods(spark, sf_dir).select("path", "ord", "source_code")


def _manifest_parsed(spark, sf_dir) -> DataFrame:
    """B10: the corpus as real files of which every seventh never reached the disk, read by a manifest that names all:
    each of those is a failed row."""

    def build():
        files = P.files(spark, sf_dir)
        root = scratch_path(spark, "manifest")
        number = F.regexp_extract("path", r"(\d+)\.java$", 1).cast("long")
        SRC.write_files(files.where(number % 7 != 3), root)
        manifest = files.select(F.concat(F.lit(root), F.col("path")).alias("path"))
        read = SRC.read_tree(manifest)
        return X.parse(read.select(F.substring("path", len(root) + 1, 1 << 30).alias("path"), TX.decode_text(F.col("content")).alias("content"), "error"))

    return P.memo(spark, sf_dir, "manifest", build)


@register("parse_errors")
def q_parse_errors(spark, sf_dir):
    return G.parse_errors(_manifest_parsed(spark, sf_dir)).select("path", F.col("message").alias("error"))


@register("parsed_files")
def q_parsed_files(spark, sf_dir):
    return P.parsed(spark, sf_dir).select(
        "path",
        "class_name",
        "stereotype",
        F.size("autowired_deps").cast("bigint").alias("n_deps"),
        F.size("methods").cast("bigint").alias("n_methods"),
        "error",
    )


@register("ingest_summary")
def q_ingest_summary(spark, sf_dir):
    return G.ingest_summary(_manifest_parsed(spark, sf_dir))


# --------------------------------------------------------------------- graph
@register("file_nodes")
def q_file_nodes(spark, sf_dir):
    return P.graph(spark, sf_dir)["file_nodes"]


@register("class_nodes")
def q_class_nodes(spark, sf_dir):
    return P.graph(spark, sf_dir)["class_nodes"]


@register("method_nodes")
def q_method_nodes(spark, sf_dir):
    return P.graph(spark, sf_dir)["method_nodes"]


@register("contains_edges")
def q_contains(spark, sf_dir):
    return P.graph(spark, sf_dir)["contains"]


@register("defines_edges")
def q_defines(spark, sf_dir):
    return P.graph(spark, sf_dir)["defines"]


@register("calls_edges")
def q_calls(spark, sf_dir):
    return P.graph(spark, sf_dir)["calls"]


@register("calls_edges_settled")
def q_calls_settled(spark, sf_dir):
    return P.settled_calls(spark, sf_dir)


@register("depends_on_edges")
def q_depends_on(spark, sf_dir):
    return P.graph(spark, sf_dir)["depends_on"]


@register("depends_on_settled")
def q_depends_on_settled(spark, sf_dir):
    return G.depends_on_settled(P.parsed(spark, sf_dir), P.graph(spark, sf_dir)["class_nodes"])


@register("build_graph")
def q_build_graph(spark, sf_dir):
    g = G.build_graph(spark, X.parse(P.files(spark, sf_dir)))
    return G.graph_digest(spark, g)


# ----------------------------------------------------------------- traversal
def _all_names(spark, sf_dir) -> DataFrame:
    return P.graph(spark, sf_dir)["method_nodes"].select(F.col("name").alias("method_name"))


@register("call_graph")
def q_call_graph(spark, sf_dir):
    g = P.graph(spark, sf_dir)
    return TR.call_graph(P.settled_calls(spark, sf_dir), g["method_nodes"], _all_names(spark, sf_dir)).select(
        "seed", "callee", "class", "endpoint"
    )


@register("call_graph_all")
def q_call_graph_all(spark, sf_dir):
    g = P.graph(spark, sf_dir)
    return TR.call_graph(g["calls"], g["method_nodes"], _all_names(spark, sf_dir))


@register("call_reach")
def q_call_reach(spark, sf_dir):
    return TR.call_reach(P.settled_calls(spark, sf_dir), _all_names(spark, sf_dir))


def routes(spark, sf_dir) -> DataFrame:
    """Route requests derived from ``nation``: a method route and a class-level prefix per nation."""
    nation = _read(spark, sf_dir, "nation")
    return nation.select(
        F.explode(
            F.array(
                F.struct((F.col("n_nationkey") * 2).cast("bigint").alias("request_id"), F.concat(F.lit("/r"), F.col("n_nationkey").cast("string")).alias("route")),
                F.struct((F.col("n_nationkey") * 2 + 1).cast("bigint").alias("request_id"), F.concat(F.lit("/nation"), F.col("n_nationkey").cast("string")).alias("route")),
            )
        ).alias("r")
    ).select("r.*")


@register("find_by_endpoint")
def q_find_by_endpoint(spark, sf_dir):
    return TR.find_by_endpoint(P.graph(spark, sf_dir)["method_nodes"], routes(spark, sf_dir))


# -------------------------------------------------------------------- search
from graphloom.operators import context as CX  # noqa: E402
from graphloom.operators import search as S  # noqa: E402
from graphloom.functions import text as TX  # noqa: E402


def doc_index(spark, sf_dir) -> S.Index:
    docs = _read(spark, sf_dir, "documents")
    return P.memo(spark, sf_dir, "doc_index", lambda: S.build_index(docs, ["doc_id"], {"text": F.col("text")}).checkpoint())


def code_index(spark, sf_dir) -> S.Index:
    return P.memo(spark, sf_dir, "code_index", lambda: S.method_index(P.graph(spark, sf_dir)["method_nodes"]).checkpoint())


def conv_questions(spark, sf_dir) -> DataFrame:
    """User turns of ``conversations`` as questions; the id is made of both parts of their key."""
    conv = _read(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "user").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.col("text").alias("question"),
    )


def part_questions(spark, sf_dir) -> DataFrame:
    """One question per distinct part name (the name appears in the corpus sources)."""
    part = _read(spark, sf_dir, "part")
    return part.groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(
        F.concat(F.lit("part:"), F.col("k").cast("string")).alias("question_id"),
        F.concat(F.lit("Where is the "), F.col("p_name"), F.lit(" handled?")).alias("question"),
    )


def all_questions(spark, sf_dir) -> DataFrame:
    return conv_questions(spark, sf_dir).unionByName(part_questions(spark, sf_dir))


def conv_terms(spark, sf_dir) -> DataFrame:
    return CX.key_terms(conv_questions(spark, sf_dir))


def turn_words(spark, sf_dir) -> DataFrame:
    """All words of each user turn, as raw query words."""
    return conv_questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.split("question", r"\s+").alias("terms"))


def distinct_words(spark, sf_dir) -> DataFrame:
    """Each distinct term of the user turns, as a query of its own."""
    return conv_questions(spark, sf_dir).select(F.explode(TX.analyze(F.col("question"))).alias("query_id")).distinct()


def _doc_out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "doc_id", "score")


@register("analyze_text")
def q_analyze_text(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    terms = TX.analyze(F.col("text"))
    return docs.select(
        "doc_id",
        F.size(terms).cast("bigint").alias("n_terms"),
        F.size(F.array_distinct(terms)).cast("bigint").alias("n_distinct"),
    )


@register("postings")
def q_postings(spark, sf_dir):
    return doc_index(spark, sf_dir).postings.select(
        "doc_id", "term", F.col("tf").cast("bigint").alias("tf"), F.array_join("positions", ",").alias("positions")
    )


@register("term_stats")
def q_term_stats(spark, sf_dir):
    idx = doc_index(spark, sf_dir)
    cf = idx.postings.groupBy("field", "term").agg(F.sum("tf").cast("bigint").alias("cf"))
    return idx.term_df.join(cf, ["field", "term"]).join(idx.field_stats, "field").select(
        "term", F.col("df").cast("bigint").alias("df"), "cf", F.col("n_docs").cast("bigint").alias("n_docs"),
        F.round("avgdl", 6).alias("avgdl"),
    )


def _with_props(res: DataFrame, method_nodes: DataFrame) -> DataFrame:
    props = method_nodes.select(F.col("name").alias("_n"), F.col("class_name").alias("_c"), "http_method", "endpoint")
    return res.join(props, (F.col("name") == F.col("_n")) & F.col("class_name").eqNullSafe(F.col("_c")), "left")


@register("search_code")
def q_search_code(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    queries = part.select(F.col("p_partkey").alias("query_id"), F.split("p_name", " ").alias("terms"))
    res = S.search(code_index(spark, sf_dir), queries)
    return _with_props(res, P.graph(spark, sf_dir)["method_nodes"]).select(
        "query_id", "rank", F.col("name").alias("method"), F.col("class_name").alias("class"),
        "http_method", "endpoint", "score",
    )


@register("search_any")
def q_search_any(spark, sf_dir):
    return _doc_out(S.search(doc_index(spark, sf_dir), turn_words(spark, sf_dir)))


@register("search_bool")
def q_search_bool(spark, sf_dir):
    idx = doc_index(spark, sf_dir)
    q = turn_words(spark, sf_dir)
    all_of = _doc_out(S.search(idx, q, mode="all")).withColumn("mode", F.lit("all"))
    nq = q.filter(F.size("terms") >= 2).select(
        "query_id", F.slice("terms", 1, 1).alias("must"), F.expr("slice(terms, 2, size(terms) - 1)").alias("must_not")
    )
    none_of = _doc_out(S.search_not(idx, nq)).withColumn("mode", F.lit("not"))
    return all_of.unionByName(none_of).select("query_id", "mode", "rank", "doc_id", "score")


@register("search_phrase")
def q_search_phrase(spark, sf_dir):
    bench = _read(spark, sf_dir, "benchmark")
    q = bench.select(F.col("item_id").alias("query_id"), F.split("text", r"\s+").alias("terms"))
    return _doc_out(S.search_phrase(doc_index(spark, sf_dir), q))


@register("search_prefix")
def q_search_prefix(spark, sf_dir):
    q = distinct_words(spark, sf_dir).withColumn("prefix", F.col("query_id"))
    return _doc_out(S.search_prefix(doc_index(spark, sf_dir), q))


@register("search_fuzzy")
def q_search_fuzzy(spark, sf_dir):
    q = distinct_words(spark, sf_dir).withColumn("word", F.col("query_id"))
    return _doc_out(S.search_fuzzy(doc_index(spark, sf_dir), q))


@register("search_field")
def q_search_field(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    queries = part.select(
        F.col("p_partkey").alias("query_id"),
        F.array(F.concat(F.lit("op"), F.col("p_size").cast("string"))).alias("terms"),
    )
    res = S.search(code_index(spark, sf_dir), queries, fields=["name"])
    return res.select("query_id", "rank", F.col("name").alias("method"), F.col("class_name").alias("class"), "score")


# ------------------------------------------------------------------- context
def _context(spark, sf_dir):
    def build():
        g = P.graph(spark, sf_dir)
        return CX.question_context(
            all_questions(spark, sf_dir), code_index(spark, sf_dir), g["method_nodes"], P.settled_calls(spark, sf_dir)
        )

    return P.memo(spark, sf_dir, "context", build)


def _hits(spark, sf_dir):
    return CX.question_hits(
        CX.key_terms(all_questions(spark, sf_dir)), code_index(spark, sf_dir), P.graph(spark, sf_dir)["method_nodes"]
    )


@register("key_terms")
def q_key_terms(spark, sf_dir):
    return conv_terms(spark, sf_dir).select(
        "question_id", F.posexplode("terms").alias("term_pos", "term")
    ).select("question_id", (F.col("term_pos") + 1).cast("bigint").alias("term_pos"), "term")


@register("question_hits")
def q_question_hits(spark, sf_dir):
    return _hits(spark, sf_dir).drop("score_raw")


@register("question_methods")
def q_question_methods(spark, sf_dir):
    return CX.question_methods(_hits(spark, sf_dir)).drop("score_raw")


@register("question_chains")
def q_question_chains(spark, sf_dir):
    g = P.graph(spark, sf_dir)
    methods = CX.question_methods(_hits(spark, sf_dir))
    return CX.question_chains(methods, P.settled_calls(spark, sf_dir), g["method_nodes"])


@register("question_context")
def q_question_context(spark, sf_dir):
    return _context(spark, sf_dir)[0]


@register("question_status")
def q_question_status(spark, sf_dir):
    """G6: from the listed methods alone; call chains have no part in it."""
    return CX.question_status(CX.key_terms(all_questions(spark, sf_dir)), CX.question_methods(_hits(spark, sf_dir)))


# ------------------------------------------------------------ sources / sinks
from graphloom.operators import policy as PO  # noqa: E402
from graphloom.streaming import ingest as ST  # noqa: E402

URL_PATH = r"^[a-z]+://[^/]+(/[^?#]*)"
WRITE_ROOTS = "/repo/src:/repo/en ; /repo/de"


def source_tree(spark, sf_dir) -> DataFrame:
    """Documents as files of a tree: plain, underscore and hidden names, empty files, folders named like files, and
    suffixes in capitals (which no scan for ``*.java`` finds)."""
    docs = _read(spark, sf_dir, "documents").where("text IS NOT NULL")
    i, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    path = (
        F.when(kind == 0, F.concat(F.lit("/a/Doc"), i, F.lit(".java")))
        .when(kind == 1, F.concat(F.lit("/a/_Doc"), i, F.lit(".java")))
        .when(kind == 2, F.concat(F.lit("/.hidden/b/.Doc"), i, F.lit(".java")))
        .when(kind == 3, F.concat(F.lit("/_build/Empty"), i, F.lit(".java")))
        .when(kind == 4, F.concat(F.lit("/a/Folder"), (F.col("doc_id") % 10).cast("string"), F.lit(".java/Doc"), i, F.lit(".java")))
        .otherwise(F.concat(F.lit("/a/Doc"), i, F.lit(".JAVA")))
    )
    return docs.select(path.alias("path"), F.when(kind == 3, F.lit("")).otherwise(F.col("text")).alias("content"))


@register("scan_files")
def q_scan_files(spark, sf_dir):
    """A1: documents written as a tree of files, listed and read back."""
    root = scratch_path(spark, "source-tree")
    SRC.write_files(source_tree(spark, sf_dir), root)
    found = SRC.scan_files(spark, root)
    top = SRC.local_path(root) or root
    return found.select(F.substring("path", len(top) + 1, 1 << 30).alias("path"), "name", "length", "content", "error")


@register("decode_text")
def q_decode_text(spark, sf_dir):
    """A2: documents as UTF-8 bytes with an invalid byte and a CRLF appended, decoded back."""
    docs = _read(spark, sf_dir, "documents")
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF0D0A")))
    return docs.select("doc_id", TX.decode_text(raw).alias("text"))


@register("path_parts")
def q_path_parts(spark, sf_dir):
    """A3 over the URL paths of ``pages``."""
    pages = _read(spark, sf_dir, "pages")
    return SRC.path_parts(pages.select("page_id", F.regexp_extract("url", URL_PATH, 1).alias("path")))


def read_requests(spark, sf_dir) -> DataFrame:
    """Two fetches per supplier: its corpus file, and the same name under the next package."""
    sup = _read(spark, sf_dir, "supplier")
    base = F.concat(F.lit("/repo/src/pkg"), F.col("s_nationkey").cast("string"))
    other = F.concat(F.lit("/repo/src/pkg"), ((F.col("s_nationkey") + 1) % 25).cast("string"))
    name = F.concat(F.lit("/Supplier"), F.col("s_suppkey").cast("string"), F.lit(".java"))
    return sup.select(
        F.explode(
            F.array(
                F.struct((F.col("s_suppkey") * 2).cast("bigint").alias("request_id"), F.concat(base, name).alias("file_path")),
                F.struct((F.col("s_suppkey") * 2 + 1).cast("bigint").alias("request_id"), F.concat(other, name).alias("file_path")),
            )
        ).alias("r")
    ).select("r.*")


@register("read_files")
def q_read_files(spark, sf_dir):
    return PO.read_files(P.files(spark, sf_dir), read_requests(spark, sf_dir))


def proposed_writes(spark, sf_dir) -> DataFrame:
    """One proposed write per event (seq = event_id); the target depends on the event type."""
    ev = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    pages = _read(spark, sf_dir, "pages").select(
        F.col("page_id"), F.regexp_extract("url", URL_PATH, 1).alias("url_path")
    )
    sup = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = ev.join(pages, ev["user_id"] == pages["page_id"], "left").join(sup, ev["user_id"] == sup["s_suppkey"], "left")
    u = F.col("user_id").cast("string")
    up = F.coalesce(F.col("url_path"), F.lit("/misc"))
    corpus_path = F.concat(F.lit("/repo/src/pkg"), F.col("s_nationkey").cast("string"), F.lit("/Supplier"), u, F.lit(".java"))
    path = (
        F.when(F.col("event_type") == "view", F.coalesce(corpus_path, F.concat(F.lit("/repo/src/new/User"), u, F.lit(".java"))))
        .when(F.col("event_type") == "signup", F.concat(F.lit("/repo"), up, F.lit("/.env")))
        .when(F.col("event_type") == "click", F.concat(F.lit("/repo"), up, F.lit("/../.git/config")))
        .when(F.col("event_type") == "error", F.concat(F.lit("/repo/./"), up, F.lit("/notes.txt")))
        .otherwise(F.concat(F.lit("logs/"), up, F.lit("/key.PEM")))
    )
    java = F.concat(
        F.lit("public class Supplier"), u, F.lit(" {\n    public void ping() {\n        log(1);\n    }\n}\n")
    )
    content = F.when(F.col("event_type") == "view", java).otherwise(F.col("props"))
    return j.select(F.col("event_id").cast("bigint").alias("seq"), path.alias("file_path"), content.alias("content"))


def _classified(spark, sf_dir) -> DataFrame:
    return PO.classify_writes(proposed_writes(spark, sf_dir), PO.parse_roots(WRITE_ROOTS))


@register("normalize_path")
def q_normalize_path(spark, sf_dir):
    return _classified(spark, sf_dir).select("seq", "file_path", "target")


@register("write_policy")
def q_write_policy(spark, sf_dir):
    return _classified(spark, sf_dir).select("seq", "target", "status", "reason")


@register("write_result")
def q_write_result(spark, sf_dir):
    c = _classified(spark, sf_dir)
    return c.select(
        "seq", "status", F.when(F.col("status") == "success", F.col("target")).alias("path"), "bytes_written", "warning", "reason",
        PO.result_json(c).alias("result"),
    )


@register("apply_writes")
def q_apply_writes(spark, sf_dir):
    files = P.files(spark, sf_dir)
    out = PO.apply_writes(files, _classified(spark, sf_dir))
    original = files.select("path", "content")
    return out.join(original.withColumnRenamed("content", "_orig"), "path", "left").select(
        "path",
        F.when(F.col("_orig").isNotNull() & (F.col("_orig") == F.col("content")), F.lit("original")).otherwise(F.lit("write")).alias("origin"),
        "content",
    )


def _accepted(spark, sf_dir) -> DataFrame:
    """The accepted ``.java`` writes (path, content), the last one of each path."""
    c = _classified(spark, sf_dir)
    accepted = c.filter((F.col("status") == "success") & F.lower(F.col("target")).endswith(".java"))
    return accepted.groupBy(F.col("target").alias("path")).agg(F.max_by("content", "seq").alias("content"))


def _rewritten(spark, sf_dir) -> DataFrame:
    """The accepted writes, extracted anew."""
    return P.memo(spark, sf_dir, "rewritten", lambda: X.parse(_accepted(spark, sf_dir)).checkpoint())


@register("stale_nodes")
def q_stale_nodes(spark, sf_dir):
    return G.stale_nodes(P.graph(spark, sf_dir), _rewritten(spark, sf_dir))


@register("stale_edges")
def q_stale_edges(spark, sf_dir):
    """C10: edges without ground after the accepted writes and the removal of files of every ninth supplier."""
    fresh = _rewritten(spark, sf_dir)
    number = F.regexp_extract("path", r"(\d+)\.java$", 1).cast("long")
    removed = P.files(spark, sf_dir).where(number % 9 == 5).select("path").join(fresh.select("path"), "path", "left_anti")
    refs = PR.references(P.parsed(spark, sf_dir))
    return PR.stale_edges(P.graph(spark, sf_dir), refs, fresh, removed)


SPLIT_PATH = "/repo/src/pkg2"


@register("upsert_graph")
def q_upsert_graph(spark, sf_dir):
    """C9: graph of the paths before SPLIT_PATH, then an upsert of the rest."""
    files = P.files(spark, sf_dir)
    first = G.build_graph(spark, X.parse(files.filter(F.col("path") < SPLIT_PATH)))
    both = G.upsert_graph(spark, first, X.parse(files.filter(F.col("path") >= SPLIT_PATH)), batch=2)
    return G.graph_digest(spark, both)


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """S1: two incremental runs of the stream (files before SPLIT_PATH, then the rest)."""
    files = P.files(spark, sf_dir)
    src = scratch_path(spark, "stream-src")
    state = scratch_path(spark, "stream-state")
    ckpt = scratch_path(spark, "stream-ckpt")
    files.filter(F.col("path") < SPLIT_PATH).write.mode("append").parquet(src)
    ST.stream_ingest(spark, src, state, ckpt, files_per_trigger=None)
    files.filter(F.col("path") >= SPLIT_PATH).write.mode("append").parquet(src)
    ST.stream_ingest(spark, src, state, ckpt, files_per_trigger=None)
    _, graph = ST.current_graph(spark, state)
    return G.graph_digest(spark, graph)


@register("reingest_graph")
def q_reingest_graph(spark, sf_dir):
    """C9, S1: the whole corpus by the stream, then the accepted writes (new versions of files that the graph holds, and new
    files) by a second run of it; every row of every graph table."""
    src, state, ckpt = (scratch_path(spark, f"reingest-{part}") for part in ("src", "state", "ckpt"))
    P.files(spark, sf_dir).select("path", "content").write.mode("append").parquet(src)
    ST.stream_ingest(spark, src, state, ckpt)
    _accepted(spark, sf_dir).write.mode("append").parquet(src)
    ST.stream_ingest(spark, src, state, ckpt)
    return G.graph_rows(ST.current_graph(spark, state)[1])
