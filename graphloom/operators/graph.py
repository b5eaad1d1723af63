"""B12, C1-C10: the property graph as node and edge DataFrames.

Keys: File(path), Class(name, file_path), Method(name, class_name).  A NULL
``file_path`` / ``class_name`` marks a stub created by name binding, so every join
from an edge to a node is null-safe.

Sequential keyed upserts are replaced by a closed form over positions.  A
position is ``struct(batch, path, pos)``: the batch of the upsert, the file path
and the method's token position (ingest order pinned to string order of paths).
For one upsert:

* a call of ``n`` at position q binds every node ``(n, c)`` whose first
  definition is at or before q (nodes already in the graph are before all of
  the batch), plus the stub ``(n, NULL)`` if it exists;
* the stub exists iff it already existed, or the batch calls ``n`` before any
  node of that name exists.

The same rule binds ``@Autowired`` type names to Class nodes, with the file path
as position.  ``build_graph`` is an upsert into an empty graph.

Scale: call occurrences are pre-aggregated per (caller node, callee name) before
the name-binding join (one row per potential edge instead of one per call), so the
join output is already distinct.  The binding join is on the callee name; a
name holding a large share of all references is salted over many tasks
(``plans.skew``), and AQE broadcasts a side only when its measured size is
under the threshold.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as TX
from graphloom.operators.extract import flat_calls, flat_deps, flat_methods
from graphloom.plans.skew import salted_join

NODE_SCHEMAS = {
    "file_nodes": "path string, name string",
    "class_nodes": "name string, file_path string, stereotype string",
    "method_nodes": "name string, class_name string, http_method string, endpoint string, source_code string",
    "contains": "file_path string, class_name string",
    "defines": "class_name string, file_path string, method_name string",
    "calls": "src_name string, src_class string, dst_name string, dst_class string",
    "depends_on": "src_name string, src_file_path string, dst_name string, dst_file_path string",
}
GRAPH_TABLES = list(NODE_SCHEMAS)


def empty_graph(spark: SparkSession) -> dict[str, DataFrame]:
    return {k: spark.createDataFrame([], v) for k, v in NODE_SCHEMAS.items()}


def _pos(batch: int, path: Column, pos: Column) -> Column:
    return F.struct(F.lit(batch).alias("batch"), path.alias("path"), pos.cast("bigint").alias("pos"))


def _existing_pos() -> Column:
    return F.struct(F.lit(0).alias("batch"), F.lit("").alias("path"), F.lit(0).cast("bigint").alias("pos"))


def ingest_summary(parsed: DataFrame) -> DataFrame:
    """B12: the run summary as one row of counters.

    The per-file error list is not folded into this row (it is unbounded); it is
    the ``parse_errors`` table ``(path, message)``, counted here as ``n_errors``.
    Callers treat ``failed_files > 0`` as a failed run.
    """
    ok = F.col("error").isNull()
    return parsed.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_files"),
        F.count_if(ok).cast("bigint").alias("success_files"),
        F.count_if(~ok).cast("bigint").alias("failed_files"),
        F.count_if(ok).cast("bigint").alias("total_classes"),
        F.coalesce(F.sum(F.when(ok, F.size("methods"))), F.lit(0)).cast("bigint").alias("total_methods"),
        F.count_if(~ok).cast("bigint").alias("n_errors"),
    )


def parse_errors(parsed: DataFrame) -> DataFrame:
    """B10: one row per failed file."""
    return parsed.filter(F.col("error").isNotNull()).select("path", F.col("error").alias("message"))


def _bind(
    refs: DataFrame,
    defs_first: DataFrame,
    stubs: DataFrame,
    ref_key: str,
    def_key: str,
    def_loc: str,
) -> DataFrame:
    """Name binding: refs(<src cols>, ref_key, q) x defs_first(def_key, def_loc, d) on name, d <= q,
    plus one stub edge per ref whose name has a stub.  refs are distinct per (src, name).

    A name referenced by a large share of all refs (``log``, ``get``) is split over
    many tasks by salting (``plans.skew.salted_join``); the result is the plain join.
    """
    src_cols = [c for c in refs.columns if c != "q"]
    bound = salted_join(
        refs, defs_first.withColumnRenamed(def_key, "_n"), ref_key, "_n",
        condition=F.col("d") <= F.col("q"), salt_cols=src_cols,
    ).select(*src_cols, F.col(def_loc).alias("_loc"))
    stub_edges = salted_join(
        refs, stubs.select(F.col("name").alias("_n")), ref_key, "_n", how="left_semi", salt_cols=src_cols
    ).select(*src_cols, F.lit(None).cast("string").alias("_loc"))
    return bound.unionByName(stub_edges)


def upsert_graph(
    spark: SparkSession,
    graph: dict[str, DataFrame] | None,
    parsed: DataFrame,
    batch: int = 1,
    materialize: bool = True,
) -> dict[str, DataFrame]:
    """C1-C9: upsert one batch of parsed files into ``graph`` (None = empty). Never deletes.

    ``parsed`` feeds every node and edge table, so by default it is checkpointed
    once (to ``spark.checkpoint.dir``) instead of being re-extracted per table;
    pass ``materialize=False`` when the caller already persisted it.
    """
    g = graph or empty_graph(spark)
    if materialize:
        parsed = parsed.checkpoint(eager=True)
    good = parsed.filter(F.col("error").isNull())
    methods = flat_methods(parsed)
    calls = flat_calls(methods)
    deps = flat_deps(parsed)

    # ---- File / Class / Method nodes (C1-C3) --------------------------------
    file_nodes = (
        g["file_nodes"]
        .unionByName(good.select("path", TX.file_name(F.col("path")).alias("name")))
        .groupBy("path")
        .agg(F.max("name").alias("name"))
    )
    class_defs = good.select(F.col("class_name").alias("name"), F.col("path").alias("file_path"), "stereotype")
    method_defs = methods.select(
        "name",
        "class_name",
        _pos(batch, F.col("path"), F.col("pos")).alias("at"),
        F.struct("http_method", "endpoint", "source_code").alias("props"),
    )
    old_methods = g["method_nodes"].select(
        "name", "class_name", _existing_pos().alias("at"), F.struct("http_method", "endpoint", "source_code").alias("props")
    )
    all_method_defs = old_methods.unionByName(method_defs)
    # first definition of every node (existing ones rank before the batch)
    m_first = all_method_defs.groupBy("name", "class_name").agg(F.min("at").alias("d"))

    # ---- method stubs --------------------------------------------------------
    call_refs = calls.select(
        F.col("name").alias("src_name"),
        F.col("class_name").alias("src_class"),
        "callee",
        _pos(batch, F.col("path"), F.col("pos")).alias("at"),
    )
    name_first_def = m_first.groupBy("name").agg(F.min("d").alias("d"))
    name_first_call = call_refs.groupBy(F.col("callee").alias("name")).agg(F.min("at").alias("c"))
    new_stubs = name_first_call.join(name_first_def, "name", "left").filter(
        F.col("d").isNull() | (F.col("c") < F.col("d"))
    ).select("name")
    old_stubs = g["method_nodes"].filter(F.col("class_name").isNull()).select("name")
    stubs = old_stubs.unionByName(new_stubs).distinct()

    m_defined = m_first.filter(F.col("class_name").isNotNull())
    method_nodes = all_method_defs.filter(F.col("class_name").isNotNull()).groupBy("name", "class_name").agg(
        F.max_by("props", "at").alias("props")
    ).select("name", "class_name", "props.*")
    method_nodes = method_nodes.unionByName(
        stubs.select(
            "name",
            F.lit(None).cast("string").alias("class_name"),
            F.lit(None).cast("string").alias("http_method"),
            F.lit(None).cast("string").alias("endpoint"),
            F.lit(None).cast("string").alias("source_code"),
        )
    )

    # ---- CALLS (C6) ----------------------------------------------------------
    refs = call_refs.groupBy("src_name", "src_class", "callee").agg(F.max("at").alias("q"))
    new_calls = _bind(refs, m_defined, stubs, "callee", "name", "class_name").select(
        "src_name", "src_class", F.col("callee").alias("dst_name"), F.col("_loc").alias("dst_class")
    )
    calls_edges = g["calls"].unionByName(new_calls).distinct()

    # ---- Class nodes, DEPENDS_ON (C2, C8) -------------------------------------
    old_classes = g["class_nodes"].select(
        "name", "file_path", _existing_pos().alias("at"), F.col("stereotype")
    )
    new_classes = class_defs.select(
        "name", "file_path", _pos(batch, F.col("file_path"), F.lit(0)).alias("at"), "stereotype"
    )
    all_class_defs = old_classes.filter(F.col("file_path").isNotNull()).unionByName(new_classes)
    c_first = all_class_defs.groupBy("name", "file_path").agg(F.min("at").alias("d"))
    dep_refs = deps.select(
        F.col("class_name").alias("src_name"),
        F.col("path").alias("src_file_path"),
        "dep",
        _pos(batch, F.col("path"), F.lit(0)).alias("at"),
    )
    cname_first_def = c_first.groupBy("name").agg(F.min("d").alias("d"))
    cname_first_ref = dep_refs.groupBy(F.col("dep").alias("name")).agg(F.min("at").alias("c"))
    new_cstubs = cname_first_ref.join(cname_first_def, "name", "left").filter(
        F.col("d").isNull() | (F.col("c") < F.col("d"))
    ).select("name")
    old_cstubs = g["class_nodes"].filter(F.col("file_path").isNull()).select("name")
    cstubs = old_cstubs.unionByName(new_cstubs).distinct()
    class_nodes = all_class_defs.groupBy("name", "file_path").agg(
        F.max_by("stereotype", "at").alias("stereotype")
    ).unionByName(
        cstubs.select("name", F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("stereotype"))
    )
    drefs = dep_refs.groupBy("src_name", "src_file_path", "dep").agg(F.max("at").alias("q"))
    new_deps = _bind(drefs, c_first, cstubs, "dep", "name", "file_path").select(
        "src_name", "src_file_path", F.col("dep").alias("dst_name"), F.col("_loc").alias("dst_file_path")
    )
    depends_on = g["depends_on"].unionByName(new_deps).distinct()

    # ---- CONTAINS, DEFINES (C4, C5) -------------------------------------------
    contains = g["contains"].unionByName(good.select(F.col("path").alias("file_path"), "class_name")).distinct()
    defines = g["defines"].unionByName(
        methods.select("class_name", F.col("path").alias("file_path"), F.col("name").alias("method_name"))
    ).distinct()

    return {
        "file_nodes": file_nodes,
        "class_nodes": class_nodes,
        "method_nodes": method_nodes,
        "contains": contains,
        "defines": defines,
        "calls": calls_edges,
        "depends_on": depends_on,
    }


def build_graph(spark: SparkSession, parsed: DataFrame, materialize: bool = True) -> dict[str, DataFrame]:
    """A4: first-run graph of one ingest (upsert into an empty graph)."""
    return upsert_graph(spark, None, parsed, materialize=materialize)


def calls_settled(parsed: DataFrame, method_nodes: DataFrame) -> DataFrame:
    """C7: every call binds all nodes of that name (the fixed point of repeated runs)."""
    refs = flat_calls(flat_methods(parsed)).select(
        F.col("name").alias("src_name"), F.col("class_name").alias("src_class"), "callee"
    ).distinct()
    nodes = method_nodes.select(F.col("name").alias("_n"), F.col("class_name").alias("dst_class"))
    return salted_join(refs, nodes, "callee", "_n").select(
        "src_name", "src_class", F.col("callee").alias("dst_name"), "dst_class"
    )


def depends_on_settled(parsed: DataFrame, class_nodes: DataFrame) -> DataFrame:
    """C8 settled form for DEPENDS_ON."""
    refs = flat_deps(parsed).select(
        F.col("class_name").alias("src_name"), F.col("path").alias("src_file_path"), "dep"
    ).distinct()
    nodes = class_nodes.select(F.col("name").alias("_n"), F.col("file_path").alias("dst_file_path"))
    return salted_join(refs, nodes, "dep", "_n").select(
        "src_name", "src_file_path", F.col("dep").alias("dst_name"), "dst_file_path"
    )


def graph_digest(spark: SparkSession, graph: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) for every graph table, in one job."""
    parts = [g.select(F.lit(name).alias("table"), F.lit(1).alias("_one")) for name, g in graph.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table").agg(F.count("_one").cast("bigint").alias("rows"))


def graph_rows(graph: dict[str, DataFrame]) -> DataFrame:
    """All rows of all graph tables: ``table`` and the table's columns in order as k1..k5, null where it has fewer."""
    out = None
    for name, rows in graph.items():
        cols = [c.split()[0] for c in NODE_SCHEMAS[name].split(", ")]
        part = rows.select(F.lit(name).alias("table"), *[
            (F.col(cols[i]) if i < len(cols) else F.lit(None).cast("string")).alias(f"k{i + 1}") for i in range(5)])
        out = part if out is None else out.unionByName(part)
    return out


def stale_nodes(graph: dict[str, DataFrame], fresh_parsed: DataFrame) -> DataFrame:
    """C10: (kind, name, class_name) of the method and class nodes that the graph has from files in ``fresh_parsed``
    and a fresh extract of these files no longer has.  Files are matched by path alone, so a renamed class is found."""
    touched = fresh_parsed.select(F.col("path").alias("file_path")).distinct()
    fresh = flat_methods(fresh_parsed).select(F.col("path").alias("file_path"), F.col("name").alias("method_name"), "class_name").distinct()
    gone = graph["defines"].join(touched, "file_path", "left_semi").join(fresh, ["file_path", "method_name", "class_name"], "left_anti")
    # a method that another file still defines for the same class stays
    elsewhere = graph["defines"].join(touched, "file_path", "left_anti").select("method_name", "class_name").unionByName(fresh.select("method_name", "class_name")).distinct()
    methods = gone.select("method_name", "class_name").distinct().join(elsewhere, ["method_name", "class_name"], "left_anti")
    classes = graph["contains"].join(touched, "file_path", "left_semi").join(
        fresh_parsed.filter(F.col("error").isNull()).select(F.col("path").alias("file_path"), "class_name"), ["file_path", "class_name"], "left_anti")
    return methods.select(F.lit("method").alias("kind"), F.col("method_name").alias("name"), "class_name").unionByName(
        classes.select(F.lit("class").alias("kind"), F.col("class_name").alias("name"), F.lit(None).cast("string").alias("class_name")).distinct())


def write_graph(graph: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Sink: one parquet table per node / edge kind."""
    out = {}
    for name, df in graph.items():
        path = f"{base.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        out[name] = path
    return out


def read_graph(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(NODE_SCHEMAS[name]).parquet(p) for name, p in paths.items()}

