"""C10: stale rows of the graph, by the support that source files give to its edges.

A reference is a call or an injected type by name; ``references`` counts them per file, so an edge's support is the sum
over all files.  When files are read again or removed, only the counts of these files change: the differences are summed
per reference, and an edge is stale where its support falls to nothing or its target is gone.  The cost follows the files
that changed; of the other files only the counts of references that lost support are read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.extract import flat_calls, flat_deps, flat_methods

REFERENCE = ["kind", "src_name", "src_owner", "dst_name"]
EDGE = [*REFERENCE, "dst_owner"]


def references(parsed: DataFrame) -> DataFrame:
    """(kind, file_path, src_name, src_owner, dst_name, n): calls (owner: class) and injected types (owner: file)."""
    calls = flat_calls(flat_methods(parsed)).select(
        F.lit("calls").alias("kind"), F.col("path").alias("file_path"), F.col("name").alias("src_name"),
        F.col("class_name").alias("src_owner"), F.col("callee").alias("dst_name"))
    deps = flat_deps(parsed).select(
        F.lit("depends_on").alias("kind"), F.col("path").alias("file_path"), F.col("class_name").alias("src_name"),
        F.col("path").alias("src_owner"), F.col("dep").alias("dst_name"))
    return calls.unionByName(deps).groupBy("kind", "file_path", "src_name", "src_owner", "dst_name").agg(F.count(F.lit(1)).alias("n"))


def _touched(fresh_parsed: DataFrame, removed: DataFrame | None) -> DataFrame:
    paths = fresh_parsed.select(F.col("path").alias("file_path"))
    return (paths if removed is None else paths.unionByName(removed.select(F.col("path").alias("file_path")))).distinct()


def _fresh(fresh_parsed: DataFrame, removed: DataFrame | None) -> DataFrame:
    """What is parsed anew, without files that are removed as well."""
    return fresh_parsed if removed is None else fresh_parsed.join(removed.select("path").distinct(), "path", "left_anti")


def lost_references(refs: DataFrame, fresh_parsed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(kind, src_name, src_owner, dst_name) of the references that no file makes any more."""
    old = refs.join(_touched(fresh_parsed, removed), "file_path", "left_semi").select(*REFERENCE, (-F.col("n")).alias("n"))
    new = references(_fresh(fresh_parsed, removed)).select(*REFERENCE, "n")
    less = old.unionByName(new).groupBy(*REFERENCE).agg(F.sum("n").alias("_change")).filter(F.col("_change") < 0)
    support = refs.select(*REFERENCE, "n").join(less, REFERENCE).groupBy(*REFERENCE, "_change").agg(F.sum("n").alias("n"))
    return support.filter(F.col("n") + F.col("_change") <= 0).select(*REFERENCE)


def updated_references(refs: DataFrame, fresh_parsed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The reference counts after the change: other files' rows stay, those of the changed files are replaced."""
    kept = refs.join(_touched(fresh_parsed, removed), "file_path", "left_anti")
    return kept.unionByName(references(_fresh(fresh_parsed, removed)))


def _lost_definitions(graph: dict[str, DataFrame], fresh_parsed: DataFrame, removed: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of defines and contains that the changed files no longer give, and (name, class) of methods that no file defines."""
    touched, fresh = _touched(fresh_parsed, removed), _fresh(fresh_parsed, removed)
    methods = flat_methods(fresh).select(F.col("path").alias("file_path"), F.col("name").alias("method_name"), "class_name").distinct()
    own = graph["defines"].join(touched, "file_path", "left_semi")
    defines = own.join(methods, ["file_path", "method_name", "class_name"], "left_anti").select("class_name", "file_path", "method_name")
    pair = ["method_name", "class_name"]
    others = graph["defines"].join(defines.select(*pair).distinct(), pair, "left_semi").join(touched, "file_path", "left_anti").select(*pair)
    dead = defines.select(*pair).distinct().join(others.unionByName(methods.select(*pair)), pair, "left_anti")
    classes = fresh.filter(F.col("error").isNull()).select(F.col("path").alias("file_path"), "class_name")
    contains = graph["contains"].join(touched, "file_path", "left_semi").join(classes, ["file_path", "class_name"], "left_anti")
    return defines, contains.select("file_path", "class_name"), dead.select(F.col("method_name").alias("name"), "class_name")


def stale_edges(graph: dict[str, DataFrame], refs: DataFrame, fresh_parsed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(kind, src_name, src_owner, dst_name, dst_owner) of the edges that the changed files leave without ground.

    ``refs`` are the counts before the change (``references`` of what the graph was built from); ``removed`` (path) are
    files that are gone.  A call or dependency goes where nobody refers any more, or where the method or class it leads
    to has gone; a stub (owner null) never goes.  ``contains`` has (file, null, class, file), ``defines`` (class, file,
    method, class).
    """
    lost = lost_references(refs, fresh_parsed, removed)
    defines, contains, dead = _lost_definitions(graph, fresh_parsed, removed)
    calls = graph["calls"].select(F.lit("calls").alias("kind"), "src_name", F.col("src_class").alias("src_owner"), "dst_name", F.col("dst_class").alias("dst_owner"))
    deps = graph["depends_on"].select(F.lit("depends_on").alias("kind"), "src_name", F.col("src_file_path").alias("src_owner"), "dst_name", F.col("dst_file_path").alias("dst_owner"))
    gone = dead.select(F.lit("calls").alias("kind"), F.col("name").alias("dst_name"), F.col("class_name").alias("dst_owner")).unionByName(
        contains.select(F.lit("depends_on").alias("kind"), F.col("class_name").alias("dst_name"), F.col("file_path").alias("dst_owner")))
    edges = calls.unionByName(deps)
    none = F.lit(None).cast("string")
    return (
        edges.join(lost, REFERENCE, "left_semi")
        .unionByName(edges.join(gone, ["kind", "dst_name", "dst_owner"], "left_semi").select(*EDGE))
        .distinct()
        .unionByName(contains.select(F.lit("contains").alias("kind"), F.col("file_path").alias("src_name"), none.alias("src_owner"), F.col("class_name").alias("dst_name"), F.col("file_path").alias("dst_owner")))
        .unionByName(defines.select(F.lit("defines").alias("kind"), F.col("class_name").alias("src_name"), F.col("file_path").alias("src_owner"), F.col("method_name").alias("dst_name"), F.col("class_name").alias("dst_owner")))
    )


def prune_edges(graph: dict[str, DataFrame], stale: DataFrame) -> dict[str, DataFrame]:
    """The graph without the stale edges (node tables are left as they are)."""
    columns = {
        "calls": ["src_name", "src_class", "dst_name", "dst_class"],
        "depends_on": ["src_name", "src_file_path", "dst_name", "dst_file_path"],
        "contains": ["file_path", None, "class_name", None],
        "defines": ["class_name", "file_path", "method_name", None],
    }
    out = dict(graph)
    for kind, names in columns.items():
        gone = stale.filter(F.col("kind") == kind).alias("s")
        cond = F.lit(True)
        for own, other in zip(names, EDGE[1:]):
            if own:
                cond = cond & F.col(f"g.{own}").eqNullSafe(F.col(f"s.{other}"))
        out[kind] = graph[kind].alias("g").join(gone, cond, "left_anti")
    return out
