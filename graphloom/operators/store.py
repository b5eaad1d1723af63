"""C9, S1: the graph as tables of changed rows, bucketed by the key that an upsert looks up.

Layout: ``<state>/<table>/version=<v>/bucket=<b>``.  A version holds the rows that one upsert added or changed,
nothing else; the graph of version v is the union of the versions from its base on, for a node the row of the newest
version.  Edges never change, so they are disjoint between versions.

An upsert needs, of each table, only rows whose key the batch names:

* Method nodes of names that the batch defines (with their properties) or calls (their keys alone),
* Class nodes of names that it defines or injects,
* CALLS edges out of method names that it defines, and File nodes, CONTAINS, DEFINES and DEPENDS_ON rows of its paths.

It reads these buckets (partition pruning), keeps the rows named (semi-join) and runs ``graph.upsert_graph`` on that
part, which gives the very rows that it gives on the whole graph.  What wasn't there before is the new version: bytes
written grow with what the batch changes.  Bytes read grow with the buckets named; a hot name's nodes are read by every
batch that calls it, since the call binds all of them.

``compact`` writes the whole graph as a new base.  Called when the versions since the base outweigh it, each row is
rewritten a constant number of times on average.
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators.extract import flat_calls, flat_deps, flat_methods

#: Column of each table that its buckets go by.
BUCKET_KEY = {"file_nodes": "path", "class_nodes": "name", "method_nodes": "name", "contains": "file_path", "defines": "file_path",
              "calls": "src_name", "depends_on": "src_file_path"}
#: Identity of a node; the other columns are properties.
NODE_KEY = {"file_nodes": ["path"], "class_nodes": ["name", "file_path"], "method_nodes": ["name", "class_name"]}


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def version_rows(spark: SparkSession, state: str, table: str, base: int, version: int, only: list[int] | None = None) -> DataFrame:
    """Rows of the versions base..version with their ``version``; of the buckets ``only``, if given."""
    rows = spark.read.schema(f"{G.NODE_SCHEMAS[table]}, version bigint, bucket int").parquet(f"{state}/{table}")
    rows = rows.where(F.col("version").between(base, version))
    return (rows if only is None else rows.where(F.col("bucket").isin(only))).drop("bucket")


def newest(rows: DataFrame, table: str) -> DataFrame:
    """The rows in force: of a node that of its newest version, of edges all."""
    key = NODE_KEY.get(table)
    if key is None:
        return rows.drop("version")
    props = [c for c in rows.columns if c not in key and c != "version"]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*props), "version").alias("p")).select(*key, "p.*")


def read(spark: SparkSession, state: str, base: int, version: int) -> dict[str, DataFrame]:
    """The whole graph of a version."""
    return {t: newest(version_rows(spark, state, t, base, version), t) for t in G.GRAPH_TABLES}


def named_keys(parsed: DataFrame) -> dict[str, DataFrame]:
    """The keys (column ``key``) that a batch names: its paths, its class names with injected types, the method names that
    it defines, and those that it only calls."""
    methods = flat_methods(parsed)
    defined = methods.select(F.col("name").alias("key")).distinct()
    classes = parsed.where(F.col("error").isNull()).select(F.col("class_name").alias("key")).unionByName(
        flat_deps(parsed).select(F.col("dep").alias("key")))
    return {
        "paths": parsed.where(F.col("error").isNull()).select(F.col("path").alias("key")).distinct(),
        "classes": classes.distinct(),
        "defined": defined,
        "called": flat_calls(methods).select(F.col("callee").alias("key")).distinct().join(defined, "key", "left_anti"),
    }


def relevant(spark: SparkSession, state: str, base: int, version: int, buckets: int, parsed: DataFrame) -> dict[str, DataFrame]:
    """The part of a version's graph that an upsert of ``parsed`` looks up.  Nodes of names that the batch calls and doesn't
    define come without properties: it can't change them."""
    keys = named_keys(parsed)
    kinds = list(keys)
    hit = None
    for kind in kinds:
        part = keys[kind].select(F.lit(kind).alias("kind"), bucket_of("key", buckets).alias("bucket")).distinct()
        hit = part if hit is None else hit.unionByName(part)
    touched: dict[str, list[int]] = {kind: [] for kind in kinds}
    for r in hit.collect():  # at most four rows a bucket
        touched[r["kind"]].append(r["bucket"])

    def rows(table: str, kind: str) -> DataFrame:
        found = version_rows(spark, state, table, base, version, touched[kind])
        return found.join(keys[kind].select(F.col("key").alias(BUCKET_KEY[table])), BUCKET_KEY[table], "left_semi").select(*found.columns)

    def part(table: str, kind: str) -> DataFrame:
        return newest(rows(table, kind), table)

    key = NODE_KEY["method_nodes"]
    full = part("method_nodes", "defined")
    bare = rows("method_nodes", "called").select(*key).distinct().select(
        *key, *[F.lit(None).cast("string").alias(c) for c in full.columns if c not in key])
    return {
        "file_nodes": part("file_nodes", "paths"),
        # each feeds several tables of the upsert: looked up once
        "class_nodes": part("class_nodes", "classes").checkpoint(),
        "method_nodes": full.unionByName(bare).checkpoint(),
        "contains": part("contains", "paths"),
        "defines": part("defines", "paths"),
        "calls": part("calls", "defined"),
        "depends_on": part("depends_on", "paths"),
    }


def write_version(tables: dict[str, DataFrame], state: str, version: int, buckets: int) -> None:
    """Write a version's rows.  A version that an earlier attempt left behind is replaced, table by table.  A bucket of
    many rows is written by several tasks (rebalance), few rows of one bucket make one file."""

    def write(table: str) -> None:
        keyed = tables[table].withColumn("bucket", bucket_of(BUCKET_KEY[table], buckets)).hint("rebalance", F.col("bucket"))
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{state}/{table}/version={version}")

    # the tables' jobs run side by side: those of a small batch are mostly waiting
    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(inheritable_thread_target(spark)(write), tables))


def upsert(spark: SparkSession, state: str, parsed: DataFrame, version: int, base: int, buckets: int) -> None:
    """Write version ``version``: what an upsert of ``parsed`` adds to or changes in version - 1 (no graph before 1)."""
    parsed = parsed.checkpoint(eager=True)
    if version == 1:
        write_version(G.upsert_graph(spark, None, parsed, materialize=False), state, 1, buckets)
        return
    old = relevant(spark, state, base, version - 1, buckets, parsed)
    new = G.upsert_graph(spark, old, parsed, batch=version, materialize=False)
    write_version({t: new[t].subtract(old[t]) for t in G.GRAPH_TABLES}, state, version, buckets)


def compact(spark: SparkSession, state: str, base: int, version: int, buckets: int) -> int:
    """Write the whole graph of ``version`` as version + 1, a base of ``buckets`` buckets; returns its number."""
    write_version(read(spark, state, base, version), state, version + 1, buckets)
    return version + 1


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the store that holds ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def version_bytes(spark: SparkSession, state: str, version: int) -> int:
    """Bytes of a version in all tables."""
    total = 0
    for table in G.GRAPH_TABLES:
        fs, path = file_system(spark, f"{state}/{table}/version={version}")
        total += fs.getContentSummary(path).getLength() if fs.exists(path) else 0
    return total


def drop_version(spark: SparkSession, state: str, version: int) -> None:
    for table in G.GRAPH_TABLES:
        fs, path = file_system(spark, f"{state}/{table}/version={version}")
        if fs.exists(path):
            fs.delete(path, True)
