"""S1: incremental ingest with Structured Streaming.

A stream of ``files(path, content)`` rows (a folder that receives new parquet /
binary files) is parsed and upserted into the graph micro-batch by micro-batch.
The graph lives under a state folder as versions of changed rows (``operators.store``):
a micro-batch reads the rows that its names touch, writes what it adds or changes as the
next version and then publishes it by a row of a small pointer table, which names the
stream (its checkpoint folder) and the micro-batch.  A micro-batch that failed before
publishing starts again from the same version and replaces what it left; one that was
published is not run again.  A stream with a new checkpoint goes on from the published
version.  When eight or more versions since the base outweigh it, the graph is written as a new base;
versions older than the base before are removed.

There is no event time in the data, so no watermark; ``trigger(availableNow=True)``
processes everything present and stops.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import extract as X
from graphloom.operators import store as ST

FILES_SCHEMA = "path string, content string"
POINTER_SCHEMA = "version bigint, stream string, batch_id bigint, base bigint, buckets int"
#: Buckets of a table in a new state folder; an upsert reads the buckets that its names fall into.
BUCKETS = 64
#: Versions since the base before it is asked whether they outweigh it.
LEAST_VERSIONS = 8


def _pointer(state_dir: str) -> str:
    return f"{state_dir.rstrip('/')}/_current"


def _published(spark: SparkSession, state_dir: str) -> list:
    """Pointer rows (version, stream, batch_id, base, buckets), oldest first; none before the first batch."""
    fs, path = ST.file_system(spark, _pointer(state_dir))
    return spark.read.parquet(_pointer(state_dir)).orderBy("version").collect() if fs.exists(path) else []


def _publish(spark: SparkSession, state_dir: str, version: int, stream: str | None, batch_id: int | None, base: int, buckets: int) -> None:
    spark.createDataFrame([(version, stream, batch_id, base, buckets)], POINTER_SCHEMA).coalesce(1).write.mode("append").parquet(_pointer(state_dir))


def current_graph(spark: SparkSession, state_dir: str) -> tuple[int, dict[str, DataFrame] | None]:
    """The last published (version, graph), or (0, None) before the first batch."""
    rows = _published(spark, state_dir)
    if not rows:
        return 0, None
    return rows[-1]["version"], ST.read(spark, state_dir.rstrip("/"), rows[-1]["base"], rows[-1]["version"])


def latest_per_path(files: DataFrame) -> DataFrame:
    """One row per path: the version of the newest file (column ``at``, where there is one), of equal age the largest text."""
    at = F.col("at") if "at" in files.columns else F.lit(0)
    return files.groupBy("path").agg(F.max_by("content", F.struct(at, F.col("content"))).alias("content"))


def upsert_batch(spark: SparkSession, state_dir: str, files: DataFrame, batch_id: int, stream: str = "", buckets: int = BUCKETS) -> int:
    """Upsert a micro-batch of ``stream`` into the published graph and publish the result as the next version.

    A batch that was published before (a failure came between publishing and the offset commit) is left as it is.
    ``buckets`` counts for a new state folder; another goes on with its own until ``rebase`` gives it others.
    """
    state, rows = state_dir.rstrip("/"), _published(spark, state_dir)
    own = [r["version"] for r in rows if r["stream"] == stream and r["batch_id"] == batch_id]
    if own:
        return own[0]
    version, base = (rows[-1]["version"] + 1, rows[-1]["base"]) if rows else (1, 1)
    buckets = rows[-1]["buckets"] if rows else buckets
    ST.upsert(spark, state, X.parse(latest_per_path(files)), version, base, buckets)
    _publish(spark, state_dir, version, stream, batch_id, base, buckets)
    if version - base >= LEAST_VERSIONS and sum(ST.version_bytes(spark, state, v) for v in range(base + 1, version + 1)) > ST.version_bytes(spark, state, base):
        rebase(spark, state_dir)
    return version


def rebase(spark: SparkSession, state_dir: str, buckets: int | None = None) -> int:
    """Publish the graph as a new base version, of ``buckets`` buckets a table (as before, if not given), and remove the
    versions older than the base before; they stay for readers of that base until then."""
    state, rows = state_dir.rstrip("/"), _published(spark, state_dir)
    last = rows[-1]
    version = ST.compact(spark, state, last["base"], last["version"], last["buckets"] if buckets is None else buckets)
    _publish(spark, state_dir, version, None, None, version, last["buckets"] if buckets is None else buckets)
    bases = sorted({r["base"] for r in rows})
    for old in range(bases[-2] if len(bases) > 1 else bases[-1], bases[-1]):
        ST.drop_version(spark, state, old)
    return version


def stream_ingest(
    spark: SparkSession,
    source_dir: str,
    state_dir: str,
    checkpoint_dir: str,
    source_format: str = "parquet",
    files_per_trigger: int | None = None,
) -> int:
    """Run the incremental ingest over everything in ``source_dir``; returns the last version."""
    reader = spark.readStream.schema(FILES_SCHEMA).format(source_format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.load(source_dir).select("path", "content", F.col("_metadata.file_modification_time").alias("at"))

    def on_batch(df: DataFrame, batch_id: int) -> None:
        upsert_batch(df.sparkSession, state_dir, df, batch_id, checkpoint_dir)

    query = (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    version, _ = current_graph(spark, state_dir)
    return version
