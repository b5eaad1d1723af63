"""Connected components of a link table, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: lost executors don't cost more than the last step."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node joins the smallest id around it: its larger neighbours (large) or its smaller ones and itself."""
    if large:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = around.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in the links (a, b).  Ids without links don't appear."""
    edges = written(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    before = None
    while True:
        edges = written(_star(_star(edges, True), False), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        before = now
