"""A1-A3: source files as a ``files(path, content)`` DataFrame."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.sources.tree import list_tree, local_path, read_tree, write_files  # noqa: F401


def scan_files(spark: SparkSession, root: str, glob: str = "*.java", with_content: bool = True, folders: str = "skip") -> DataFrame:
    """A1: every file under ``root`` whose name matches ``glob``: ``path, name, length, error`` and, with
    ``with_content``, the decoded ``content`` (null where ``error`` says why the file can't be read).

    Hidden, underscore and empty files count.  A missing root raises.  See ``sources.tree``.
    """
    found = list_tree(spark, root, glob, folders)
    if not with_content:
        return found
    return read_tree(found).select("path", "name", "length", T.decode_text(F.col("content")).alias("content"), "error")


def files_from_binary(df: DataFrame, path_col: str = "path", bytes_col: str = "content") -> DataFrame:
    """A2: any (path, bytes) table -> files(path, content) with decoded, newline-normalised text."""
    return df.select(
        T.strip_scheme(F.col(path_col)).alias("path"),
        T.decode_text(F.col(bytes_col)).alias("content"),
    )


def path_parts(df: DataFrame, path_col: str = "path") -> DataFrame:
    """A3: add ``name`` (last segment) and ``stem`` (name minus its last suffix)."""
    name = T.file_name(F.col(path_col))
    return df.withColumn("name", name).withColumn("stem", T.file_stem(name))
