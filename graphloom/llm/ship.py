"""Puts this package on the executors, for sessions that were started without it."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import graphloom

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application; Spark sends it to the executors."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.abspath(list(graphloom.__path__)[0])
    path = os.path.join(tempfile.mkdtemp(), "graphloom_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
