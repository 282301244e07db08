"""Sends the package to the executors, whose Python workers import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps

from pyspark.sql import SparkSession

_MARK = "_viewspan_shipped"


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, _MARK, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="viewspan-"), "viewspan.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    setattr(sc, _MARK, True)


def shipped(query):
    """``query(spark, ...)`` after the package has been sent."""

    @wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run
