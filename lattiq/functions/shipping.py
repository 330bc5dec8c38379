"""Sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Executors get the package's modules, once for each session; Spark's file server hands them out."""
    sc = spark.sparkContext
    if getattr(sc, "_lattiq_shipped", False):
        return
    import lattiq

    root = os.path.dirname(os.path.abspath(lattiq.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="lattiq"), "lattiq_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("lattiq", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._lattiq_shipped = True
