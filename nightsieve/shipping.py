"""Gives the executors the package, so that functions pickled by reference can be found there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors of this session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # the package itself came in an archive
        return
    path = os.path.join(tempfile.mkdtemp(prefix="nightsieve-ship-"), "nightsieve_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("nightsieve", os.path.relpath(full, root)))
    context.addPyFile(path)
