"""Python workers import the package from a zip that Spark serves to them, whatever folder they start in."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGES = ("palisade", "workload")


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_palisade_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    path = os.path.join(tempfile.mkdtemp(prefix="palisade-"), "palisade-sources.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for package in _PACKAGES:
            for source in sorted((top / package).rglob("*.py")):
                archive.write(source, source.relative_to(top).as_posix())
    context.addPyFile(path)
    context._palisade_shipped = True
