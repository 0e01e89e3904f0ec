"""Sends this package to executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tagloom-src-")
        path = os.path.join(folder, "tagloom_src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(top.rglob("*.py")):
                out.write(f, f"{top.name}/{f.relative_to(top)}")
        spark.sparkContext.addPyFile(path)
        _sent.add(app)
    return spark
