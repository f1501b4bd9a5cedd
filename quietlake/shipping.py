"""Sends this package to the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Add the package's files to the application, once; workers import it from there."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="quietlake-ship-")) / "quietlake_pkg.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, os.path.join(top.name, p.relative_to(top)))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)
