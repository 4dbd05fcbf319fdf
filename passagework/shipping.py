"""Sends this package to the executors, which run its Python functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the package as a zip file that Spark serves to every executor."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="passagework-")) / "passagework.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)
