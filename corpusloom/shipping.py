"""Sends this package to the executors, for sessions that were not started with it on their Python path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers (once an application); returns the session."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _sent.add(sc.applicationId)
    return spark
