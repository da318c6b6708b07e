"""Give executors this package: workers on other machines don't see the driver's Python path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Add a zip of the package to the session's Python files, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="ticksmith-")) / "ticksmith.zip"
        with zipfile.ZipFile(path, "w") as z:
            for source in sorted(top.rglob("*.py")):
                z.write(source, source.relative_to(top.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark
