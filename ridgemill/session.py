"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the session's Python workers, once per
    application, so that functions of its modules can run there."""
    if spark.sparkContext.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(spark.sparkContext.applicationId)
    return spark
