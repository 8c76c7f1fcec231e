"""Making this package known to Python workers on other machines."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors, once per application, through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parent
        packed = Path(tempfile.mkdtemp(prefix="lamella-code-")) / "lamella.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, str(f.relative_to(top.parent)))
        spark.sparkContext.addPyFile(str(packed))
        _SHIPPED.add(app)
    return spark
