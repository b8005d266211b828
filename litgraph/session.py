"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_litgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="litgraph-"), "litgraph_package.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(at)
    context._litgraph_shipped = True


#: Rows that go to a Python worker at once, unless the session says otherwise: whole texts are long, and 10,000 of them are in memory several
#: times over.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(BATCH_ROWS))
