"""Sessions, and the package on executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}
#: Rows in one Arrow batch; documents can be long, so the default of 10,000 is too many.
BATCH_ROWS = 1000
#: Bytes of one Arrow batch, about; a row is never cut.
BATCH_BYTES = 8 << 20


def session(name: str = "brambling", **settings: str) -> SparkSession:
    """A session with the settings that exact results rely on; others are the caller's."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in executors' Python workers, once for each context."""
    context = spark.sparkContext
    if not getattr(context, "_brambling_shipped", False):
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
            for path in sorted(root.rglob("*.py")):
                bundle.write(path, str(path.relative_to(root.parent)))
        context.addPyFile(target)
        context._brambling_shipped = True
    return spark


def batched(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small; smaller limits of the caller stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))
    return spark
