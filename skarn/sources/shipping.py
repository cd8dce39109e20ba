"""The package on executors that have no copy of it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a Spark context; Python functions of it can then be read there."""
    context = spark.sparkContext
    if getattr(context, "_skarn_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="skarn-code-"), "skarn.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for x in names:
                if x.endswith(".py"):
                    out.write(os.path.join(folder, x), os.path.relpath(os.path.join(folder, x), os.path.dirname(top)))
    context.addPyFile(path)
    context._skarn_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a few hundred at a time, so a batch stays small on both sides; a smaller setting is left alone."""
    if int(spark.conf.get(_BATCH)) <= 0 or int(spark.conf.get(_BATCH)) > ROWS:
        spark.conf.set(_BATCH, str(ROWS))
