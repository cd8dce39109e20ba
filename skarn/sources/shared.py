"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where that is unset and Spark is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="skarn-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # where the session ended first, the folder's owner clears it
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is removed when Python exits."""
    path = f"{shared_root(spark)}/skarn/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here, and a lost executor costs nothing."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
