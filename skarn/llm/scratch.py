"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing a table there and reading it back: unlike cached or locally checkpointed
blocks, such a table is still there after an executor is lost.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from skarn.sources.shared import shared_root
from skarn.sources.shipping import ship, small_batches

ROW_GROUP = 16 << 20  # a writer holds one of these a task
_open: list[list[Scratch]] = []


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # the session ended first; the folder's owner clears it
        pass


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Removes, at its end, the folders of all operators that are called inside. Their results must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for x in _open.pop():
            x.close()


class Scratch:
    """A folder of intermediate tables for one call of an operator.

    It is removed by `close`, at the end of a `released` block, or when Python exits, whichever is first; single tables
    that no later step reads are removed by `drop`.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/skarn/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove_quietly, spark, self.root)
        if _open:
            _open[-1].append(self)

    @classmethod
    def apart(cls, spark: SparkSession, name: str) -> Scratch:
        """A folder that outlives the innermost `released` block; it belongs to the next one outside."""
        inner = _open.pop() if _open else None
        try:
            return cls(spark, name)
        finally:
            if inner is not None:
                _open.append(inner)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df now and return what was written."""
        path = self.path(name)
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            remove(self.spark, self.path(name))

    def close(self) -> None:
        """Remove the folder."""
        _remove_quietly(self.spark, self.root)
