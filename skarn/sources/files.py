"""Readers and writers of files with fixed schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One document a file; a field of another type is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with a header; one that does not exist is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns; lists, structs and maps as JSON."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType)) else F.col(c) for c in columns]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def replace(df: DataFrame, path: str) -> None:
    """Write df beside path and put it in its place once it is whole; what was there stays until then."""
    spark = df.sparkSession
    aside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(at(aside), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"cannot put a table at {path}")
    if had:
        fs.delete(at(old), True)


def write_entities(entities: dict[str, DataFrame], root: str) -> None:
    """A Parquet table for each entity; each replaces what was there once it is whole."""
    for name, df in entities.items():
        replace(df, f"{root}/{name}")


def load_or_create(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; where there is none, make() is written there first."""
    if not exists(spark, path):
        replace(make(), path)
    return spark.read.parquet(path)


def conform(df: DataFrame, contract: StructType) -> DataFrame:
    """Columns in the contract's order and types; missing ones are null, others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in contract])


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that break a rule (name: SQL condition), with the names of the rules that they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """path, content of files whose digest is the one expected."""
    return spark.read.format("binaryFile").load(path).where(F.sha2("content", 256) == sha256.lower()).select("path", "content")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the last by order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("x")).select("x.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new, and the rows of old whose key it does not have."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))
