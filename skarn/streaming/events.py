"""Event streams: windows with watermarks, and keyed state machines.

Every builder takes a DataFrame that may be streaming or not, so a query is tested in batch and run as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from skarn.sources.files import exists
from skarn.sources.shared import place
from skarn.sources.shipping import ship


def read(spark: SparkSession, sf_dir: str, files_at_once: int = 1) -> DataFrame:
    """events.parquet as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.parquet").format("parquet").load(f"{sf_dir}/events.parquet*")


def stamped(events: DataFrame, late: str | None = None) -> DataFrame:
    """ts as an instant, and a watermark where late is given."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late else out


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    return _counted(stamped(events, late), F.window("ts", size), "event_type")


def sliding(events: DataFrame, size: str = "1 day", step: str = "12 hours", late: str | None = None) -> DataFrame:
    return _counted(stamped(events, late), F.window("ts", size, step), "event_type")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    return _counted(stamped(events, late), F.session_window("ts", gap), "user_id")


def _counted(events: DataFrame, window, key: str) -> DataFrame:
    grouped = events.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """First copy of each event id; state is kept no longer than the watermark."""
    return stamped(events, late).dropDuplicatesWithinWatermark(["event_id"])


def drain(df: DataFrame, name: str, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there, and return its table, from the shared folder.

    Each batch is written as Parquet under its number, so a repeated batch replaces itself. In complete mode the last
    batch is the result, in append mode all are, in update mode the last row of each key.
    """
    spark = df.sparkSession
    root = place(spark, f"stream-{name}")
    running = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{root}/rows/batch={i}")).start()
    running.awaitTermination()
    if not exists(spark, f"{root}/rows"):
        return spark.createDataFrame([], df.schema)
    every = spark.read.schema(StructType([*df.schema, StructField("batch", LongType())])).parquet(f"{root}/rows")
    if mode == "append":
        return every.drop("batch")
    if mode == "complete":
        return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")
    return every.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "batch").alias("x")).select(*keys, "x.*")


class Budget(StatefulProcessor):
    """Reserve each amount against a cap for each key; what does not fit is refused and not charged."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", StructType([StructField("cents", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        spent = self.spent.get()[0] if self.spent.exists() else 0
        for part in rows:
            out = []
            for event_id, cents in part.sort_values("event_id")[["event_id", "cents"]].itertuples(index=False):
                taken = spent + int(cents) <= self.cap
                spent += int(cents) if taken else 0
                out.append((key[0], event_id, spent, taken))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "spent", "taken"])
        self.spent.update((spent,))

    def close(self) -> None:
        pass


BUDGET_SCHEMA = StructType([StructField("user_id", LongType()), StructField("event_id", LongType()), StructField("spent", LongType()), StructField("taken", BooleanType())])
PHASES = ("response_received", "ready_for_next_request", "answer_ready", "answer_validated")


def budgets(events: DataFrame, cap: int) -> DataFrame:
    """Streaming reservations by user. Needs the RocksDB state store."""
    ship(events.sparkSession)
    cents = events.select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return cents.groupBy("user_id").transformWithStateInPandas(Budget(cap), BUDGET_SCHEMA, "append", "none")


def phases(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A session steps through its phases, one a row, and stays in the last; state survives restarts."""
    step = state.get[0] if state.exists else -1
    seen = 0
    for part in rows:
        seen += len(part)
    step = min(step + seen, len(PHASES) - 1)
    state.update((step,))
    yield pd.DataFrame({"user_id": [key[0]], "phase": [PHASES[step]]})


def session_phases(events: DataFrame) -> DataFrame:
    ship(events.sparkSession)
    return events.groupBy("user_id").applyInPandasWithState(phases, "user_id long, phase string", "step int", "update", "NoTimeout")


def expired(files: DataFrame, days: int, now: str) -> DataFrame:
    """Paths of files (path, modificationTime) older than so many days."""
    return files.where(F.col("modificationTime") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))).select("path")
