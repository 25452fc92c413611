"""Runs as they are appended: a stream of run records that keeps summaries fresh, and windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textloom.operators.aggregates import condition_summary
from textloom.operators.runs import RUN_RECORD, run_frame
from textloom.sources.scratch import remove, whole_folders

#: Versions of a result that stay beside the newest, for readers that have begun.
KEPT = 2


def stream_runs(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Appended JSON lines of nested runs."""
    return spark.readStream.schema(StructType.fromDDL(RUN_RECORD)).option("maxFilesPerTrigger", files_a_batch).json(folder)


def refresh_summary(runs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the condition summary of all runs of a stream in ``target``; ``latest`` reads it.

    Sums and counts of each group are the state of the stream, as are the keys of the runs seen: a batch reads its own rows only, a run that
    comes again, in a file of any name, counts once, and one that comes late counts like any other. After a restart the stream goes on from ``checkpoint``;
    a batch that was cut off is done again and writes the same version, so nothing counts twice. Keys take state in proportion to the runs
    (``spark.sql.streaming.stateStore.providerClass`` can put it on disk)."""
    summary = condition_summary(run_frame(runs.dropDuplicates(["run_key"])))
    return _versions(summary, target, checkpoint)


def _versions(result: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    spark = result.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={number:012}")
        for old in _numbers(spark, target)[: -1 - KEPT]:
            remove(spark, f"{target}/version={old:012}")

    return result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbers(spark: SparkSession, target: str) -> list[int]:
    """The versions that are whole, oldest first."""
    return [int(n.removeprefix("version=")) for n in whole_folders(spark, target, "version=")]


def latest(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest whole version of a result, or None. A version is never written over, so a reader keeps what it began with."""
    numbers = _numbers(spark, target)
    return spark.read.parquet(f"{target}/version={numbers[-1]:012}") if numbers else None


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and their mean value by time window and event type; events later than ``late`` are dropped from closed windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def refresh_windows(events: DataFrame, target: str, checkpoint: str, window: str = "1 hour") -> StreamingQuery:
    """Keep ``event_windows`` of a stream of events in ``target``. All windows stay open, so late events count."""
    return _versions(event_windows(events, window), target, checkpoint)
