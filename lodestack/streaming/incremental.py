"""New release files as a stream that stops when there is nothing new; later snapshots of a period win."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators.relations import latest_snapshot_per_period


def release_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Parquet files that appear under ``folder``, with the file each row is from."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(folder)
    return rows.withColumn("_file", F.input_file_name())


def append_new(spark: SparkSession, folder: str, schema: T.StructType, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new since the last run, exactly once: the checkpoint knows the files, the sink its batches."""
    stream = release_stream(spark, folder, schema)
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current_periods(spark: SparkSession, table: str, release: str, start: str, end: str) -> DataFrame:
    """What holds now: of each period the last snapshot, however late an earlier one arrived."""
    return latest_snapshot_per_period(spark.read.parquet(table), release, start, end)


def counts_by_window(spark: SparkSession, folder: str, schema: T.StructType, time: str, kind: str, late: str, window: str) -> DataFrame:
    """Events per kind and time window, for a sink in append mode; rows later than ``late`` behind the newest are dropped."""
    rows = release_stream(spark, folder, schema).withWatermark(time, late)
    grouped = rows.groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), kind, "n")
