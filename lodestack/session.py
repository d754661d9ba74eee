"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What every operator relies on. ANSI keeps a bad cast an error, UTC keeps timestamps comparable with
#: engines that have no zone, and adaptive execution splits skewed joins and merges small partitions.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "lodestack", cores: str = "8", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = SETTINGS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work that takes far longer than its reading: a scan of fewer parts than there are cores, whatever its size,
    is dealt to all cores, as few files or files of one row group cannot be read in more parts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = int(df._jdf.queryExecution().toRdd().getNumPartitions())
    return df.repartition(cores) if parts < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own setting. Where it is unset, a session on one machine (tests, benchmarks)
    gets a temporary one; on a cluster that is an error, as no folder of one machine is seen by all."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestack-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once, writes it to the shared checkpoint folder and reads it from there.

    Used where a result is read more than once or by a loop; unlike a local checkpoint or a cache it
    outlives the executors that computed it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
