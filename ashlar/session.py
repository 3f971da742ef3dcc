"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "ashlar", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows or 16 MB, so that a worker holds few whole rasters at a time.

    These are settings of the session, which the caller's later queries share.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder: lineage ends there, and lost executors cost nothing.

    The folder is the session's; one of our own only where none is set and all run on this machine.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="ashlar-checkpoints-"))
    return df.checkpoint()
