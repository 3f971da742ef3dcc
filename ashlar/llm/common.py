"""Inputs, shared tables and bounded samples for the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch (a longer text is a batch of its own): bounds of a Python worker's memory with whole texts.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Texts, and their characters, that are handled at a time where words are looked up.
GROUP_TEXTS = 100
GROUP_CHARS = 1 << 20


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker holds few whole texts at a time.

    These are settings of the session, which the caller's later queries share.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def byte_groups(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column in short lists; a very long text is a list of its own."""
    group: list[str | None] = []
    chars = 0
    for text in column.to_pylist():
        size = len(text or "")
        if group and (len(group) >= GROUP_TEXTS or chars + size > GROUP_CHARS):
            yield group
            group, chars = [], 0
        group.append(text)
        chars += size
    if group:
        yield group


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="ashlar-shared-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, lost executors cost nothing.

    The files go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ashlar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session has ended: nothing is left to ask  # noqa: BLE001
        pass


def crc_rest(key: str, modulus: int) -> Column:
    """Remainder of the CRC-32 of the key's text; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus))


def is_held(key: str, modulus: int, rest: int) -> Column:
    """Whether a row is held out; false for a null key, which is not learned from either."""
    return F.coalesce(crc_rest(key, modulus) == rest, F.lit(False))


def sampled(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of the key alone; all if there are no more."""
    if total <= rows:
        return df
    share = int((1 << 30) * rows / total)
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < share)


def one_text(df: DataFrame) -> DataFrame:
    """One row of each distinct value of the other columns, with the text of the smallest hash; combined before the shuffle."""
    return df.groupBy(*(c for c in df.columns if c != "text")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
