"""Keyed tables that a stream keeps up to date: a batch rewrites only the buckets that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Buckets of a new table; a batch of few keys rewrites about so many parts of it.
BUCKETS = 64


class Upserts:
    """A table of the newest row of every key below ``path``, for ``foreachBatch(table.write)``.

    Rows lie in buckets by a hash of the key; ``rows/version=<batch>/bucket=<n>`` holds a
    bucket as of the last batch that touched it, and ``state/batch=<batch>`` says which
    version of each bucket counts. The state is written last, so that a batch that fails
    changes nothing, and a batch that is delivered again after it was written is
    passed over. A null key is a key; of rows of equal ``order`` the largest stays.
    """

    def __init__(self, path: str, key: str, order: str, deleted: str | None = None, buckets: int = BUCKETS):
        self.path, self.key, self.order, self.deleted, self.buckets = path.rstrip("/"), key, order, deleted, buckets

    def states(self, spark: SparkSession) -> DataFrame | None:
        """bucket and version of every batch."""
        try:
            return spark.read.schema("bucket int, version long, batch long").parquet(f"{self.path}/state")
        except AnalysisException:  # nothing has been written yet
            return None

    def versions(self, spark: SparkSession, batch: int | None = None) -> dict[int, int]:
        """Version of each bucket, after a batch (the last)."""
        states = self.states(spark)
        if states is None:
            return {}
        known = states.agg(F.max("batch")).first()[0] if batch is None else batch
        return {r.bucket: r.version for r in states.where(F.col("batch") == known).collect()}  # one row a bucket

    def rows(self, spark: SparkSession, schema, versions: dict[int, int]) -> DataFrame:
        """The rows of some buckets, each as of its version."""
        if not versions:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*(f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        states = self.states(spark)
        past = [r.batch for r in states.select("batch").distinct().collect()] if states is not None else []
        if batch_id in past:
            return
        before = self.versions(spark, max(past)) if past else {}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        batch = batch.persist()  # read twice: for its buckets and its rows
        try:
            touched = [r[0] for r in batch.select(bucket).distinct().collect()]
            old = self.rows(spark, batch.schema, {b: before[b] for b in touched if b in before})
            every = old.unionByName(batch)
            newest = every.groupBy(self.key).agg(F.max(F.struct(F.col(self.order).alias("_order"), F.struct(*batch.columns).alias("r"))).alias("m")).select("m.r.*")
            kept = newest if self.deleted is None else newest.where(~F.coalesce(F.col(self.deleted), F.lit(False)))
            kept.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={batch_id}")
            filled = [r[0] for r in spark.read.schema("bucket int").parquet(f"{self.path}/rows/version={batch_id}").select("bucket").distinct().collect()] if touched else []
        finally:
            batch.unpersist()
        after = {b: v for b, v in before.items() if b not in touched} | {b: batch_id for b in filled}
        spark.createDataFrame(list(after.items()) or [], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """The table as of the last batch."""
        return self.rows(spark, schema, self.versions(spark))

    def forget(self, spark: SparkSession, keep: int = 2) -> None:
        """Deletes the states before the last ``keep`` and the bucket versions that no kept state names."""
        states = self.states(spark)
        if states is None:
            return
        named = {(r.batch, r.version, r.bucket) for r in states.collect()}
        batches = sorted({b for b, _, _ in named})
        stay = set(batches[-keep:])
        used = {(v, b) for batch, v, b in named if batch in stay}
        folders = [f"state/batch={b}" for b in batches if b not in stay] + [f"rows/version={v}/bucket={b}" for v, b in sorted({(v, b) for _, v, b in named} - used)]
        for folder in folders:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
