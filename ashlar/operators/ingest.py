"""Ingest operators: images, uploads, resume, job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import counted


def remaining(records: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose (id, content) is not in the progress set."""
    return records.join(done.select(*keys), keys, "left_anti")


def upload_plan(files: DataFrame, existing: DataFrame, limit: int) -> DataFrame:
    """Files with their outcome: skipped if present, uploaded up to a global limit in key order, else left."""
    marked = files.join(existing.select("key").distinct().withColumn("_there", F.lit(True)), "key", "left")
    new = F.col("_there").isNull()
    placed = counted(marked, F.col("key"), [], new, "_rank")
    return placed.select("key", F.when(~new, "skipped").when(F.col("_rank") <= limit, "uploaded").otherwise("left").alias("outcome"))


def image_targets(images: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk of each image on its page: a table with its title, else a section with its title, else the first chunk.

    ``images(image_id, page, title)`` and ``chunks(chunk_id, page, pos, kind,
    section, labels)`` with normalised titles, sections and labels.
    """
    met = images.join(chunks, "page")
    blank = F.col("title") == ""
    rank = F.when(~blank & (F.col("kind") == "table") & F.array_contains("labels", F.col("title")), 1).when(~blank & (F.col("section") == F.col("title")), 2).otherwise(3)
    best = F.row_number().over(W.partitionBy("image_id").orderBy(rank, "pos"))
    return met.withColumn("match_class", rank).withColumn("_n", best).where("_n = 1").select("image_id", "chunk_id", "match_class")


def attached(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Chunks with their images' ids in manifest order."""
    held = images.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "image_id"))).alias("_i"))
    return chunks.join(held, "chunk_id", "left").select(*chunks.columns, F.coalesce(F.transform("_i", lambda x: x.image_id), F.array().cast("array<bigint>")).alias("images"))


def recurring_decorations(images: DataFrame, pages: int = 3, side: float = 80.0) -> DataFrame:
    """Hashes on more than some pages whose largest side stays small."""
    return images.groupBy("hash").agg(F.count_distinct("page").alias("pages"), F.max(F.greatest("width", "height")).alias("side")).where((F.col("pages") > pages) & (F.col("side") < side))


def overlap_area(a: str, b: str) -> Column:
    w = F.greatest(F.lit(0.0), F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0"))
    h = F.greatest(F.lit(0.0), F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0"))
    return w * h


def rect_overlaps(rects: DataFrame, others: DataFrame, ratio: float) -> DataFrame:
    """Pairs of a page whose intersection covers more than a share of the first rectangle."""
    a, b = rects.alias("a"), others.alias("b")
    met = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("b.x1") > F.col("a.x0")) & (F.col("b.y0") < F.col("a.y1")) & (F.col("b.y1") > F.col("a.y0")))
    area = (F.col("a.x1") - F.col("a.x0")) * (F.col("a.y1") - F.col("a.y0"))
    return met.withColumn("share", F.try_divide(overlap_area("a", "b"), area)).where(F.col("share") > ratio).select(F.col("a.id").alias("id"), F.col("b.id").alias("other_id"), F.round("share", 6).alias("share"))


def nearest_captions(images: DataFrame, texts: DataFrame, gap: float = 60.0, share: float = 0.2) -> DataFrame:
    """Each image's caption: a text above it, else below, within a gap, with enough horizontal overlap, the nearest first."""
    i, t = images.alias("i"), texts.alias("t")
    met = i.join(t, F.col("i.page") == F.col("t.page"))
    across = F.least("i.x1", "t.x1") - F.greatest("i.x0", "t.x0")
    wide = F.least(F.col("i.x1") - F.col("i.x0"), F.col("t.x1") - F.col("t.x0"))
    above, below = F.col("i.y0") - F.col("t.y1"), F.col("t.y0") - F.col("i.y1")
    side = F.when(above.between(0, gap), 0).when(below.between(0, gap), 1)
    away = F.when(above.between(0, gap), above).otherwise(below)
    near = met.where(side.isNotNull() & (across >= share * wide)).select(F.col("i.id").alias("id"), F.col("t.id").alias("text_id"), side.alias("side"), away.alias("gap"))
    return near.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("side", "gap", "text_id"))).where("_n = 1").drop("_n")


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order (ring buffers, retention)."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def job_summary(stages: DataFrame) -> DataFrame:
    """Elapsed time and status of each job: an error only if a critical stage failed."""
    elapsed = F.when((F.col("started") > 0) & (F.col("ended") > 0), F.col("ended") - F.col("started")).otherwise(F.lit(0))
    failed = F.bool_or((F.col("status") == "error") & F.col("critical"))
    return stages.groupBy("job_id").agg(F.sum(elapsed).alias("elapsed"), F.when(failed, "error").otherwise("done").alias("status"))


def duration_text(ms: Column) -> Column:
    """``850ms``, ``12.5s`` or ``3m 4s``."""
    seconds = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(seconds.cast("string"), F.lit("."), F.floor((ms % 1000) / 100).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))
    )


def stage_states(stages: DataFrame) -> DataFrame:
    """job_id, pos and state of ``stages(job_id, pos, status, critical)``: pending behind a critical failure, else as it is."""
    before = W.partitionBy("job_id").orderBy("pos").rangeBetween(W.unboundedPreceding, -1)
    failed = F.coalesce(F.bool_or((F.col("status") == "error") & F.col("critical")).over(before), F.lit(False))
    return stages.select("job_id", "pos", F.when(failed, F.lit("pending")).otherwise(F.col("status")).alias("status"))
