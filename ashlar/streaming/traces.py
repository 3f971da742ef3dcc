"""Traces of requests and of stages: streams of rows that become blocks of text, once each, in folders by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions.text import squash
from ..operators.ingest import duration_text

#: How long a request may be replayed, or its rows be late.
DELAY = "1 hour"
#: Code points of a chunk that a trace shows (the chunk itself is in the index).
PREVIEW = 240

REQUEST = (
    "request_id long, at timestamp, user string, class string, question string, search string, filter string, top_k int, timings_ms map<string, long>, steps array<string>, "
    "matches array<struct<score: double, source: string, page: long, section: string, text: string>>, images map<string, string>, answer string, unsupported array<struct<kind: string, value: string>>"
)
STAGE = "event_id long, at timestamp, job_id long, stage string, status string, elapsed_ms long, detail string"
LOG = "id string, at timestamp, block string, day date"
MARKS = {"running": "START", "done": "DONE", "skipped": "SKIP", "error": "ERROR"}


def _or(value: Column, other: str = "-") -> Column:
    return F.coalesce(value.cast("string"), F.lit(other))


def _listed(items: Column, show) -> Column:
    """One text for each item of an array, which may be null."""
    return F.coalesce(F.transform(items, show), F.array().cast("array<string>"))


def preview(text: Column) -> Column:
    """The beginning of a text in one line."""
    line = F.trim(squash(F.coalesce(text, F.lit(""))))
    return F.when(F.length(line) > PREVIEW, F.concat(F.left(line, F.lit(PREVIEW)), F.lit("…"))).otherwise(line)


def request_block() -> Column:
    """The block of a row of ``REQUEST``: header, question, search if it differs, filter, times, steps, chunks, images by number, answer, grounding.

    Parts that are null or empty are left out, but for the question, the chunks' count and the answer.
    """
    c = F.col
    head = F.concat(F.lit("["), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] user="), _or(c("user")), F.lit(" class="), _or(c("class")))
    search = F.when(F.trim("search") != F.trim(_or(c("question"), "")), F.concat(F.lit("search: "), "search"))
    wanted = F.when(c("filter").isNotNull() | c("top_k").isNotNull(), F.concat(F.lit("filter: "), _or(c("filter")), F.lit(" top_k: "), _or(c("top_k"))))
    times = F.array_join(_listed(F.array_sort(F.map_entries("timings_ms")), lambda x: F.concat(x.key, F.lit("="), _or(x.value), F.lit("ms"))), " ")
    steps = _listed(c("steps"), lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), _or(x)))
    score = lambda x: F.coalesce(F.format_string("%.4f", x.score), F.lit("-"))
    chunk = lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.when(x.score.isNotNull(), score(x)).otherwise("-"), F.lit(" "), _or(x.source), F.lit(" p."), _or(x.page), F.lit(" "), _or(x.section), F.lit("\n     "), preview(x.text))
    number = lambda x: F.regexp_extract(x.key, r"([0-9]+)$", 1).try_cast("long")
    images = F.array_sort(F.transform(F.map_entries("images"), lambda x: F.struct(number(x).alias("n"), x.key.alias("key"), x.value.alias("value"))))
    shown = _listed(images, lambda x: F.concat(F.lit("  "), x.key, F.lit(" = "), _or(x.value)))
    bad = _listed(c("unsupported"), lambda x: F.concat(F.lit("  ! "), _or(x.kind), F.lit(": "), _or(x.value)))
    grounding = F.when(c("unsupported").isNotNull(), F.when(F.size("unsupported") == 0, "grounding: OK").otherwise("grounding: FLAGGED"))
    some = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(title + "\n"), F.array_join(items, "\n")))
    chunks = _listed(c("matches"), chunk)
    parts = [
        head, F.concat(F.lit("Q: "), _or(c("question"), "")), search, wanted, F.when(times != "", F.concat(F.lit("times: "), times)), some("steps:", steps),
        F.concat(F.lit("chunks: "), F.size(chunks).cast("string")), F.when(F.size(chunks) > 0, F.array_join(chunks, "\n")), some("images:", shown),
        F.concat(F.lit("answer:\n"), F.rtrim(_or(c("answer"), ""))), grounding, F.when(F.size(bad) > 0, F.array_join(bad, "\n")),
    ]
    return F.concat_ws("\n", *parts)


def stage_block() -> Column:
    """The block of a row of ``STAGE``: its mark (the status in capitals, if none is fixed), stage, time taken and job; each line of its detail below."""
    mark = F.coalesce(*[F.when(F.col("status") == k, F.lit(v)) for k, v in MARKS.items()], F.upper(_or(F.col("status"))))
    took = F.when(F.col("elapsed_ms") > 0, F.concat(F.lit(" ("), duration_text(F.col("elapsed_ms")), F.lit(")")))
    line = F.concat(F.lit("["), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), mark, F.lit(" "), _or(F.col("stage")), F.coalesce(took, F.lit("")), F.lit(" (job="), _or(F.col("job_id")), F.lit(")"))
    below = F.when(F.col("detail") != "", F.regexp_replace(F.col("detail"), "(?m)^", "    "))
    return F.concat_ws("\n", line, below)


def request_log(requests: DataFrame) -> DataFrame:
    """id, at, block and day of requests, of a stream or a table."""
    return _logged(requests, "request_id", request_block())


def stage_log(events: DataFrame) -> DataFrame:
    """id, at, block and day of events of stages, of a stream or a table."""
    return _logged(events, "event_id", stage_block())


def _logged(rows: DataFrame, key: str, block: Column) -> DataFrame:
    """A row without a time is no trace; one without an id is known by its block."""
    made = rows.where("at is not null").select(F.col(key).alias("_id"), "at", block.alias("block"))
    return made.select(F.coalesce(F.col("_id").cast("string"), F.sha2("block", 256)).alias("id"), "at", "block", F.to_date("at").alias("day"))


def once(log: DataFrame, delay: str = DELAY) -> DataFrame:
    """A stream's log with each id once, however often it comes within ``delay``; later replays are behind the watermark if they keep their time, and dropped."""
    return log.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def append(log: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The writer of a log below ``path``, a folder for each day; its files count once they are committed, so that a restart adds nothing twice."""
    return log.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def read(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The log of some days (both included); other days' folders are not read."""
    log = spark.read.schema(LOG).parquet(path)
    return log.where((F.col("day") >= F.lit(first).cast("date") if first else F.lit(True)) & (F.col("day") <= F.lit(last).cast("date") if last else F.lit(True)))
