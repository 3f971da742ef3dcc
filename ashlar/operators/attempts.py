"""Calls that are tried again: how long each failed attempt waits, and how its call ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Attempts of a call, milliseconds between them, what is added to a wait that the service names, and how it names one.
ATTEMPTS = 5
DELAY_MS = 3000
SPARE_MS = 1000
NAMED_WAIT = r"try again in ([0-9]+(?:\.[0-9]+)?)(ms|s)"


def wait_ms(error: Column, attempt: Column) -> Column:
    """Milliseconds to wait after a failure: as named by a rate limit, else longer with each attempt there; a fixed delay after other errors.

    A named wait beyond a long is none.
    """
    limited = error.contains("429") | F.lower(error).contains("rate_limit")
    named = F.regexp_extract(error, NAMED_WAIT, 1).try_cast("double") * F.when(F.regexp_extract(error, NAMED_WAIT, 2) == "ms", 1).otherwise(1000)
    return F.when(limited, F.coalesce(F.round(named + SPARE_MS).try_cast("long"), DELAY_MS * attempt)).otherwise(F.lit(DELAY_MS)).cast("long")


def schedule(attempts: DataFrame) -> DataFrame:
    """call_id, attempt, outcome, wait_ms and begins_ms of ``attempts(call_id, attempt, took_ms, error)``.

    An attempt without an error is 'done', the last one with an error 'raised', an
    earlier one 'waits'; what stands behind the call's end is 'unused' and begins
    never. Attempts count from 1 to ``ATTEMPTS``: other numbers and nulls are no
    attempts. A repeated number is one attempt, its fastest row (ties: success,
    then the smaller error). A call holds at most ``ATTEMPTS`` rows before anything
    is shuffled by call, however often it is listed. A null time took none.
    """
    row = F.struct(F.coalesce(F.col("took_ms"), F.lit(0)).cast("long").alias("took_ms"), "error")
    tried = attempts.where(F.col("attempt").between(1, ATTEMPTS)).groupBy("call_id", "attempt").agg(F.min(row).alias("r")).select("call_id", "attempt", "r.*")
    order = W.partitionBy("call_id").orderBy("attempt")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    over = F.coalesce(F.bool_or(F.col("error").isNull()).over(before), F.lit(False))
    outcome = F.when(over, "unused").when(F.col("error").isNull(), "done").when(F.col("attempt") == ATTEMPTS, "raised").otherwise("waits")
    waiting = tried.withColumn("outcome", outcome).withColumn("wait_ms", F.when(F.col("outcome") == "waits", wait_ms(F.col("error"), F.col("attempt"))).otherwise(F.lit(0).cast("long")))
    begins = F.coalesce(F.sum(F.col("took_ms") + F.col("wait_ms")).over(before), F.lit(0).cast("long"))
    return waiting.select("call_id", "attempt", "outcome", "wait_ms", F.when(F.col("outcome") != "unused", begins).alias("begins_ms"), "took_ms")


def calls(scheduled: DataFrame) -> DataFrame:
    """call_id, attempts made, outcome of the last of them, milliseconds waited and milliseconds in all of every call of ``schedule``."""
    made = scheduled.where("outcome <> 'unused'")
    last = F.max_by(F.struct("outcome", (F.col("begins_ms") + F.col("took_ms") + F.col("wait_ms")).alias("total_ms")), "attempt")
    return made.groupBy("call_id").agg(F.count("*").alias("attempts"), last.alias("l"), F.sum("wait_ms").alias("waited_ms")).select("call_id", "attempts", "l.outcome", "waited_ms", "l.total_ms")
