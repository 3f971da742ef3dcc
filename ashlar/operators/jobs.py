"""Commands to jobs: cancel, retry and delete, as they take effect one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")


def obeyed(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """command_id, job_id, action, outcome and new_id of ``commands(command_id, job_id, action, at_ms)`` to ``jobs(job_id, status, file)``.

    In order of time, then id: a cancel ends an active job ('cancelled') and is else
    'nothing to cancel'; a delete is 'refused' while the job is active, else 'deleted';
    a retry makes a queued job of the same file ('queued'), named by the job and the
    command; behind a delete, and for jobs that are not there, all is 'unknown', as
    is any other action. What a job's commands do follows from its first cancel and
    the first delete that is obeyed, two aggregates, so that no task holds a job's
    commands. A repeated job is one, of its smallest status; a null time is the first.
    """
    known = jobs.where("job_id is not null").groupBy("job_id").agg(F.min(F.struct(F.coalesce("status", F.lit("")).alias("status"), "file")).alias("j")).select("job_id", "j.status", F.lit(True).alias("there"))
    given = commands.select("command_id", "job_id", "action", F.struct(F.coalesce("at_ms", F.lit(-(1 << 63)).cast("long")).alias("at_ms"), "command_id").alias("own"))
    cancels = given.where("action = 'cancel'").groupBy("job_id").agg(F.min("own").alias("cancel"))
    states = known.join(cancels, "job_id", "left").withColumn("active", F.col("status").isin(*ACTIVE))
    ended = ~F.col("active") | F.coalesce(F.col("own") > F.col("cancel"), F.lit(False))
    deletes = given.where("action = 'delete'").join(states, "job_id").where(ended).groupBy("job_id").agg(F.min("own").alias("delete"))
    met = given.join(states.join(deletes, "job_id", "left"), "job_id", "left")
    gone = F.col("there").isNull() | F.coalesce(F.col("own") > F.col("delete"), F.lit(False))
    outcome = (
        F.when(gone, "unknown")
        .when(F.col("action") == "cancel", F.when(F.col("active") & (F.col("own") == F.col("cancel")), "cancelled").otherwise("nothing to cancel"))
        .when(F.col("action") == "delete", F.when(ended, "deleted").otherwise("refused"))
        .when(F.col("action") == "retry", "queued")
        .otherwise("unknown")
    )
    told = met.select("command_id", "job_id", "action", outcome.alias("outcome"))
    return told.withColumn("new_id", F.when(F.col("outcome") == "queued", F.concat_ws("-", F.col("job_id").cast("string"), F.lit("r"), F.col("command_id").cast("string"))))


def after(jobs: DataFrame, told: DataFrame) -> DataFrame:
    """job_id (as text), status and file of the jobs that are there when all commands were obeyed; ``told`` is what ``obeyed`` says."""
    ends = told.where("outcome in ('cancelled', 'deleted')").groupBy("job_id").agg(F.bool_or(F.col("outcome") == "deleted").alias("deleted"))
    held = jobs.where("job_id is not null").groupBy("job_id").agg(F.min(F.struct(F.coalesce("status", F.lit("")).alias("status"), "file")).alias("j")).select("job_id", "j.*")
    old = held.join(ends, "job_id", "left").where("not coalesce(deleted, false)").select(F.col("job_id").cast("string").alias("job_id"), F.when(F.col("deleted").isNotNull(), "cancelled").otherwise(F.col("status")).alias("status"), "file")
    new = told.where("outcome = 'queued'").join(held.select("job_id", "file"), "job_id").select(F.col("new_id").alias("job_id"), F.lit("queued").alias("status"), "file")
    return old.unionByName(new)
