"""Admission of uploads: which files are taken, and under which name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an upload ends in, and the most bytes it may have.
ENDING = ".pdf"
MOST_BYTES = 200 * 1024 * 1024


def verdict(name: Column, size: Column, most: int = MOST_BYTES) -> Column:
    """'not a pdf', 'empty', 'too large' or 'accepted', the first that holds; a null name or size is none."""
    wrong = ~F.coalesce(F.lower(name).endswith(ENDING), F.lit(False))
    return F.when(wrong, "not a pdf").when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > most, "too large").otherwise("accepted")


def stamped(file: Column, at: Column) -> Column:
    """The file's name with a time before its ending."""
    return F.concat(F.regexp_replace(file, r"(?s)(?<=.)\.[^.]*\z", ""), F.date_format(at, "_yyyyMMdd_HHmmss"))


def admitted(uploads: DataFrame, listing: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """upload_id, verdict and file (null if refused) of ``uploads(upload_id, name, bytes, at)`` beside the files of ``listing(name)``.

    Folders before a name are dropped. The first upload of a name (by time, then id)
    keeps it if the listing lacks it; the others get their time into it, and their
    id as well if that name is taken: by the listing, by a name kept, or by an earlier
    upload of the same second. A null time is the beginning of 1970. Names are met through
    their first upload in each second, so a name that most uploads share adds one
    row a second to the joins, and no window holds a name's uploads.
    """
    judged = uploads.select("upload_id", F.substring_index("name", "/", -1).alias("plain"), F.coalesce("at", F.timestamp_seconds(F.lit(0))).alias("at"), verdict(F.col("name"), F.col("bytes"), most).alias("verdict"))
    kept = judged.where("verdict = 'accepted'").withColumn("second", F.date_trunc("second", "at")).withColumn("own", F.struct("at", "upload_id"))
    there = listing.select(F.col("name").alias("plain")).dropna().distinct()
    seconds = kept.groupBy("plain", "second").agg(F.min("own").alias("first"))
    begun = seconds.groupBy("plain").agg(F.min("first").alias("begun")).join(there.withColumn("listed", F.lit(True)), "plain", "left")
    named = seconds.join(begun, "plain").withColumn("stamp", stamped(F.col("plain"), F.col("second")))
    lead = named.groupBy("stamp").agg(F.min("first").alias("lead"))  # names that differ in their ending's case get the same stamp
    taken = there.unionByName(begun.select("plain")).distinct().select(F.col("plain").alias("full"), F.lit(True).alias("taken"))
    facts = named.join(lead, "stamp").withColumn("full", F.concat("stamp", F.lit(ENDING))).join(taken, "full", "left").select("plain", "second", "lead", "begun", "listed", "stamp", "taken")
    met = kept.join(facts, ["plain", "second"])
    alone = F.col("taken").isNull() & (F.col("own") == F.col("lead"))
    file = F.when(F.col("listed").isNull() & (F.col("own") == F.col("begun")), F.col("plain")).when(alone, F.concat("stamp", F.lit(ENDING))).otherwise(F.concat("stamp", F.lit("_"), "upload_id", F.lit(ENDING)))
    return met.select("upload_id", "verdict", file.alias("file")).unionByName(judged.where("verdict <> 'accepted'").select("upload_id", "verdict", F.lit(None).cast("string").alias("file")))
