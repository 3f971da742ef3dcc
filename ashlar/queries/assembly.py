"""Prompt assembly and image maps over all questions and matches, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompt as P
from ..operators import conversation as C
from ..registry import oracle_view, query
from ..sources import base
from .retrieval import match_images
from .routing import classified
from .text import q

oracle_view("pairs_of", """WITH recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM messages WHERE role IN ('user', 'assistant')) WHERE back <= 8),
    paired AS (SELECT session_id, id, role, content AS answer, lag(role) OVER w AS before, lag(content) OVER w AS question FROM recent WINDOW w AS (PARTITION BY session_id ORDER BY id))
    SELECT session_id, id, question, answer FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS place FROM paired WHERE role = 'assistant' AND before = 'user') WHERE place <= 4""")


@query("intent_directive", "SELECT query_id, CASE intent " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in P.DIRECTIVES.items()) + " ELSE '' END AS value FROM classified")
def intent_directive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("query_id", P.directive(F.col("intent")).alias("value"))


@query("chat_messages", """SELECT s.id, 2 + 2 * coalesce(p.n, 0) AS turns, 'S|' || coalesce(p.said || '|', '') || 'CONTEXT:' || chr(10) || 'ctx' || chr(10) || chr(10) || 'QUESTION: q' || s.id AS said FROM sessions s
    LEFT JOIN (SELECT session_id, count(*) AS n, string_agg(question || '|' || answer, '|' ORDER BY id) AS said FROM pairs_of GROUP BY session_id) p ON p.session_id = s.id""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message list of a new question of every session, with its last pairs."""
    pairs = C.history_pairs(base.messages(spark, sf_dir)).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", "question", "answer"))).alias("history"))
    rows = base.sessions(spark, sf_dir).join(pairs, F.col("id") == F.col("session_id"), "left")
    history = F.coalesce("history", F.array().cast("array<struct<id:bigint,question:string,answer:string>>"))
    listed = rows.select("id", P.chat_messages(F.lit("S"), history, F.lit("ctx"), F.concat(F.lit("q"), F.col("id").cast("string"))).alias("m"))
    return listed.select("id", F.size("m").cast("long").alias("turns"), F.array_join(F.transform("m", lambda x: x.content), "|").alias("said"))


@query("signed_images", "SELECT query_id, string_agg('IMG_' || n || '=' || path || '?sig=' || md5(path), ',' ORDER BY n) AS value FROM (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS n FROM match_images) WHERE n <= 6 GROUP BY query_id")
def signed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image maps of all queries, signed by a stand-in."""
    numbered = match_images(spark, sf_dir).selectExpr("query_id", "path", "row_number() over (partition by query_id order by rank, pos) as n").where("n <= 6")
    maps = numbered.groupBy("query_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: F.struct(F.concat(F.lit("IMG_"), x.n.cast("string")), x.path))).alias("images"))
    sign = P.signed(F.col("images"), lambda url: F.concat(url, F.lit("?sig="), F.md5(url.cast("binary"))))
    return maps.select("query_id", F.array_join(F.transform(F.map_entries(sign), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("value"))
