"""Conversation store operators: analytics, histories, hand-offs, learned answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import no_answer_sql

DAY_MS = 86_400_000


def flagged(messages: DataFrame) -> DataFrame:
    """Messages with ``no_answer``, computed once for all aggregates over them."""
    return messages.withColumn("no_answer", (F.col("role") == "assistant") & no_answer_sql(F.col("content")))


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("role") == "user").alias("questions"),
        F.count_if((F.col("role") == "assistant") & ~F.col("no_answer")).alias("answered"),
        F.count_if(F.col("no_answer")).alias("unanswered"),
    ]


def overview(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Totals in one row; the session count is a scalar subquery of its own."""
    totals = flagged(messages).agg(*_counts()).select(F.col("questions").alias("total_questions"), "answered", "unanswered")
    return totals.withColumn("total_sessions", sessions.agg(F.count_distinct("id")).scalar())


def daily(messages: DataFrame, since_ms: int) -> DataFrame:
    day = F.date_format(F.timestamp_millis("created_at"), "yyyy-MM-dd")
    return flagged(messages).where(F.col("created_at") >= since_ms).groupBy(day.alias("day")).agg(*_counts())


def unanswered(messages: DataFrame, limit: int = 30) -> DataFrame:
    """The latest replies without an answer, each with the question before it (as-of, one shuffle by session)."""
    before = "last_value(if(role = 'user', content, null), true) over (partition by session_id order by id rows between unbounded preceding and 1 preceding)"
    asked = "max(if(role = 'user', 1, 0)) over (partition by session_id order by id rows between unbounded preceding and 1 preceding)"
    rows = flagged(messages).selectExpr("id", "session_id", "created_at", "no_answer", f"{before} as question", f"{asked} as asked").where("no_answer")
    latest = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return latest.where("asked = 1").select("question", "session_id", "created_at")


def history_pairs(messages: DataFrame, pairs: int = 4) -> DataFrame:
    """The last answered question pairs of each session, out of its last ``2 * pairs`` user and assistant rows."""
    said = messages.where("role in ('user', 'assistant')")
    recent = said.selectExpr("session_id", "id", "role", "content", "row_number() over (partition by session_id order by id desc) as back").where(F.col("back") <= 2 * pairs)
    paired = recent.selectExpr("session_id", "id", "role", "content as answer", "lag(role) over (partition by session_id order by id) as before", "lag(content) over (partition by session_id order by id) as question")
    kept = paired.where("role = 'assistant' and before = 'user'").selectExpr("session_id", "id", "question", "answer", "row_number() over (partition by session_id order by id desc) as place")
    return kept.where(F.col("place") <= pairs).select("session_id", "id", "question", "answer")


def handoff_state(events: DataFrame) -> DataFrame:
    """Hand-offs from open and resolve events: a session has one open hand-off at most; the first of repeated opens wins."""
    marked = events.selectExpr("*", "lag(action) over (partition by session_id order by at_ms, event_id) as before")
    turns = marked.where("before is null or before <> action").selectExpr("*", "lead(at_ms) over (partition by session_id order by at_ms, event_id) as next_at")
    return turns.where("action = 'open'").selectExpr("event_id as id", "session_id", "reason", "if(next_at is null, 'open', 'resolved') as status", "at_ms as created_at", "next_at as resolved_at")


def latest_by_key(changes: DataFrame, key: str, order: str, deleted: str) -> DataFrame:
    """The newest state of each key, first creation time kept, deleted keys gone."""
    last = changes.groupBy(key).agg(F.min(order).alias("created_at"), F.max(order).alias("updated_at"), F.max_by(F.struct(*[c for c in changes.columns if c not in (key, order)]), order).alias("last"))
    return last.where(f"not last.{deleted}").select(key, "created_at", "updated_at", "last.*").drop(deleted)
