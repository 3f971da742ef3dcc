"""Conversation analytics and state over all messages and events, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversation as C
from ..operators.ranking import counted
from ..registry import oracle_view, query
from ..sources import base
from .text import q

NO = "(" + " OR ".join(f"content ILIKE {q(p)}" for p in T.SQL_NO_ANSWER) + ")"
oracle_view("flagged", f"SELECT *, role = 'assistant' AND {NO} AS no_answer FROM messages")
oracle_view("handoffs", """
    SELECT event_id AS id, session_id, reason, CASE WHEN next_at IS NULL THEN 'open' ELSE 'resolved' END AS status, at_ms AS created_at, next_at AS resolved_at FROM (
        SELECT *, lead(at_ms) OVER (PARTITION BY session_id ORDER BY at_ms, event_id) AS next_at FROM (
            SELECT *, lag(action) OVER (PARTITION BY session_id ORDER BY at_ms, event_id) AS before FROM handoff_events) WHERE before IS NULL OR before <> action) WHERE action = 'open'""")
oracle_view("learned_changes", "SELECT user_id AS id, event_type || '-' || event_id AS answer, event_type = 'error' AS gone, (epoch_us(ts) // 1000) * 1000000 + event_id AS at_ms FROM events")


def handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.handoff_state(base.handoff_events(spark, sf_dir))


def learned_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "events").selectExpr("user_id as id", "concat(event_type, '-', event_id) as answer", "event_type = 'error' as gone", "unix_millis(cast(ts as timestamp)) * 1000000 + event_id as at_ms")


@query("analytics_overview", "SELECT (SELECT count(DISTINCT id) FROM sessions) AS total_sessions, count(*) FILTER (role = 'user') AS total_questions, count(*) FILTER (role = 'assistant' AND NOT no_answer) AS answered, count(*) FILTER (no_answer) AS unanswered FROM flagged")
def analytics_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overview(base.messages(spark, sf_dir), base.sessions(spark, sf_dir))


@query("analytics_handoffs", "SELECT count(*) FILTER (status = 'open') AS open_count, count(*) FILTER (status = 'resolved') AS resolved_count, count(*) FILTER (reason = 'low_confidence') AS low_confidence, count(*) FILTER (reason = 'user_requested') AS user_requested FROM handoffs")
def analytics_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = handoffs(spark, sf_dir)
    return h.agg(*[F.count_if(F.col(c) == v).alias(n) for c, v, n in (("status", "open", "open_count"), ("status", "resolved", "resolved_count"), ("reason", "low_confidence", "low_confidence"), ("reason", "user_requested", "user_requested"))])


SINCE = base.START_MS + C.DAY_MS // 4


@query("analytics_daily", f"SELECT strftime(make_timestamp(created_at * 1000), '%Y-%m-%d') AS day, count(*) FILTER (role = 'user') AS questions, count(*) FILTER (role = 'assistant' AND NOT no_answer) AS answered, count(*) FILTER (no_answer) AS unanswered FROM flagged WHERE created_at >= {SINCE} GROUP BY 1")
def analytics_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.daily(base.messages(spark, sf_dir), SINCE)


@query("unanswered_questions", """
    SELECT u.content AS question, n.session_id, n.created_at FROM (SELECT id, session_id, created_at FROM flagged WHERE no_answer ORDER BY created_at DESC, id DESC LIMIT 30) n
    JOIN LATERAL (SELECT content FROM messages m WHERE m.session_id = n.session_id AND m.id < n.id AND m.role = 'user' ORDER BY m.id DESC LIMIT 1) u ON true""")
def unanswered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unanswered(base.messages(spark, sf_dir))


@query("answer_rate", "SELECT session_id, CAST(round(100.0 * count(*) FILTER (role = 'assistant' AND NOT no_answer) / nullif(count(*) FILTER (role = 'user'), 0)) AS BIGINT) AS rate FROM flagged GROUP BY session_id")
def answer_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.try_divide(100 * F.count_if((F.col("role") == "assistant") & ~F.col("no_answer")), F.count_if(F.col("role") == "user"))
    return C.flagged(base.messages(spark, sf_dir)).groupBy("session_id").agg(F.round(share).cast("long").alias("rate"))


@query("handoff_total", "SELECT session_id, nullif(count(*) FILTER (status IN ('open', 'resolved')), 0) AS total FROM handoffs GROUP BY session_id")
def handoff_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handoffs(spark, sf_dir).groupBy("session_id").agg(F.nullif(F.count_if(F.col("status").isin("open", "resolved")), F.lit(0)).alias("total"))


@query("history_pairs", """
    WITH recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM messages WHERE role IN ('user', 'assistant')) WHERE back <= 8),
    paired AS (SELECT session_id, id, role, content AS answer, lag(role) OVER w AS before, lag(content) OVER w AS question FROM recent WINDOW w AS (PARTITION BY session_id ORDER BY id))
    SELECT session_id, id, question, answer FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS place FROM paired WHERE role = 'assistant' AND before = 'user') WHERE place <= 4""")
def history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.history_pairs(base.messages(spark, sf_dir))


@query("last_question", "SELECT session_id, arg_max(content, id) AS question FROM messages WHERE role = 'user' GROUP BY session_id")
def last_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.messages(spark, sf_dir).where("role = 'user'").groupBy("session_id").agg(F.max_by("content", "id").alias("question"))


@query("open_handoffs", "SELECT h.id, h.session_id, h.reason, h.created_at, (SELECT m.content FROM messages m WHERE m.session_id = h.session_id AND m.role = 'user' ORDER BY m.id DESC LIMIT 1) AS last_question FROM handoffs h JOIN sessions s ON s.id = h.session_id WHERE h.status = 'open'")
def open_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open hand-offs of known sessions, with the session's newest question."""
    known = base.sessions(spark, sf_dir).select(F.col("id").alias("session_id"))
    opened = handoffs(spark, sf_dir).where("status = 'open'").join(known, "session_id", "left_semi")
    return opened.join(last_question(spark, sf_dir), "session_id", "left").select("id", "session_id", "reason", "created_at", F.col("question").alias("last_question"))


@query("has_open_handoff", "SELECT id FROM sessions s WHERE EXISTS (SELECT 1 FROM handoffs h WHERE h.session_id = s.id AND h.status = 'open')")
def has_open_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = handoffs(spark, sf_dir).where("status = 'open'").select(F.col("session_id").alias("id"))
    return base.sessions(spark, sf_dir).join(opened, "id", "left_semi").select("id")


@query("handoff_state", "SELECT * FROM handoffs")
def handoff_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handoffs(spark, sf_dir)


@query("suggest_handoff", """SELECT m.id, ((m.top_score < 0.45 OR regexp_matches(m.content, """ + q("(?i)(?:" + T.REGEX_NO_ANSWER + ")") + """)) AND NOT EXISTS (SELECT 1 FROM handoffs h WHERE h.session_id = m.session_id AND h.status = 'open')) AS suggest FROM messages m WHERE m.role = 'assistant'""")
def suggest_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak or missing answers of sessions that have no open hand-off."""
    opened = handoffs(spark, sf_dir).where("status = 'open'").select("session_id").distinct().withColumn("open", F.lit(True))
    replies = base.messages(spark, sf_dir).where("role = 'assistant'").join(opened, "session_id", "left")
    weak = (F.col("top_score") < 0.45) | T.no_answer_regex(F.col("content"))
    return replies.select("id", (weak & F.col("open").isNull()).alias("suggest"))


@query("session_touch", "SELECT session_id AS id, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS messages FROM messages GROUP BY session_id")
def session_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.messages(spark, sf_dir).groupBy(F.col("session_id").alias("id")).agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count("*").alias("messages"))


@query("learned_latest", "SELECT id, min(at_ms) AS created_at, max(at_ms) AS updated_at, arg_max(answer, at_ms) AS answer FROM learned_changes GROUP BY id HAVING NOT arg_max(gone, at_ms)")
def learned_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest_by_key(learned_changes(spark, sf_dir), "id", "at_ms", "gone")


@query("learned_list", "SELECT id, updated_at, CAST(row_number() OVER (ORDER BY updated_at DESC) AS INTEGER) AS place FROM (SELECT id, max(at_ms) AS updated_at FROM learned_changes GROUP BY id)")
def learned_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries with their places, newest first (the listing)."""
    newest = learned_changes(spark, sf_dir).groupBy("id").agg(F.max("at_ms").alias("updated_at"))
    placed = counted(newest, F.col("updated_at"), [F.col("id")], F.lit(True), "place", descending=True)
    return placed.select("id", "updated_at", F.col("place").cast("int").alias("place"))


@query("qa_search", "SELECT session_id, id FROM (SELECT session_id, id, content, lag(content) OVER (PARTITION BY session_id ORDER BY id) AS question FROM messages) WHERE contains(lower(content), 'the') OR contains(lower(coalesce(question, '')), 'la ')")
def qa_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive substring search in answers or their questions."""
    rows = base.messages(spark, sf_dir).selectExpr("session_id", "id", "content", "lag(content) over (partition by session_id order by id) as question")
    return rows.where(F.contains(F.lower("content"), F.lit("the")) | F.contains(F.lower(F.coalesce("question", F.lit(""))), F.lit("la "))).select("session_id", "id")


@query("messages_after", "SELECT id, session_id, role, content FROM messages WHERE id > session_id * 1000 + 2")
def messages_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after each session's cursor (its third message)."""
    return base.messages(spark, sf_dir).where("id > session_id * 1000 + 2").select("id", "session_id", "role", "content")


@query("transcript", "SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY id) AS transcript FROM messages GROUP BY session_id")
def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array_sort(F.collect_list(F.struct("id", F.concat("role", F.lit(": "), "content").alias("line"))))
    return base.messages(spark, sf_dir).groupBy("session_id").agg(said.alias("said")).select("session_id", F.array_join(F.transform("said", lambda x: x.line), "\n").alias("transcript"))


@query("fk_check", "SELECT m.session_id, count(*) AS orphans FROM messages m LEFT JOIN (SELECT id FROM sessions WHERE id % 10 <> 3) s ON s.id = m.session_id WHERE s.id IS NULL GROUP BY m.session_id")
def fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose session is missing (the sessions ending in 3 are taken away to have some)."""
    known = base.sessions(spark, sf_dir).where("id % 10 <> 3").select(F.col("id").alias("session_id"))
    return base.messages(spark, sf_dir).join(known, "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("orphans"))


@query("citations_json", "SELECT session_id, count(*) AS cited, CAST(sum(CAST(json_extract_string(c, '$.page') AS BIGINT)) AS BIGINT) AS pages FROM (SELECT session_id, '{\"source\":\"s' || id % 5 || '\",\"page\":' || id % 90 || '}' AS c FROM messages) GROUP BY session_id")
def citations_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations stored as JSON text, decoded with a schema."""
    stored = base.messages(spark, sf_dir).selectExpr("session_id", "to_json(named_struct('source', concat('s', id % 5), 'page', id % 90)) as c")
    decoded = stored.select("session_id", F.from_json("c", "source string, page long").alias("c"))
    return decoded.groupBy("session_id").agg(F.count("c").alias("cited"), F.sum("c.page").alias("pages"))


@query("token_frames", "SELECT id, CAST(i AS BIGINT) AS seq, content[CAST(i * 12 + 1 AS BIGINT):CAST(i * 12 + 12 AS BIGINT)] AS token FROM (SELECT id, content, unnest(range(0, (length(content) + 11) // 12)) AS i FROM messages WHERE role = 'assistant')")
def token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers replayed in frames of twelve characters."""
    replies = base.messages(spark, sf_dir).where("role = 'assistant' and length(content) > 0")
    return replies.select("id", "content", F.explode(F.expr("sequence(0L, (length(content) - 1) div 12)")).alias("seq")).selectExpr("id", "seq", "substring(content, cast(seq * 12 + 1 as int), 12) as token")


@query("token_reassembly", "SELECT id, content FROM messages WHERE role = 'assistant' AND length(content) > 0")
def token_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames put together again by stream and order."""
    frames = token_frames(spark, sf_dir)
    return frames.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "token"))).alias("parts")).select("id", F.array_join(F.transform("parts", lambda x: x.token), "").alias("content"))


@query("sse_parse", "SELECT id, CAST(i AS BIGINT) AS seq, 'token' AS event, CAST(json_object('token', content[CAST(i * 12 + 1 AS BIGINT):CAST(i * 12 + 12 AS BIGINT)]) AS VARCHAR) AS data, content[CAST(i * 12 + 1 AS BIGINT):CAST(i * 12 + 12 AS BIGINT)] AS token FROM (SELECT id, content, unnest(range(0, (length(content) + 11) // 12)) AS i FROM messages WHERE role = 'assistant')")
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of an event stream decoded: event name, joined data lines, JSON where it parses."""
    from ..functions.frames import decode, encode

    frames = token_frames(spark, sf_dir).select("id", "seq", encode(F.lit("token"), F.to_json(F.struct("token"))).alias("raw"))
    return frames.select("id", "seq", decode(F.col("raw")).alias("frame")).select("id", "seq", "frame.*")


@query("user_sessions", "SELECT session_id, role, count(*) AS n, GROUPING(session_id) AS g FROM messages GROUP BY GROUPING SETS ((session_id, role), (role))")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message counts by session and role, and by role alone."""
    rows = base.messages(spark, sf_dir)
    return rows.groupingSets([("session_id", "role"), ("role",)], "session_id", "role").agg(F.count("*").alias("n"), F.grouping("session_id").cast("long").alias("g"))
