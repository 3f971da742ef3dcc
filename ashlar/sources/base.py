"""Base tables of the registered queries, derived from the star, text and event tables.

Each has a twin of the same columns for the SQL side. Literal rows with negative
ids add shapes that the generated texts lack (folios, part numbers, questions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import oracle_view

START_MS = 1_704_067_200_000
HOUR_MS = 3_600_000

LINES = (
    "- 12 -", "Page 3 of 9", "3/9", "NOTE:", "CAUTION", "***", "•", "a", "", "   ", "Fit the clutch cover", "Tighten to 25 Nm", "[Table 1]", "[OCR augment]",
    "SPECIFICATION", "ENGINE OIL", "3.2 Valve clearance", "kg cm", "N m", "25 Nm", "the oil is then drained and the filter is replaced with a new one as shown", "Remove the drain plug.",
    "Oil filter (see page 12)", "Front wheel and", "Rear brake caliper,", "10 20 30", "xq7 ## @@ zz", "the bolt is to be fitted with the washer", "Section: Oil change", "Battery terminals are checked every month and",
)
TEXTS = (
    "Hello  world \n\n\n\nnext  \n", "clean text\n[OCR augment]\nnoise", "body\n  [Table 2]\nA | B", "hyphen-\nated word and re-\nUse", "mark ﬁlter – dash ‘q’ “d” x",
    "Section: Oil\nSection: Filter\nthe body text of this section is long enough", "Section: X\n12\nshort", "A | B | C | D\nE | F | G | H\nplain", "Key | Value | Key | Value | Key", "leaders ........... 12\n\n\n\n\nend",
    "Torque is 25 Nm for part A1234BC56789, see p. 204 and REV-2.\nSources: manual p. 999", "Tighten 12.5 kgf.m at page 17, v2.10", "No facts here.", "p. 3 and P12, 30 lb-ft",
    "yes please", "Yes, sure. Valve clearance procedure please!", "ok", "How much oil after the change?", "refill the engine oil", "post", "I couldn't find that in the manuals", "that is outside the usual scope of this", "", "   ",
)
QUESTIONS = (
    "What is the part number for the Bantam front disc?", "Front disc part number for the Bantam?", "torque spec for gs", "gold star", "yes please", "and for the Scrambler?", "What about the rear?", "Hi!", "good morning",
    "How do I adjust the valve clearance step by step on the goldstar?", "Why does my battery not charge?", "compare bantam vs scrambler", "is the warranty transferable", "engine is smoking", "wiring diagram for euro 5+",
    "Euro-5", "the left one", "smells odd", "How often should I replace the oil filter and what oil grade is recommended for the Bantam in the cold?", "same for it", "show me all details of the brake overhaul procedure",
    "oil", "what is the oil capacity", "how much fuel", "vibration at high speed", "charging fault with alternator", "bantam", "Scrambler?", "", "  ", "is it available?", "does it fit my model?",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literals(spark: SparkSession, values: tuple[str, ...], columns: str) -> DataFrame:
    return spark.createDataFrame([(-1 - i, v) for i, v in enumerate(values)], columns)


def _values(values: tuple[str, ...], names: str) -> str:
    quoted = ", ".join("(" + str(-1 - i) + ", '" + v.replace("'", "''") + "')" for i, v in enumerate(values))
    return f"(VALUES {quoted}) AS t({names})"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of every document, and the literal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.unionByName(_literals(spark, TEXTS, "doc_id long, text string"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos (from 0) and line of every line of every document, and the literal lines as document -1."""
    docs = table(spark, sf_dir, "documents")
    split = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    literal = _literals(spark, LINES, "n long, line string").selectExpr("-1L as doc_id", "cast(-1 - n as int) as pos", "line")
    return split.unionByName(literal).selectExpr("doc_id", "cast(pos as bigint) as pos", "line")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as stored messages; every fifth turn of an assistant has no answer."""
    content = "case when role = 'assistant' and (conv_id + turn) % 5 = 0 then concat('I couldn''t find that. ', text) else text end"
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn as id", "conv_id as session_id", "role", f"{content} as content",
        "((conv_id * 7 + turn * 13) % 100) / 100D as top_score", f"{START_MS} + conv_id * {HOUR_MS} + turn * 60000 as created_at",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy(F.col("session_id").alias("id")).agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))


def handoff_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (errors and signups) and resolutions (purchases) by session, from the event table."""
    kinds = "case event_type when 'error' then 'open' when 'signup' then 'open' when 'purchase' then 'resolve' end"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id as session_id", f"{kinds} as action", "if(event_type = 'error', 'low_confidence', 'user_requested') as reason",
        "unix_millis(cast(ts as timestamp)) as at_ms",
    ).where("action is not null")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and message: every user turn (with a question put before its text), and the literal questions."""
    shapes = F.array(*[F.lit(q) for q in QUESTIONS])
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.expr("conv_id * 1000 + turn").alias("query_id"),
        F.when(F.expr("(conv_id + turn) % 3 = 0"), F.element_at(shapes, F.expr(f"cast((conv_id * 5 + turn) % {len(QUESTIONS)} + 1 as int)"))).otherwise(F.coalesce("text", F.lit(""))).alias("message"),
    )
    return asked.unionByName(_literals(spark, QUESTIONS, "query_id long, message string"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked matches: ten documents for each query, with score, section, page and type by their texts' lengths and facets from their columns."""
    topics = F.array(*[F.lit(x) for x in SECTIONS])
    docs = table(spark, sf_dir, "documents").select(
        F.expr("doc_id div 10").alias("query_id"), "doc_id", F.expr(f"({SIZE} * 7919 % 1000) / 1000D").alias("score"),
        F.element_at(topics, F.expr(f"cast({SIZE} * 31 % {len(SECTIONS)} + 1 as int)")).alias("section"),
        F.expr(f"{SIZE} * 17 % 60").alias("page"), F.expr(f"element_at(array({', '.join(repr(x) for x in DOC_TYPES)}), cast({SIZE} div 10 % {len(DOC_TYPES)} + 1 as int))").alias("doc_type"),
        F.expr("case lang when 'en' then null when 'fr' then 'BSA Bantam' when 'de' then 'BSA Gold Star' else 'BSA Scrambler' end").alias("vehicle"),
        F.coalesce("text", F.lit("")).alias("text"), "source",
        F.element_at(F.array(*[F.lit(x) for x in QUESTIONS]), F.expr(f"cast(doc_id div 10 % {len(QUESTIONS)} + 1 as int)")).alias("question"),
    )
    return docs.selectExpr("query_id", "cast(row_number() over (partition by query_id order by score desc, doc_id) as bigint) as rank", "doc_id", "score", "section", "page", "doc_type", "vehicle", "text", "source", "question")


SIZE = "cast(length(coalesce(text, '')) as bigint)"
SECTIONS = ("Oil change", "Valve clearance", "Battery and charging", "Brake caliper", "Warranty claim", "Clutch cable", "General", "Wheel and tyre", "Spark plug", "Fuel tank")
DOC_TYPES = ("workshop_manual", "owners_manual", "parts_catalogue", "sop", "spec_sheet")


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


oracle_view("texts", f"SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT * FROM {_values(TEXTS, 'doc_id, text')}")
oracle_view("split_lines", "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents")
oracle_view("doc_lines", f"SELECT doc_id, pos, line FROM split_lines UNION ALL SELECT -1, -1 - n, line FROM {_values(LINES, 'n, line')}")
oracle_view(
    "messages",
    f"""SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, role,
        CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 = 0 THEN 'I couldn''t find that. ' || text ELSE text END AS content,
        ((conv_id * 7 + turn * 13) % 100) / 100.0::DOUBLE AS top_score, {START_MS} + conv_id * {HOUR_MS} + turn * 60000 AS created_at FROM conversations""",
)
oracle_view("sessions", "SELECT session_id AS id, min(created_at) AS created_at, max(created_at) AS updated_at FROM messages GROUP BY session_id")
oracle_view(
    "handoff_events",
    """SELECT event_id, user_id AS session_id, CASE event_type WHEN 'purchase' THEN 'resolve' ELSE 'open' END AS action,
        CASE WHEN event_type = 'error' THEN 'low_confidence' ELSE 'user_requested' END AS reason, (epoch_us(ts) // 1000) AS at_ms
        FROM events WHERE event_type IN ('error', 'signup', 'purchase')""",
)
oracle_view(
    "questions",
    f"""SELECT conv_id * 1000 + turn AS query_id, CASE WHEN (conv_id + turn) % 3 = 0 THEN ({_list(QUESTIONS)})[(conv_id * 5 + turn) % {len(QUESTIONS)} + 1] ELSE coalesce(text, '') END AS message
        FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM {_values(QUESTIONS, 'query_id, message')}""",
)
oracle_view(
    "matches",
    f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank, doc_id, score, section, page, doc_type, vehicle, text, source, question FROM (
        SELECT doc_id // 10 AS query_id, doc_id, ({SIZE} * 7919 % 1000) / 1000.0::DOUBLE AS score, ({_list(SECTIONS)})[{SIZE} * 31 % {len(SECTIONS)} + 1] AS section,
        {SIZE} * 17 % 60 AS page, ({_list(DOC_TYPES)})[{SIZE} // 10 % {len(DOC_TYPES)} + 1] AS doc_type,
        CASE lang WHEN 'en' THEN NULL WHEN 'fr' THEN 'BSA Bantam' WHEN 'de' THEN 'BSA Gold Star' ELSE 'BSA Scrambler' END AS vehicle, coalesce(text, '') AS text, source, ({_list(QUESTIONS)})[doc_id // 10 % {len(QUESTIONS)} + 1] AS question FROM documents)""",
)
