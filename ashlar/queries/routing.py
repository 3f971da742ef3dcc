"""Routing operators over all questions, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routing as R
from ..registry import oracle_view, query
from ..sources import base
from .text import o_in, o_strip, o_words, q

M = "message"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q('(?i)' + pattern)})"


def o_any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def o_case(cases, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {other} END"


T = o_strip(M)
N = f"len({o_words(T)})"
CLARIFICATION = f"({T} <> '' AND length({T}) < 50 AND {N} <= 4 AND NOT (regexp_matches({T}, '\\?\\s*$') AND {N} >= 3) AND NOT {o_any(f'lower({T})', R.TECHNICAL)} AND NOT {rx(T, R.QUESTION_WORD)})"
CLASS = o_case([(rx(M, R.FOLLOWUP), "'followup'"), (CLARIFICATION, "'clarification'")], "'standalone'")
NAMED = R.facts(R.VEHICLE_FACTS, "pattern")
FACETS = {label: facet for label, (facet,) in R.facts(R.VEHICLE_FACTS, "facet").items()}
RECOGNISED = {label: pattern for label, (pattern,) in R.facts(R.INTENT_FACTS, "pattern").items()}


def o_facet(text: str) -> str:
    return o_case([(rx(text, pattern), q(FACETS[label])) for label, (pattern,) in NAMED.items()], "NULL")


INTENT = o_case([(rx(M, RECOGNISED[x]), q(x)) for x in R.DECIDING], "'general'")
VEHICLE = o_case([(rx(M, pattern), q(label)) for label, (pattern,) in NAMED.items()], "'unknown'")
VARIANT = o_case([(rx(M, p), q(x)) for x, p in R.VARIANTS], "'any'")
DYNAMIC = o_case([(f"{T} = ''", "6"), (rx(T, R.COMPARATIVE), "10"), (f"{N} <= 6", "4"), (f"{N} >= 15", "10")], "6")


def o_profile(label: str, field: str) -> str:
    show = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    known = R.facts(R.INTENT_FACTS, field)
    return o_case([(f"{label} = {q(name)}", show(value)) for name, (value,) in known.items()], show(known["general"][0]))


oracle_view("classified", f"SELECT query_id, message, {CLASS} AS kind, {INTENT} AS intent, {VEHICLE} AS vehicle, {VARIANT} AS variant, CAST({DYNAMIC} AS INTEGER) AS base_k FROM questions")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    return base.questions(spark, sf_dir).select("query_id", "message", R.message_class(m).alias("kind"), R.intent(m).alias("intent"), R.vehicle(m).alias("vehicle"), R.variant(m).alias("variant"), R.dynamic_k(m).alias("base_k"))


def on_questions(name: str, f: Callable[[Column], Column], oracle: str) -> None:
    @query(name, f"SELECT query_id, {oracle} AS value FROM questions")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return base.questions(spark, sf_dir).select("query_id", f(F.col(M)).alias("value"))


on_questions("message_class", R.message_class, CLASS)
on_questions("followup", R.is_followup, rx(M, R.FOLLOWUP))
on_questions("clarification_reply", R.is_clarification, CLARIFICATION)
on_questions("full_detail", lambda m: R.has(m, R.FULL_DETAIL), rx(M, R.FULL_DETAIL))
on_questions("greeting", lambda m: R.has(m, R.GREETING) & (F.size(R.words(m)) <= 8), f"({rx(M, R.GREETING)} AND len({o_words(M)}) <= 8)")
on_questions("vehicle_detect", R.vehicle_facet, o_facet(M))
on_questions("dynamic_k", R.dynamic_k, f"CAST({DYNAMIC} AS INTEGER)")
def o_affirm(text: str) -> str:
    bare = f"regexp_replace(regexp_replace(regexp_replace({text}, {q('(?i)' + R.AFFIRMATIVE)}, ' ', 'g'), '\\s+', ' ', 'g'), '^[ ,.!?]+|[ ,.!?]+$', '', 'g')"
    return f"coalesce(nullif({bare}, ''), {text})"


on_questions("affirm_strip", R.affirm_strip, o_affirm("message"))
_TERMS = f"list_sort(list_filter(list_distinct(regexp_extract_all(lower(message), '[a-z0-9]{{3,}}')), lambda w: w NOT IN {o_in(R.STOPWORDS)}))"
on_questions("key_terms", lambda m: F.array_join(R.key_terms(m), ","), f"array_to_string({_TERMS}, ',')")
on_questions("focus_terms", lambda m: F.array_join(F.slice(R.key_terms(m), 1, 10), ","), f"array_to_string({_TERMS}[1:10], ',')")
_KEPT = f"list_filter(regexp_extract_all(lower(message), '[a-z0-9]{{2,}}'), lambda w: w NOT IN {o_in(R.STOPWORDS)})"
_GRAMS = " || ".join(f"list_transform(range(1, greatest(len({_KEPT}) - {n} + 2, 1)), lambda i: array_to_string(({_KEPT})[i:i + {n - 1}], ' '))" for n in (2, 3))
on_questions("key_phrases", lambda m: F.array_join(R.key_phrases(m), ","), f"array_to_string(list_sort(list_filter(list_distinct({_GRAMS}), lambda p: p NOT IN {o_in(R.TRIVIAL_PHRASES)})), ',')")
on_questions("topic_sets", lambda m: F.array_join(R.topics(m), ","), "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {o_any('lower(message)', keys)} THEN {q(name)} END" for name, keys in R.TOPICS.items()) + "], lambda x: x IS NOT NULL), ',')")
_CLEAN = o_strip(f"regexp_replace(regexp_replace({T}, '[^A-Za-z0-9_\\x{{80}}-\\x{{10FFFF}}\\s\\-/+.:]', ' ', 'g'), '\\s+', ' ', 'g')")
on_questions("model_match", R.model_match, o_case([("contains(lower(message), 'bantam')", "'BSA Bantam'"), ("contains(lower(message), 'scrambler')", "'BSA Scrambler'"), (o_any("lower(message)", ("goldstar", "gold star", "gold-star")), "'BSA Gold Star'")], "NULL"))


def o_refine(source: str, columns: str = "") -> str:
    """Refined messages of a source, with some of its columns."""
    more = f", {columns}" if columns else ""
    return f"""
    WITH cleaned AS (SELECT query_id{more}, message, {T} AS raw, {_CLEAN} AS clean, lower({_CLEAN}) AS low FROM {source}),
    grouped AS (SELECT *, concat_ws(' ', CASE WHEN {o_any('low', ('how much', 'quantity', 'amount', 'capacity', 'volume'))} THEN 'how much quantity amount capacity volume' END,
        CASE WHEN {o_any('low', ('fill', 'refill', 'top up', 'add', 'pour'))} THEN 'fill refill top up add pour' END, CASE WHEN {o_any('low', ('after', 'post'))} THEN 'after' END,
        CASE WHEN (contains(low, 'oil') AND {o_any('low', ('change', 'replace'))}) OR {o_any('low', ('engine oil', 'oil capacity', 'oil quantity'))} THEN 'engine oil capacity refill quantity specification' END) AS g FROM cleaned),
    extended AS (SELECT *, clean || ' (' || array_to_string(list_transform(list_filter(list_zip(string_split(g, ' '), range(1, len(string_split(g, ' ')) + 1)), lambda p: list_position(string_split(g, ' '), p[1]) = p[2]), lambda p: p[1]), ' ') || ')' AS full_text FROM grouped)
    SELECT query_id{more}, CASE WHEN g = '' THEN CASE WHEN raw = '' THEN message ELSE clean END
        WHEN length(full_text) > 320 THEN regexp_replace(regexp_replace(left(full_text, 320), ' [^ ]*$', ''), '[ ,.;:\\-]+$', '') || ')' ELSE full_text END AS message FROM extended"""


@query("refine_query", f"SELECT query_id, message AS value FROM ({o_refine('questions')})")
def refine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.questions(spark, sf_dir).select("query_id", R.refine(F.col(M)).alias("value"))


@query("regex_classify", "SELECT query_id, vehicle, variant, intent, (intent <> 'general' OR vehicle <> 'unknown' OR variant <> 'any') AS confident FROM classified")
def regex_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    confident = (F.col("intent") != "general") | (F.col("vehicle") != "unknown") | (F.col("variant") != "any")
    return classified(spark, sf_dir).select("query_id", "vehicle", "variant", "intent", confident.alias("confident"))


@query("classify_merge", """SELECT query_id, coalesce(nullif(CASE WHEN query_id % 3 = 0 THEN 'unknown' WHEN query_id % 3 = 1 THEN 'Bantam' END, 'unknown'), vehicle) AS vehicle,
    coalesce(nullif(CASE WHEN query_id % 2 = 0 THEN 'general' ELSE 'spec' END, 'general'), intent) AS intent, (query_id % 5 = 0 OR intent <> 'general') AS confident FROM classified""")
def classify_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's labels (here by id) filled up from the patterns' labels; either's confidence counts."""
    scored_vehicle = F.expr("case when query_id % 3 = 0 then 'unknown' when query_id % 3 = 1 then 'Bantam' end")
    scored_intent = F.expr("if(query_id % 2 = 0, 'general', 'spec')")
    return classified(spark, sf_dir).select(
        "query_id", R.merge_label(scored_vehicle, F.col("vehicle"), "unknown").alias("vehicle"), R.merge_label(scored_intent, F.col("intent"), "general").alias("intent"),
        (F.expr("query_id % 5 = 0") | (F.col("intent") != "general")).alias("confident"),
    )


_ALIASES = {a: label for label, names in R.facts(R.VEHICLE_FACTS, "alias").items() for a in names}


@query("label_norm", "SELECT query_id, coalesce(CASE replace(replace(replace(lower(regexp_replace(message, '^\\s+|\\s+$', '', 'g')), '_', ''), '-', ''), ' ', '') " + " ".join(f"WHEN {q(a)} THEN {q(l)}" for a, l in _ALIASES.items()) + " END, 'unknown') AS value FROM questions")
def label_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias lookup by a left join with the small alias table."""
    from ..functions.text import alias_norm

    aliases = spark.createDataFrame(list(_ALIASES.items()), "alias string, label string")
    asked = base.questions(spark, sf_dir).select("query_id", alias_norm(F.col(M)).alias("alias"))
    return asked.join(F.broadcast(aliases), "alias", "left").select("query_id", F.coalesce("label", F.lit("unknown")).alias("value"))


@query("intent_profile", f"SELECT query_id, intent, CAST({o_profile('intent', 'top_k')} AS INTEGER) AS top_k, CAST({o_profile('intent', 'fetch_k')} AS INTEGER) AS fetch_k, CAST({o_profile('intent', 'floor')} AS DOUBLE) AS floor, CAST({o_profile('intent', 'min_keep')} AS INTEGER) AS min_keep, {o_profile('intent', 'long_form')} AS long_form FROM classified")
def intent_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("top_k", "fetch_k", "floor", "min_keep", "long_form")
    return classified(spark, sf_dir).select("query_id", "intent", *[R.profile_value(F.col("intent"), f).alias(f) for f in fields])


def o_intent_k(base_k: str) -> str:
    return f"CASE WHEN {base_k} >= 10 THEN greatest({o_profile('intent', 'top_k')}, {base_k}) ELSE {o_profile('intent', 'top_k')} END"


_INTENT_K = o_intent_k("base_k")


@query("intent_k", f"SELECT query_id, CAST({_INTENT_K} AS INTEGER) AS value FROM classified")
def intent_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("query_id", R.intent_k(F.col("intent"), F.col("base_k")).alias("value"))


@query("fetch_k", f"SELECT query_id, CAST(greatest({o_profile('intent', 'fetch_k')}, greatest({_INTENT_K}, 20)) AS INTEGER) AS value FROM classified")
def fetch_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("query_id", R.fetch_k(F.col("intent"), R.intent_k(F.col("intent"), F.col("base_k"))).alias("value"))


@query("answer_cap", f"SELECT query_id, CASE WHEN {rx(M, R.FULL_DETAIL)} THEN 18 ELSE 10 END AS value FROM questions")
def answer_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.questions(spark, sf_dir).select("query_id", F.when(R.has(F.col(M), R.FULL_DETAIL), 18).otherwise(10).alias("value"))


@query("history_used", "SELECT query_id, CASE kind WHEN 'clarification' THEN 0 WHEN 'followup' THEN 1 ELSE 2 END AS value FROM classified")
def history_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("query_id", R.history_turns(F.col("kind")).alias("value"))


@query("filter_promote", "SELECT query_id, CASE WHEN explicit IS NOT NULL THEN explicit WHEN intent <> 'general' AND vehicle <> 'unknown' THEN CASE vehicle WHEN 'Bantam' THEN 'BSA Bantam' WHEN 'Goldstar' THEN 'BSA Gold Star' ELSE 'BSA Scrambler' END END AS value FROM (SELECT *, CASE WHEN query_id % 7 = 0 THEN 'BSA Bantam' END AS explicit FROM classified)")
def filter_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's vehicle becomes the filter when it is confident and none was given."""
    facet = R.first_case([(F.col("vehicle") == label, F.lit(facet)) for label, facet in FACETS.items()], F.lit(None).cast("string"))
    return classified(spark, sf_dir).select("query_id", F.coalesce(F.expr("case when query_id % 7 = 0 then 'BSA Bantam' end"), F.when(F.col("intent") != "general", facet)).alias("value"))


@query("model_guard", f"SELECT query_id, (intent IN {o_in(R.SENSITIVE)} AND vehicle = 'unknown') AS value FROM classified")
def model_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("query_id", (F.col("intent").isin(*R.SENSITIVE) & (F.col("vehicle") == "unknown")).alias("value"))


@query("resolve_filter", f"""
    WITH named AS (SELECT query_id, CAST(floor(query_id / 1000.0) AS BIGINT) AS session_id, {o_facet(M)} AS facet FROM questions)
    SELECT query_id, coalesce(facet, (SELECT arg_max(p.facet, p.query_id) FROM named p WHERE p.session_id = n.session_id AND p.query_id < n.query_id AND p.facet IS NOT NULL)) AS value FROM named n""")
def resolve_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicle of the text, else of the newest earlier question of the session that names one."""
    asked = base.questions(spark, sf_dir).select("query_id", R.vehicle_facet(F.col(M)).alias("facet"))
    return asked.selectExpr("query_id", "coalesce(facet, last_value(facet, true) over (partition by floor(query_id / 1000D) order by query_id rows between unbounded preceding and 1 preceding)) as value")


@query("query_dedup", "SELECT min(query_id) AS query_id, count(*) AS asked FROM questions GROUP BY regexp_replace(regexp_replace(lower(message), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')")
def query_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct questions, each embedded once."""
    from ..functions.text import query_key

    return base.questions(spark, sf_dir).groupBy(query_key(F.col(M)).alias("key")).agg(F.min("query_id").alias("query_id"), F.count("*").alias("asked")).select("query_id", "asked")


@query("qualifier_dedup", """SELECT session_id, lower(content) AS qualifier, min(id) AS first_id FROM (SELECT session_id, id, unnest(string_split(content, ' ')) AS content FROM messages WHERE role = 'user') WHERE length(content) BETWEEN 3 AND 5 GROUP BY session_id, lower(content)""")
def qualifier_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive ordered distinct: the place of the first spelling of each qualifier of a session."""
    said = base.messages(spark, sf_dir).where("role = 'user'").select("session_id", "id", F.explode(F.split("content", " ")).alias("w")).where("length(w) between 3 and 5")
    return said.groupBy("session_id", F.lower("w").alias("qualifier")).agg(F.min("id").alias("first_id"))


_PATHS = ("Workshop_Manual", "owners manual", "Parts Catalogue", "Warranty", "SOP_12", "wiring", "brochure", "Accessories", "x")
_PATH_SQL = "concat(element_at(array(" + ", ".join(q(p) for p in _PATHS) + f"), cast(doc_id % {len(_PATHS)} + 1 as int)), '/', source, '.pdf')"
_PATH_DUCK = "([" + ", ".join(q(p) for p in _PATHS) + f"])[doc_id % {len(_PATHS)} + 1] || '/' || source || '.pdf'"


@query("doc_type", f"SELECT doc_id, {o_case([(rx('p', pat), q(label)) for label, pat in R.DOC_TYPES], q('spec_sheet'))} AS value FROM (SELECT doc_id, replace({_PATH_DUCK}, '_', ' ') AS p FROM documents)")
def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", R.doc_type(F.expr(_PATH_SQL)).alias("value"))


@query("auto_category", f"SELECT doc_id, {o_case([(o_any('p', needles), q(label)) for label, needles in R.CATEGORIES], q('workshop_manual'))} AS value FROM (SELECT doc_id, lower({_PATH_DUCK}) AS p FROM documents)")
def auto_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", R.category(F.expr(_PATH_SQL)).alias("value"))


@query("doc_model", """
    WITH hits AS (SELECT source, doc_id, CASE WHEN contains(lower(coalesce(text, '')), 'bantam') THEN 'BSA Bantam' WHEN doc_id % 11 = 3 THEN 'BSA Scrambler' END AS hit, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
    SELECT source, coalesce(CASE WHEN source = 'src1' THEN 'BSA Gold Star' END, arg_min(hit, doc_id) FILTER (hit IS NOT NULL AND n <= 15)) AS value FROM hits GROUP BY source""")
def doc_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of a source's name, else of the first of its first 15 chunks that names one."""
    docs = base.table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.when(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("bantam")), "BSA Bantam"), F.expr("case when doc_id % 11 = 3 then 'BSA Scrambler' end")).alias("hit"))
    ranked = docs.selectExpr("*", "row_number() over (partition by source order by doc_id) as n").where("n <= 15")
    found = ranked.groupBy("source").agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("doc_id"))).alias("hit"))
    return found.select("source", F.coalesce(F.when(F.col("source") == "src1", "BSA Gold Star"), "hit").alias("value"))


@query("clarify_merge", """
    WITH flagged AS (SELECT query_id, CAST(floor(query_id / 1000.0) AS BIGINT) AS session_id, message, kind = 'clarification' AS c FROM classified),
    grouped AS (SELECT *, max(CASE WHEN NOT c THEN query_id END) OVER (PARTITION BY session_id ORDER BY query_id) AS root FROM flagged)
    SELECT g.query_id, coalesce((SELECT r.message FROM grouped r WHERE r.query_id = g.root), '') || ' ' ||
        (SELECT string_agg(regexp_replace(p.message, '^\\s+|\\s+$', '', 'g'), ', ' ORDER BY p.query_id) FROM grouped p WHERE p.session_id = g.session_id AND p.c AND p.query_id <= g.query_id AND (g.root IS NULL OR p.query_id > g.root)) AS value
    FROM grouped g WHERE g.c""")
def clarify_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clarification reply joined with the question it belongs to and the replies between."""
    from ..functions.text import strip

    asked = classified(spark, sf_dir).selectExpr("query_id", "cast(floor(query_id / 1000D) as bigint) as session_id", "message", "kind = 'clarification' as c")
    rooted = asked.selectExpr("*", "last_value(if(c, null, query_id), true) over (partition by session_id order by query_id) as root", "last_value(if(c, null, message), true) over (partition by session_id order by query_id) as asked")
    said = rooted.where("c").select("*", F.expr("collect_list(regexp_replace(message, '^\\\\s+|\\\\s+$', '')) over (partition by session_id, root order by query_id rows between unbounded preceding and current row)").alias("replies"))
    return said.select("query_id", F.concat(F.coalesce("asked", F.lit("")), F.lit(" "), F.array_join("replies", ", ")).alias("value"))
