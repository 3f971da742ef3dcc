"""Retrieval, post-filters and answer assembly over all matches, with their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routing
from ..functions import text as T
from ..operators import retrieval as R
from ..plans import chat
from ..plans.retrieve import retrieve as retrieve_plan
from ..registry import ORACLES, VIEWS, oracle_view, query
from ..sources import base
from .routing import CLASS, DYNAMIC, INTENT, o_affirm, o_any, o_case, o_facet, o_in, o_intent_k, o_profile, o_refine, rx
from .text import o_depipe, q

FACET = "CASE d.lang WHEN 'en' THEN NULL WHEN 'fr' THEN 'BSA Bantam' WHEN 'de' THEN 'BSA Gold Star' WHEN 'es' THEN 'BSA Scrambler' END"
oracle_view("chunks", f"SELECT e.vec_id AS chunk_id, e.embedding AS vec, {FACET} AS vehicle FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id")
oracle_view("asked", "SELECT chunk_id AS query_id, vec AS query_vec, vehicle AS wanted FROM chunks WHERE chunk_id % 50 = 0")
oracle_view("nearest", """SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, list_cosine_similarity(list_transform(query_vec, lambda x: x::DOUBLE), list_transform(vec, lambda x: x::DOUBLE)) AS score FROM asked JOIN chunks ON (wanted IS NULL OR vehicle IS NULL OR vehicle = wanted) AND query_id <> chunk_id)""")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.expr(FACET.replace("d.lang", "lang")).alias("vehicle"))
    return base.table(spark, sf_dir, "embeddings").join(docs, "vec_id", "left").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "vehicle")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors: every fiftieth vector asks for its like, with its vehicle as facet."""
    return chunks(spark, sf_dir).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec"), F.col("vehicle").alias("wanted"))


@query("retrieve", """
    WITH top AS (SELECT * FROM nearest WHERE rank <= 6 AND score >= 0.05), marked AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS best FROM top),
    counted AS (SELECT *, count(*) FILTER (score >= 0.2 * best) OVER (PARTITION BY query_id) AS kept FROM marked)
    SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM counted WHERE best <= 0 OR CASE WHEN kept >= 3 THEN score >= 0.2 * best ELSE rank <= 3 END""")
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve_plan(asked(spark, sf_dir), chunks(spark, sf_dir))


@query("knn_topk", "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM nearest WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.knn(asked(spark, sf_dir), chunks(spark, sf_dir), 10)
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


ANSWER_SCORE = 0.85


#: What is added to the id of a stored question, which is not its own chunk.
STORED = 1_000_000
oracle_view("stored", f"SELECT vec_id + {STORED} AS chunk_id, embedding AS vec, label FROM embeddings WHERE label % 2 = 0")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that have been answered before: the vectors of even labels."""
    return base.table(spark, sf_dir, "embeddings").where("label % 2 = 0").select((F.col("vec_id") + STORED).alias("chunk_id"), F.col("embedding").alias("vec"), F.lit(None).cast("string").alias("vehicle"))


#: Every vector is a stored question; a question's own is one only if it has been asked before (an even label).
_LIKE = "list_cosine_similarity(list_transform(query_vec, lambda x: x::DOUBLE), list_transform(s.embedding, lambda x: x::DOUBLE))"


@query("learned_lookup", f"""SELECT query_id, chunk_id, score, score >= {ANSWER_SCORE} AS hit FROM (SELECT query_id, s.vec_id + {STORED} AS chunk_id, round({_LIKE}, 6) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round({_LIKE}, 12) DESC, s.vec_id) AS rank FROM asked JOIN embeddings s ON s.vec_id <> query_id OR s.label % 2 = 0) WHERE rank = 1""")
def learned_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all stored questions for each question, and whether it is near enough to be answered alike.

    Every vector is stored; a question's own counts if it has been asked before (its label is even).
    """
    every = base.table(spark, sf_dir, "embeddings")
    known = every.select((F.col("vec_id") + STORED).alias("chunk_id"), F.col("embedding").alias("vec"), F.lit(None).cast("string").alias("vehicle"))
    # the search leaves out the row of a query's own id: that of its stored question, or none (a negative one), if that counts
    again = F.coalesce(F.col("label") % 2 == 0, F.lit(False))
    questions = every.where("vec_id % 50 = 0").select(F.when(again, -1 - F.col("vec_id")).otherwise(F.col("vec_id") + STORED).alias("query_id"), F.col("embedding").alias("query_vec"), F.lit(None).cast("string").alias("wanted"))
    best = R.knn(questions, known, 1)
    query_id = F.when(F.col("query_id") < 0, -1 - F.col("query_id")).otherwise(F.col("query_id") - STORED)
    return best.select(query_id.alias("query_id"), "chunk_id", F.round("score", 6).alias("score"), (F.round("score", 6) >= ANSWER_SCORE).alias("hit"))


@query("cosine", "SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("dim_guard", "SELECT label, count(*) FILTER (len(embedding) <> 64) AS wrong, count(*) AS vectors FROM embeddings GROUP BY label")
def dim_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose dimension is not the index's."""
    return base.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count_if(F.size("embedding") != 64).alias("wrong"), F.count("*").alias("vectors"))


@query("facet_filter", "SELECT doc_id FROM matches WHERE (vehicle = 'BSA Bantam' OR vehicle IS NULL) AND doc_type = 'sop'")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.matches(spark, sf_dir).where(R.facet_filter(F.col("vehicle"), F.lit("BSA Bantam")) & (F.col("doc_type") == "sop")).select("doc_id")


@query("rerank", """WITH s AS (SELECT m.query_id, m.doc_id, m.score AS vector_score, len(list_intersect(string_split(lower(m.text), ' '), string_split(lower(m.section), ' '))) AS hits FROM matches m)
    SELECT query_id, doc_id, vector_score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, vector_score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches by a local scorer (words shared with the section) that stands in for a cross-encoder."""
    hits = F.size(F.array_intersect(F.split(F.lower("text"), " "), F.split(F.lower("section"), " ")))
    scored = base.matches(spark, sf_dir).select("query_id", "doc_id", F.col("score").alias("vector_score"), hits.alias("hits"))
    return scored.selectExpr("query_id", "doc_id", "vector_score", "cast(row_number() over (partition by query_id order by hits desc, vector_score desc, doc_id) as bigint) as rank").where("rank <= 5")


@query("rerank_floor", "SELECT query_id, rank, doc_id FROM (SELECT *, count(*) FILTER (score >= 0.4 * best) OVER (PARTITION BY query_id) AS kept FROM (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS best FROM matches)) WHERE best <= 0 OR CASE WHEN kept >= 4 THEN score >= 0.4 * best ELSE rank <= 4 END")
def rerank_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.score_floor(base.matches(spark, sf_dir), 0.4, 4).select("query_id", "rank", "doc_id")


@query("score_gap", """WITH r AS (SELECT query_id, max(score) FILTER (rank = 1) AS top, list_sort(list(score) FILTER (rank > 1), 'DESC') AS rest FROM matches GROUP BY query_id)
    SELECT query_id, top, rest[len(rest) // 2 + 1] AS middle, coalesce(top >= 2.0 * rest[len(rest) // 2 + 1], false) AS gap FROM r""")
def score_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.median_gap(base.matches(spark, sf_dir))


@query("majority_section", """WITH s AS (SELECT query_id, section, count(*) AS n, min(rank) AS f FROM matches WHERE rank <= 3 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS p, sum(n) OVER (PARTITION BY query_id) AS total FROM s)
    SELECT query_id, section, n FROM r WHERE p = 1 AND n >= 0.5 * total""")
def majority_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.majority(base.matches(spark, sf_dir))


def _o_topics(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {o_any(f'lower({x})', keys)} THEN {q(name)} END" for name, keys in routing.TOPICS.items()) + "], lambda x: x IS NOT NULL)"


# what the policy reads from a match's question
_TYPES = o_case([(f"intent = {q(label)}", str(types)) for label, types in routing.facts(routing.INTENT_FACTS, "doc_type").items()], "CAST([] AS VARCHAR[])")
oracle_view("asked_matches", f"""SELECT *, {_TYPES} AS preferred, {o_profile('intent', 'floor')}::DOUBLE AS floor, {o_profile('intent', 'min_keep')} AS min_keep, {o_profile('intent', 'top_k')} AS top_k, {o_profile('intent', 'long_form')} AS long_form,
    list_distinct(list_concat({_o_topics('section')}, {_o_topics('left(text, 600)')})) AS own_topics FROM (
    SELECT *, question AS message, {re.sub(r'\bmessage\b', 'question', INTENT)} AS intent, {o_facet('question')} AS wanted, {_o_topics('question')} AS topics, {rx('question', routing.FULL_DETAIL)} AS full_detail FROM matches)""")
_WORDS3 = "regexp_extract_all(lower(question), '[a-z0-9]{3,}')"
_WORDS2 = f"list_filter(regexp_extract_all(lower(question), '[a-z0-9]{{2,}}'), lambda w: NOT list_contains({list(routing.STOPWORDS)}, w))"
_HAY = "lower(section || chr(10) || text)"
_OFF = f"intent = 'diagnostic' AND {rx('question', routing.BATTERY)} AND {rx(_HAY, routing.OFF_DIAGNOSTIC)}"
_GRAMS = f"list_filter(list_concat(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2]), list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])), lambda p: NOT list_contains({list(routing.TRIVIAL_PHRASES)}, p))"


def _o_hit(source: str) -> str:
    """Rows of a source with their terms and phrases, and whether procedure focus keeps them by content."""
    grams = _GRAMS.replace("w[:-2], w[2:]", "CASE WHEN len(w) > 1 THEN w[:-2] ELSE [] END, CASE WHEN len(w) > 1 THEN w[2:] ELSE [] END").replace("w[:-3], w[2:-2], w[3:]", "CASE WHEN len(w) > 2 THEN w[:-3] ELSE [] END, CASE WHEN len(w) > 2 THEN w[2:-2] ELSE [] END, CASE WHEN len(w) > 2 THEN w[3:] ELSE [] END")
    return f"""SELECT *, intent <> 'procedure' OR (len(terms) = 0 AND len(phrases) = 0) OR rank <= 2 OR len(list_filter(phrases, lambda p: contains({_HAY}, p))) > 0 OR len(list_filter(terms, lambda t: contains({_HAY}, t))) >= 2 AS hit
        FROM (SELECT *, {grams} AS phrases FROM (SELECT *, list_filter(list_distinct({_WORDS3}), lambda w: NOT list_contains({list(routing.STOPWORDS)}, w)) AS terms, {_WORDS2} AS w FROM {source}))"""


def asked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.asked(base.matches(spark, sf_dir))


_KEYS = "list_distinct(list_concat(list_filter(list_transform(regexp_split_to_array(lower(question), '\\s+'), lambda w: regexp_replace(w, '^[.,?!:;()''\"]+|[.,?!:;()''\"]+$', '', 'g')), lambda w: length(w) >= 4), " + ", ".join(f"CASE WHEN list_contains(topics, {q(n)}) THEN {list(k)} ELSE [] END" for n, k in routing.TOPICS.items()) + "))"
# quotes inside of keywords
_KEYS = _KEYS.replace('"won\'t start"', "'won''t start'")


@query("dominant_section", f"""WITH h AS (SELECT *, CASE WHEN len(topics) > 0 THEN len(list_filter({_KEYS}, lambda x: contains(lower(section), x))) ELSE 0 END AS hits FROM asked_matches),
    c AS (SELECT query_id, section AS named FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, score DESC, rank) AS p FROM h WHERE hits > 0) WHERE p = 1),
    g AS (SELECT query_id, max(score) FILTER (rank = 1) AS top, max(section) FILTER (rank = 1) AS lead, bool_or(len(topics) = 0 OR list_has_any(topics, own_topics)) FILTER (rank = 1) AS fits, list_sort(list(score) FILTER (rank > 1), 'DESC') AS rest FROM asked_matches GROUP BY query_id),
    s AS (SELECT query_id, section, count(*) AS n, min(rank) AS f FROM matches WHERE rank <= 3 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS p, sum(n) OVER (PARTITION BY query_id) AS total FROM s),
    m AS (SELECT query_id, section FROM r WHERE p = 1 AND n >= 0.5 * total)
    SELECT g.query_id, coalesce(named, CASE WHEN top >= 2.0 * rest[len(rest) // 2 + 1] AND rest[len(rest) // 2 + 1] > 0 AND fits THEN lead END, m.section) AS section FROM g LEFT JOIN m ON m.query_id = g.query_id LEFT JOIN c ON c.query_id = g.query_id""")
def dominant_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that the question names best, else the first match's on a clear gap and topic, else the majority section."""
    return R.dominant_section(base.matches(spark, sf_dir), F.col("question"))


@query("vehicle_purity", "SELECT query_id, rank, doc_id FROM (SELECT *, coalesce(wanted IS NULL OR vehicle IS NULL OR vehicle = wanted, false) AS k, bool_or(coalesce(wanted IS NULL OR vehicle IS NULL OR vehicle = wanted, false)) OVER (PARTITION BY query_id) AS a FROM asked_matches) WHERE k OR NOT a")
def vehicle_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vehicle_purity(asked_matches(spark, sf_dir), F.col("wanted")).select("query_id", "rank", "doc_id")


@query("diag_focus", f"SELECT query_id, rank, doc_id FROM (SELECT *, NOT ({_OFF}) AS k, bool_or(NOT ({_OFF})) OVER (PARTITION BY query_id) AS a FROM asked_matches) WHERE k OR NOT a")
def diag_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of questions about battery faults without other subsystems, and all others."""
    return R.diagnostic_focus(asked_matches(spark, sf_dir), R.on_diagnosis(F.col("question"), F.col("intent"))).select("query_id", "rank", "doc_id")


@query("proc_focus", f"SELECT query_id, rank, doc_id FROM (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS a FROM ({_o_hit('asked_matches')})) WHERE hit OR NOT a")
def proc_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of procedures the first two matches, and those with a phrase or two terms of the question."""
    return R.procedure_focus(asked_matches(spark, sf_dir), R.on_procedure(F.col("question"), F.col("intent"))).select("query_id", "rank", "doc_id")


_PREFERRED = ("workshop_manual", "owners_manual", "sop")


@query("diversify", f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY rank) AS rnd, min(rank) OVER (PARTITION BY query_id, doc_type) AS f,
        coalesce(list_position({list(_PREFERRED)}, doc_type), 99) AS p FROM matches)
    SELECT query_id, doc_id, CAST(new_rank AS INTEGER) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 6 THEN rank END, rnd, p, f) AS new_rank FROM r) WHERE new_rank <= 6""")
def diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_rounds(base.matches(spark, sf_dir), F.array(*map(F.lit, _PREFERRED)), 6).select("query_id", "doc_id", "new_rank")


@query("merge_unique", """WITH b AS (SELECT query_id, rank, 1 AS src, doc_id % 7 AS key FROM matches WHERE rank <= 5 UNION ALL SELECT query_id, rank, 2, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 7 END FROM matches WHERE rank > 5),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY src, rank) AS nth FROM b)
    SELECT query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY src, rank) AS INTEGER) AS new_rank FROM r WHERE key IS NULL OR nth = 1""")
def merge_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = base.matches(spark, sf_dir)
    first = m.where("rank <= 5").selectExpr("query_id", "rank", "doc_id % 7 as key")
    second = m.where("rank > 5").selectExpr("query_id", "rank", "if(doc_id % 11 = 0, null, doc_id % 7) as key")
    return R.merged(first, second, "key").select("query_id", "key", "new_rank")


@query("section_relevance", """WITH t AS (SELECT *, len(topics) > 0 AND len(own_topics) > 0 AND NOT list_has_any(own_topics, topics) AS off FROM asked_matches),
    r AS (SELECT *, count(*) FILTER (NOT off) OVER (PARTITION BY query_id) AS kept, row_number() OVER (PARTITION BY query_id ORDER BY off, rank) AS new_rank FROM t)
    SELECT query_id, doc_id, CAST(new_rank AS INTEGER) AS new_rank FROM r WHERE new_rank <= greatest(kept, min_keep)""")
def section_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.section_relevance(asked_matches(spark, sf_dir), F.col("topics"), R.chunk_topics(), F.col("min_keep")).select("query_id", "doc_id", "new_rank")


@query("page_neighbors", "SELECT m.query_id, m.doc_id AS seed_id, c.doc_id, 0.0::DOUBLE AS score FROM matches m JOIN matches c ON c.source = m.source AND c.page BETWEEN m.page - 2 AND m.page + 2 AND c.doc_id <> m.doc_id WHERE m.rank = 1 AND (c.vehicle IS NULL OR m.vehicle IS NULL OR c.vehicle = m.vehicle)")
def page_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = base.matches(spark, sf_dir)
    return R.neighbours(m.where("rank = 1"), m)


@query("neighbor_guard", "SELECT query_id, doc_id FROM (SELECT *, first_value(vehicle) OVER (PARTITION BY query_id ORDER BY rank) AS seed FROM matches) WHERE vehicle IS NULL OR seed IS NULL OR vehicle = seed")
def neighbor_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vehicle does not contradict the first row's."""
    return base.matches(spark, sf_dir).selectExpr("query_id", "doc_id", "vehicle", "first_value(vehicle) over (partition by query_id order by rank) as seed").where("vehicle is null or seed is null or vehicle = seed").select("query_id", "doc_id")


@query("neighbor_grid", "SELECT doc_id, count(*) AS ids, min(id) AS first_id FROM (SELECT doc_id, 'p' || p || '_s' || s || '_' || t AS id FROM matches, LATERAL (SELECT unnest(range(page - 2, page + 3)) AS p), (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest(['c1', 'c2', 'c3', 't1', 't2']) AS t) WHERE p >= 1 AND NOT (p = page AND s = 1 AND t = 'c1')) GROUP BY doc_id")
def neighbor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that the neighbours of a page may have, its own first chunk excluded."""
    grid = base.matches(spark, sf_dir).select("doc_id", "page", F.explode(F.expr("sequence(page - 2, page + 2)")).alias("p")).where("p >= 1")
    grid = grid.select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("s")).select("*", F.explode(F.array(*map(F.lit, ("c1", "c2", "c3", "t1", "t2")))).alias("t"))
    ids = grid.where("not (p = page and s = 1 and t = 'c1')").select("doc_id", F.concat(F.lit("p"), F.col("p").cast("string"), F.lit("_s"), F.col("s").cast("string"), F.lit("_"), "t").alias("id"))
    return ids.groupBy("doc_id").agg(F.count("*").alias("ids"), F.min("id").alias("first_id"))


@query("section_lock", """WITH lead AS (SELECT query_id, section AS locked FROM matches WHERE rank = 1)
    SELECT m.query_id, m.doc_id, CAST(row_number() OVER (PARTITION BY m.query_id ORDER BY CASE WHEN m.rank <= 4 THEN 0 ELSE 1 END, m.rank) AS INTEGER) AS new_rank FROM matches m JOIN lead USING (query_id) WHERE m.rank <= 4 OR m.section = locked""")
def section_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matches, then all others of the leading section."""
    m = base.matches(spark, sf_dir).selectExpr("*", "first_value(section) over (partition by query_id order by rank) as locked")
    return m.where("rank <= 4 or section = locked").selectExpr("query_id", "doc_id", "row_number() over (partition by query_id order by if(rank <= 4, 0, 1), rank) as new_rank")


@query("citation_pills", "SELECT query_id, source, page, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, page ORDER BY rank) AS nth FROM matches WHERE score >= 0.30) WHERE nth = 1")
def citation_pills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations over the score limit, the first of each source and page."""
    return base.matches(spark, sf_dir).where("score >= 0.30").selectExpr("query_id", "source", "page", "rank", "row_number() over (partition by query_id, source, page order by rank) as nth").where("nth = 1").drop("nth")


@query("citation_lines", "SELECT query_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ') AS value FROM (SELECT query_id, list(section || ' (' || source || ', p. ' || page || ')' ORDER BY rank) AS l FROM matches GROUP BY query_id)")
def citation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("section", F.lit(" ("), "source", F.lit(", p. "), F.col("page").cast("string"), F.lit(")"))
    rows = base.matches(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return rows.select("query_id", F.array_join(F.array_distinct(F.transform("l", lambda x: x.line)), "; ").alias("value"))


@query("render_context", "SELECT query_id, string_agg('[CTX ' || rank || '] Section: ' || section || ' | Source: ' || source || ' | Page: ' || page || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS value FROM matches WHERE rank <= 6 GROUP BY query_id")
def render_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("[CTX "), F.col("rank").cast("string"), F.lit("] Section: "), "section", F.lit(" | Source: "), "source", F.lit(" | Page: "), F.col("page").cast("string"), F.lit("\n"), "text")
    rows = base.matches(spark, sf_dir).where("rank <= 6").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("l"))
    return rows.select("query_id", F.array_join(F.transform("l", lambda x: x.b), "\n\n---\n\n").alias("value"))


IMAGES = "transform(sequence(1, cast(1 + doc_id % 5 as int)), i -> concat('img', doc_id, '_', i, '.png'))"
oracle_view("match_images", "SELECT query_id, rank, i AS pos, 'img' || doc_id || '_' || i || '.png' AS path FROM matches, LATERAL (SELECT unnest(range(1, 2 + doc_id % 5)) AS i)")


def match_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.matches(spark, sf_dir).select("query_id", "rank", F.posexplode(F.expr(IMAGES)).alias("pos", "path")).withColumn("pos", F.col("pos") + 1)


@query("image_ids", "SELECT query_id, 'IMG_' || row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS image_id, path FROM match_images")
def image_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images numbered once over all matches of a query."""
    return match_images(spark, sf_dir).selectExpr("query_id", "concat('IMG_', row_number() over (partition by query_id order by rank, pos)) as image_id", "path")


@query("image_caps", "SELECT query_id, image_id, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS n FROM (SELECT *, 'IMG_' || row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS image_id FROM match_images) WHERE pos <= 3) WHERE n <= 6")
def image_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the numbered images, three of a match and six of a query at most are shown."""
    numbered = match_images(spark, sf_dir).selectExpr("*", "concat('IMG_', row_number() over (partition by query_id order by rank, pos)) as image_id").where("pos <= 3")
    return numbered.selectExpr("query_id", "image_id", "path", "row_number() over (partition by query_id order by rank, pos) as n").where("n <= 6").drop("n")


@query("image_arrays", "SELECT doc_id, len(p) AS n, array_to_string(list_transform(p, lambda x: upper(x)), ',') AS titles FROM (SELECT doc_id, list_filter(list_transform(range(1, 2 + doc_id % 5), lambda i: CASE WHEN i % 2 = 1 THEN 'img' || i END), lambda x: x IS NOT NULL) AS p FROM documents)")
def image_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(F.transform(F.expr("sequence(1L, 1 + doc_id % 5)"), lambda i: F.when(i % 2 == 1, F.concat(F.lit("img"), i.cast("string")))), lambda x: x.isNotNull())
    return base.table(spark, sf_dir, "documents").select("doc_id", F.size(kept).cast("long").alias("n"), F.array_join(F.transform(kept, F.upper), ",").alias("titles"))


@query("match_json", "SELECT doc_id, '{\"id\":' || doc_id || coalesce(',\"vehicle\":\"' || vehicle || '\"', '') || ',\"page\":' || page || '}' AS value FROM matches")
def match_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as JSON without missing fields."""
    return base.matches(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "vehicle", "page")).alias("value"))


# The atomic facts that grounding looks for.
ATOMS = (
    ("part_number", r"\b[A-Z][0-9]{3,4}[A-Z]{2,4}[0-9]{4,6}[A-Z0-9]*\b"),
    ("torque", r"(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:Nm|N·m|kgf[·.]?m|lb[-·.]?ft)\b"),
    ("page_ref", r"(?i)\bp(?:age|p)?\.?\s*[0-9]{1,4}(?:\.[0-9]+)?\b"),
    ("version", r"(?i)\b(?:REV[-\s]?[0-9]+|v[0-9]+\.[0-9]+)\b"),
)
def _o_again(name: str, source: str, where: str) -> str:
    return f"{name} AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM ({source}) WHERE {where})"


_ROUNDS = """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= top_k THEN rank END, rnd, p, f) AS new_rank FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n,
    row_number() OVER (PARTITION BY query_id, doc_type ORDER BY rank) AS rnd, min(rank) OVER (PARTITION BY query_id, doc_type) AS f, coalesce(list_position(preferred, doc_type), 99) AS p FROM c5)"""


CHAT_CONTEXT = f"""WITH {_o_again('c1', "SELECT * EXCLUDE (rank, off), row_number() OVER (PARTITION BY query_id ORDER BY off, rank) AS rank, count(*) FILTER (NOT off) OVER (PARTITION BY query_id) AS kept FROM (SELECT *, len(topics) > 0 AND len(own_topics) > 0 AND NOT list_has_any(own_topics, topics) AS off FROM asked_matches)", 'rank <= greatest(kept, min_keep)')},
    {_o_again('c2', 'SELECT *, count(*) FILTER (score >= floor * best) OVER (PARTITION BY query_id) AS over_floor FROM (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS best FROM c1)', 'best <= 0 OR CASE WHEN over_floor >= min_keep THEN score >= floor * best ELSE rank <= min_keep END')},
    {_o_again('c3', 'SELECT *, wanted IS NULL OR vehicle IS NULL OR vehicle = wanted AS k, bool_or(wanted IS NULL OR vehicle IS NULL OR vehicle = wanted) OVER (PARTITION BY query_id) AS a FROM c2', 'k OR NOT a')},
    {_o_again('c4', f'SELECT * EXCLUDE (k, a), NOT ({_OFF}) AS k, bool_or(NOT ({_OFF})) OVER (PARTITION BY query_id) AS a FROM c3', 'k OR NOT a')},
    {_o_again('c5', f"SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS b FROM ({_o_hit('c4')})", 'hit OR NOT b')},
    c6 AS (SELECT * EXCLUDE (rank), new_rank AS rank FROM ({_ROUNDS}) WHERE new_rank <= top_k),
    c7 AS (SELECT s.query_id, c.doc_id, s.full_detail FROM c6 s JOIN matches c ON c.source = s.source AND c.page BETWEEN s.page - 2 AND s.page + 2 AND c.doc_id <> s.doc_id WHERE s.rank = 1 AND s.long_form AND s.full_detail AND (c.vehicle IS NULL OR s.vehicle IS NULL OR c.vehicle = s.vehicle)),
    c8 AS (SELECT query_id, doc_id, full_detail, 1 AS src, rank FROM c6 UNION ALL SELECT query_id, doc_id, full_detail, 2, doc_id FROM c7),
    c9 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY src, rank) AS nth FROM c8) WHERE nth = 1)
    SELECT p.query_id, count(*) AS chunks, string_agg('[CTX ' || place || '] ' || m.section || chr(10) || {o_depipe('m.text')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context
    FROM c9 p JOIN matches m ON m.doc_id = p.doc_id WHERE place <= CASE WHEN full_detail THEN 18 ELSE 10 END GROUP BY p.query_id"""


@query("chat_context", CHAT_CONTEXT)
def chat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed chain of a chat turn, from ranked matches to the numbered context."""
    m = base.matches(spark, sf_dir)
    return chat.rendered(chat.context(m, m), m)


# a turn from its question on: every fiftieth vector asks what the question of its number says, in sessions of four
VOICED = 4
_SAID = f"({base._list(base.QUESTIONS)})[CAST(query_id // 50 % {len(base.QUESTIONS)} + 1 AS INTEGER)]"
oracle_view("voiced", f"SELECT query_id // 50 // {VOICED} AS session_id, query_id, query_vec, {_SAID} AS message FROM asked")
oracle_view("heard", f"SELECT *, {CLASS} AS kind, {o_affirm('message')} AS stripped FROM voiced")
oracle_view("heard_roots", "SELECT *, max(CASE WHEN kind <> 'clarification' THEN query_id END) OVER (PARTITION BY session_id ORDER BY query_id) AS root FROM heard")
oracle_view("told", """SELECT query_id, session_id, query_vec, kind, CASE WHEN kind <> 'clarification' THEN stripped ELSE coalesce((SELECT r.message FROM heard_roots r WHERE r.query_id = h.root), '') || ' ' ||
    (SELECT string_agg(regexp_replace(p.message, '^\\s+|\\s+$', '', 'g'), ', ' ORDER BY p.query_id) FROM heard_roots p WHERE p.session_id = h.session_id AND p.kind = 'clarification' AND p.query_id <= h.query_id AND p.root IS NOT DISTINCT FROM h.root) END AS message FROM heard_roots h""".replace("\\\\", "\\"))
oracle_view("refined", o_refine("told", "session_id, query_vec, kind"))
oracle_view("understood", f"""SELECT *, coalesce(facet, (SELECT arg_max(p.facet, p.query_id) FROM faceted p WHERE p.session_id = f.session_id AND p.query_id < f.query_id AND p.facet IS NOT NULL)) AS wanted,
    CAST({o_intent_k('base_k')} AS INTEGER) AS top_k, CAST(greatest({o_profile('intent', 'fetch_k')}, greatest({o_intent_k('base_k')}, 20)) AS INTEGER) AS fetch_k FROM faceted f""")
oracle_view("faceted", f"SELECT query_id, session_id, query_vec, kind, message, {INTENT} AS intent, {o_facet('message')} AS facet, CAST({DYNAMIC} AS INTEGER) AS base_k FROM refined")
_NEAREST = "round(list_cosine_similarity(list_transform(query_vec, lambda x: x::DOUBLE), list_transform({}.vec, lambda x: x::DOUBLE)), 12)"
oracle_view("routed", f"""SELECT u.*, l.chunk_id AS learned_id, CASE WHEN l.chunk_id IS NOT NULL THEN 'learned' WHEN intent IN {o_in(routing.SENSITIVE)} AND wanted IS NULL THEN 'which vehicle' ELSE 'search' END AS route FROM understood u LEFT JOIN (
    SELECT query_id, chunk_id FROM (SELECT query_id, s.chunk_id, {_NEAREST.format('s')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_NEAREST.format('s')} DESC, s.chunk_id) AS n FROM understood CROSS JOIN stored s) WHERE n = 1 AND round(score, 6) >= {ANSWER_SCORE}) l USING (query_id)""")
oracle_view("voiced_matches", f"""SELECT n.query_id, n.rank, m.doc_id, round(n.score, 6) AS score, m.section, m.page, m.doc_type, m.vehicle, m.text, m.source, n.message AS question FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, message, fetch_k, c.chunk_id, {_NEAREST.format('c')} AS score FROM routed JOIN chunks c ON (wanted IS NULL OR c.vehicle IS NULL OR c.vehicle = wanted) AND c.chunk_id <> query_id WHERE route = 'search')) n
    JOIN matches m ON m.doc_id = n.chunk_id WHERE n.rank <= n.fetch_k AND n.score >= 0.05""")


def voiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, base.QUESTIONS)), F.expr(f"cast(query_id div 50 % {len(base.QUESTIONS)} + 1 as int)"))
    return asked(spark, sf_dir).select(F.expr(f"query_id div 50 div {VOICED}").alias("session_id"), "query_id", "query_vec", said.alias("message"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.routed(chat.understood(voiced(spark, sf_dir)), stored(spark, sf_dir))


@query("chat_turns", "SELECT query_id, kind, message AS retrieval, intent, wanted, top_k, fetch_k, learned_id, route FROM routed")
def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a turn makes of each question: text to look up, intent, vehicle, sizes, and whether it is answered, asked back or looked up."""
    return turns(spark, sf_dir).select("query_id", "kind", "retrieval", "intent", "wanted", "top_k", "fetch_k", "learned_id", "route")


@query("chat_matches", "SELECT query_id, rank, doc_id, score, question FROM voiced_matches")
def chat_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked chunks of the questions that are looked up, from their vectors."""
    return chat.found(turns(spark, sf_dir), chunks(spark, sf_dir), base.matches(spark, sf_dir).drop("query_id", "rank", "score", "question")).select("query_id", "rank", "doc_id", "score", "question")


VIEWS["voiced_asked_matches"] = re.sub(r"\bmatches\b", "voiced_matches", VIEWS["asked_matches"])
_VOICED_CONTEXT = re.sub(r"\basked_matches\b", "voiced_asked_matches", CHAT_CONTEXT)


@query("chat_from_vectors", _VOICED_CONTEXT)
def chat_from_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered contexts of the questions that are looked up: from a turn's question and vector through all steps."""
    details = base.matches(spark, sf_dir)
    m = chat.found(turns(spark, sf_dir), chunks(spark, sf_dir), details.drop("query_id", "rank", "score", "question"))
    return chat.rendered(chat.context(m, details), details)


oracle_view("contexts", ORACLES["chat_context"])
_NORM = "regexp_replace(lower({}), '[\\s.\\-_/]+', '', 'g')"


#: What answers add to a document's text: a page and a torque of its own, before the sources that do not count.
_ADDED = "chr(10) || 'See p. ' || CAST(length(t.text) % 97 AS VARCHAR) || ', torque ' || CAST(length(t.text) % 40 AS VARCHAR) || ' Nm.' || chr(10) || 'Sources: p. 9999'"


@query("grounding", "WITH answers AS (SELECT t.doc_id, CASE WHEN t.doc_id >= 0 THEN t.text || " + _ADDED + " ELSE t.text END AS text FROM texts t), bodies AS (SELECT t.doc_id, regexp_replace(t.text, '(?s)\\n\\s*Sources?:.*$', '') AS body, coalesce(c.context, '') AS context FROM answers t LEFT JOIN contexts c ON t.doc_id >= 0 AND c.query_id = t.doc_id // 10), norms AS (SELECT *, " + _NORM.format("context") + " AS held FROM bodies), atoms AS (" + " UNION ALL ".join(f"SELECT doc_id, held, {q(k)} AS kind, unnest(regexp_extract_all(body, {q(p)})) AS value FROM norms" for k, p in ATOMS) + f""")
    SELECT doc_id, kind, value, contains(held, {_NORM.format('value')}) OR (kind = 'page_ref' AND contains(held, regexp_extract(value, '[0-9]+'))) AS supported FROM atoms""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atomic facts of answers (before their sources line) and whether their own question's context has them."""

    def of(kind: str, pattern: str):
        flag, bare = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
        return F.transform(F.regexp_extract_all("body", F.lit(f"{flag}({bare})"), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(*[of(k, p) for k, p in ATOMS])
    size = F.length("text")
    added = F.concat(F.lit("\nSee p. "), (size % 97).cast("string"), F.lit(", torque "), (size % 40).cast("string"), F.lit(" Nm.\nSources: p. 9999"))
    answers = base.texts(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") >= 0, F.concat("text", added)).otherwise(F.col("text")).alias("text"))
    # a row of its own (explode) holds the body, so that no kind of fact cuts it again
    bodies = answers.select("doc_id", F.explode(F.array(F.regexp_replace("text", r"(?s)\n\s*Sources?:.*$", ""))).alias("body"))
    atoms = bodies.select("doc_id", F.explode(found).alias("a")).select("doc_id", F.when(F.col("doc_id") >= 0, F.expr("doc_id div 10")).alias("query_id"), "a.*")
    # every document's answer has a page of its own added: all questions have facts, and need their contexts
    m = base.matches(spark, sf_dir)
    contexts = chat.rendered(chat.context(m, m), m).select("query_id", T.ground_norm(F.col("context")).alias("held"))
    held = F.coalesce("held", F.lit(""))
    paged = (F.col("kind") == "page_ref") & F.contains(held, F.regexp_extract("value", "([0-9]+)", 1))
    return atoms.join(contexts, "query_id", "left").select("doc_id", "kind", "value", (F.contains(held, T.ground_norm(F.col("value"))) | paged).alias("supported"))
