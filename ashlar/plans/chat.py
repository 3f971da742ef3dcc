"""The answer context of questions: post-filters over ranked matches in the order of a chat turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import routing
from ..functions import text as T
from ..operators import retrieval as R
from ..session import cut

#: Chunks of an answer, and of one that is asked for in full.
ANSWER_CHUNKS, FULL_CHUNKS = 10, 18


def asked(matches: DataFrame) -> DataFrame:
    """``matches`` with what the policy reads from each row's ``question``."""
    q = F.col("question")
    rows = matches.select("*", routing.intent(q).alias("intent"), routing.vehicle_facet(q).alias("wanted"), routing.topics(q).alias("topics"), routing.has(q, routing.FULL_DETAIL).alias("full_detail"))
    types = routing.first_case([(F.col("intent") == label, F.array(*map(F.lit, types))) for label, types in routing.facts(routing.INTENT_FACTS, "doc_type").items()], F.array().cast("array<string>"))
    return rows.select("*", types.alias("preferred"), *(routing.profile_value(F.col("intent"), f).alias(f) for f in ("floor", "min_keep", "top_k", "long_form")))


def context(matches: DataFrame, chunks: DataFrame, pages: int = 2) -> DataFrame:
    """query_id, rank, doc_id, score and question of the chunks that each question's answer is written from.

    ``matches``: ranked rows with a question; ``chunks``: where a full answer's page
    neighbours come from. Topics, floor, vehicle, diagnostic and procedure focus, turns
    of document types, neighbours, cap: every step keeps a query that had rows.
    """
    q, intent = F.col("question"), F.col("intent")
    # what texts tell is told first: no sort carries a text
    m = asked(matches).select("*", R.chunk_topics().alias("own_topics"), R.on_diagnosis(q, intent).alias("diagnosed"), R.on_procedure(q, intent).alias("proceeds")).drop("text", "section")
    m = m.select("query_id", "rank", "doc_id", "score", "doc_type", "vehicle", "source", "page", "question", "intent", "wanted", "topics", "own_topics", "full_detail", "long_form", "preferred", "floor", "min_keep", "top_k", "diagnosed", "proceeds")
    m = R.section_relevance(m, F.col("topics"), F.col("own_topics"), F.col("min_keep"))
    m = m.withColumn("rank", F.col("new_rank").cast("long")).drop("new_rank", "topics", "own_topics")
    m = R.score_floor(m, F.col("floor"), F.col("min_keep"))
    m = R.diagnostic_focus(R.vehicle_purity(m, F.col("wanted")), F.col("diagnosed"))
    m = R.procedure_focus(R.reranked(m), F.col("proceeds"))
    m = R.by_rounds(m, F.col("preferred"), F.col("top_k"))
    m = m.withColumn("rank", F.col("new_rank").cast("long")).drop("new_rank")
    m = cut(m)  # without texts: rows and seeds are read from it, so that the steps before are taken once
    seeds = m.where("rank = 1 and long_form and full_detail")
    # of neighbours in the order of their ids no more than the cap are kept; ids that the query has are passed over in
    # places that its own rows take, so that the first ones suffice
    near = R.neighbours(seeds, chunks, pages, FULL_CHUNKS).join(seeds.select("query_id", "question", "full_detail"), "query_id")
    near = near.select("query_id", F.col("doc_id").alias("rank"), "doc_id", "score", "question", "full_detail")
    both = R.merged(m.select("query_id", "rank", "doc_id", "score", "question", "full_detail"), near, "doc_id")
    cap = F.when(F.col("full_detail"), FULL_CHUNKS).otherwise(ANSWER_CHUNKS)
    return both.where(F.col("new_rank") <= cap).select("query_id", F.col("new_rank").cast("long").alias("rank"), "doc_id", "score", "question")


def rendered(picked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, number of chunks and the numbered context, from picked rows and ``chunks(doc_id, section, text)``."""
    rows = picked.join(chunks.select("doc_id", "section", "text"), "doc_id")
    block = F.concat(F.lit("[CTX "), F.col("rank").cast("string"), F.lit("] "), "section", F.lit("\n"), T.depipe(F.col("text")))
    held = rows.groupBy("query_id").agg(F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("l"))
    return held.select("query_id", "chunks", F.array_join(F.transform("l", lambda x: x.b), "\n\n---\n\n").alias("context"))


#: Score from which a stored question's answer is given as it is.
ANSWER_SCORE = 0.85
#: Chunks that are fetched for a question at most: the most of any intent.
MOST_FETCHED = max(k for (k,) in routing.facts(routing.INTENT_FACTS, "fetch_k").values())


def understood(questions: DataFrame) -> DataFrame:
    """``questions(session_id, query_id, message[, ...])`` with what a turn makes of each.

    kind (follow-up, clarification or standalone), retrieval (the text to look up: a
    clarification joins the question it belongs to and the replies between;
    affirmations go, terms are added), intent, vehicle, wanted (the vehicle's facet:
    of the text, else of the newest earlier question of the session that names one),
    top_k and fetch_k. A session is one window; null messages count as empty.
    """
    earlier = W.partitionBy("session_id").orderBy("query_id")
    said = questions.withColumn("message", T.nz(F.col("message"))).withColumn("kind", routing.message_class(F.col("message")))
    reply = F.col("kind") == "clarification"
    rooted = said.withColumn("_root", F.last_value(F.when(~reply, F.col("query_id")), True).over(earlier)).withColumn("_asked", F.last_value(F.when(~reply, F.col("message")), True).over(earlier))
    replies = F.collect_list(F.when(reply, T.strip(F.col("message")))).over(W.partitionBy("session_id", "_root").orderBy("query_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = F.concat(T.nz(F.col("_asked")), F.lit(" "), F.array_join(replies, ", "))
    text = rooted.withColumn("_text", F.when(reply, joined).otherwise(routing.affirm_strip(F.col("message")))).withColumn("retrieval", routing.refine(F.col("_text"))).drop("_root", "_asked", "_text")
    r = F.col("retrieval")
    facet = routing.vehicle_facet(r)
    before = F.last_value(facet, True).over(earlier.rowsBetween(W.unboundedPreceding, -1))
    known = text.withColumn("intent", routing.intent(r)).withColumn("vehicle", routing.vehicle(r)).withColumn("wanted", F.coalesce(facet, before))
    sized = known.withColumn("top_k", routing.intent_k(F.col("intent"), routing.dynamic_k(r)))
    return sized.withColumn("fetch_k", routing.fetch_k(F.col("intent"), F.col("top_k")))


def routed(asked: DataFrame, learned: DataFrame) -> DataFrame:
    """Understood questions with ``query_vec``, and route and learned_id of each.

    ``learned``: stored questions as ``chunks`` of a search. A near one answers ('learned');
    a question about what differs between vehicles that names none is asked back
    ('which vehicle'); all others are looked up ('search').
    """
    vectors = asked.select("query_id", "query_vec", F.lit(None).cast("string").alias("wanted"))
    best = R.knn(vectors, learned, 1).where(F.round("score", 6) >= ANSWER_SCORE).select("query_id", F.col("chunk_id").alias("learned_id"))
    unclear = F.col("intent").isin(*routing.SENSITIVE) & F.col("wanted").isNull()
    route = F.when(F.col("learned_id").isNotNull(), "learned").when(unclear, "which vehicle").otherwise("search")
    return asked.join(best, "query_id", "left").withColumn("route", route)


def found(turns: DataFrame, chunks: DataFrame, details: DataFrame, min_score: float = 0.05) -> DataFrame:
    """Ranked matches of the turns that are looked up: each question's fetch_k nearest chunks, at least ``min_score`` near.

    ``chunks(chunk_id, vec, vehicle)`` are searched within the wanted vehicle;
    ``details(doc_id, section, page, doc_type, vehicle, text, source)`` says what they hold.
    """
    look = turns.where("route = 'search'")
    near = R.knn(look.select("query_id", "query_vec", "wanted"), chunks, MOST_FETCHED, min_score)
    kept = near.join(look.select("query_id", F.col("retrieval").alias("question"), "fetch_k"), "query_id").where("rank <= fetch_k")
    return kept.join(details, F.col("chunk_id") == F.col("doc_id")).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"), "section", "page", "doc_type", "vehicle", "text", "source", "question")
