"""Retrieval and post-filters over ranked matches: order is an explicit rank, guards never empty a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions import routing

#: Chunks of a shard while there are few (up to SHARDS shards), and bytes of one when there are many.
SHARD_ROWS = 8192
SHARDS = 64
SHARD_BYTES = 64 << 20
#: Bytes of scores that a task holds at a time: so many queries meet a shard together, one at least.
SCORE_BYTES = 64 << 20


def _query() -> WindowSpec:
    return W.partitionBy("query_id")


def _ranked() -> WindowSpec:
    return _query().orderBy("rank")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in component order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def facet_filter(vehicle: Column, wanted: Column) -> Column:
    """Same vehicle or none stored; without a wanted one, everything."""
    return wanted.isNull() | vehicle.isNull() | (vehicle == wanted)


class _Shard:
    """Unit vectors of some chunks by dimension, chunk ids in order, and their facets as numbers."""

    def __init__(self, rows: pa.Table):
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        facet = rows["facet"].combine_chunks().dictionary_encode()
        code = facet.indices.fill_null(-1).to_numpy()
        self.codes = {x: i for i, x in enumerate(facet.dictionary.to_pylist())}
        vectors = rows["vec"].combine_chunks()
        self.parts = {n: (ids[at], code[at], unit) for n, at, unit in _units(vectors, order)}

    def best(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        ids, wanted, out = queries.column(2).to_numpy(), queries.column(4).to_pylist(), ([], [], [])
        for n, which, unit in _units(queries.column(3), np.arange(queries.num_rows)):
            if n not in self.parts:
                continue
            keys, code, held = self.parts[n]
            together = max(1, SCORE_BYTES // (8 * len(keys)))
            for lo in range(0, len(which), together):
                scores = unit[lo : lo + together] @ held.T
                for row, score in zip(which[lo : lo + together], np.round(scores, 12, out=scores)):
                    facet = wanted[row]
                    open_ = (keys != ids[row]) if facet is None else (keys != ids[row]) & ((code == -1) | (code == self.codes.get(facet, -2)))
                    at = np.flatnonzero(open_)
                    if len(at) > k:
                        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
                    at = at[np.argsort(-score[at], kind="stable")][:k]
                    out[0].append(np.full(len(at), ids[row]))
                    out[1].append(keys[at])
                    out[2].append(score[at])
        merged = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.RecordBatch.from_arrays([pa.array(merged[0].astype(np.int64)), pa.array(merged[1].astype(np.int64)), pa.array(merged[2], pa.float64())], ["query_id", "chunk_id", "score"])


def _units(vectors: pa.ListArray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, places and unit vectors of the usable vectors (not null, no null component, not zero)."""
    size = np.where(vectors.is_null(), 0, vectors.value_lengths().fill_null(0).to_numpy())
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    for n in np.unique(size[size > 0]):
        at = order[size[order] == n]
        rows = flat[first[at][:, None] + np.arange(n)]
        norm = np.sqrt((rows * rows).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        yield int(n), at[good], rows[good] / norm[good][:, None]


def _search(k: int):
    """Passes rows sorted by shard, each shard's chunks before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, shard = None, [], None
        for batch in batches:
            place = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            edges = np.flatnonzero(np.append(True, place[1:] != place[:-1]))[: len(place)].tolist()
            for lo, hi in zip(edges, [*edges[1:], len(place)]):
                part = batch.slice(lo, hi - lo)
                if place[lo] // 2 != number:
                    number, held, shard = place[lo] // 2, [], None
                if place[lo] % 2 == 0:
                    held.append(part)
                elif held or shard:
                    shard = shard or _Shard(pa.Table.from_batches(held))
                    held = []
                    yield shard.best(part, k)

    return run


def knn(queries: DataFrame, chunks: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """The k most similar chunks of every query; ``min_score`` applies after the cut to k.

    ``queries(query_id, query_vec, wanted)``, ``chunks(chunk_id, vec, vehicle)``. Every
    chunk goes to one shard, once, where its unit vector is made once; queries pass
    all shards in batches and meet a shard as matrix products. A task holds one
    shard and the scores of a few queries, both bounded in bytes. Ties go to the smaller chunk_id. A vector that is null,
    zero or of another dimension is like none.
    """
    sizes = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("cells")).first()
    shards = max(1, -(-8 * sizes.cells // SHARD_BYTES), min(SHARDS, -(-sizes.n // SHARD_ROWS)))
    row = ["shard", "kind", "id", "vec", "facet"]
    own = chunks.where("vec is not null").select(F.expr(f"cast(pmod(xxhash64(chunk_id), {shards}) as int)"), F.lit(0), F.col("chunk_id").cast("long"), F.col("vec").cast("array<double>"), "vehicle").toDF(*row)
    asked = queries.where("query_vec is not null").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), F.lit(1), F.col("query_id").cast("long"), F.col("query_vec").cast("array<double>"), "wanted").toDF(*row)
    dealt = own.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    scored = dealt.mapInArrow(_search(k), "query_id long, chunk_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    top = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    return top if min_score is None else top.where(F.col("score") >= min_score)


def guarded(matches: DataFrame, keep: Column) -> DataFrame:
    """Rows to keep; all rows of a query of which none would stay."""
    marked = matches.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    return marked.withColumn("_any", F.bool_or("_keep").over(_query())).where("_keep or not _any").drop("_keep", "_any")


def reranked(matches: DataFrame) -> DataFrame:
    """Ranks without gaps, in the same order."""
    return matches.withColumn("rank", F.row_number().over(_ranked()).cast("long"))


def score_floor(matches: DataFrame, floor: float | Column, min_keep: int | Column) -> DataFrame:
    """Scores at or over a share of the query's first score, ``min_keep`` rows at least; all if the first is not positive."""
    top = F.first_value("score").over(_ranked())
    marked = matches.withColumn("_top", top)
    over = F.col("score") >= floor * F.col("_top")
    counted = marked.withColumn("_kept", F.count_if(over).over(_query()))
    stays = (F.col("_top") <= 0) | F.when(F.col("_kept") >= min_keep, over).otherwise(F.col("rank") <= min_keep)
    return counted.where(stays).drop("_top", "_kept")


def vehicle_purity(matches: DataFrame, wanted: Column) -> DataFrame:
    """Rows of the wanted vehicle or of none; all rows where no vehicle is wanted."""
    return guarded(matches, facet_filter(F.col("vehicle"), wanted))


def by_rounds(matches: DataFrame, preferred: Column, keep: int | Column) -> DataFrame:
    """Document types in turns, preferred ones (an array) first, others by first appearance; short lists stay as they are."""
    place = F.array_position(preferred, F.col("doc_type"))
    rows = (
        matches.withColumn("_n", F.count("*").over(_query()))
        .withColumn("_round", F.row_number().over(W.partitionBy("query_id", "doc_type").orderBy("rank")))
        .withColumn("_first", F.min("rank").over(W.partitionBy("query_id", "doc_type")))
        .withColumn("_place", F.when(place > 0, place).otherwise(F.lit(99)))
    )
    order = F.when(F.col("_n") <= keep, F.col("rank"))
    turned = rows.withColumn("new_rank", F.row_number().over(_query().orderBy(order, "_round", "_place", "_first")))
    return turned.where(F.col("new_rank") <= keep).select(*matches.columns, "new_rank")


def merged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both lists in order, the first of equal keys; rows without a key all stay."""
    both = first.withColumn("_src", F.lit(1)).unionByName(second.withColumn("_src", F.lit(2)))
    nth = F.row_number().over(W.partitionBy("query_id", key).orderBy("_src", "rank"))
    return both.withColumn("_nth", nth).where(F.col(key).isNull() | (F.col("_nth") == 1)).withColumn("new_rank", F.row_number().over(_query().orderBy("_src", "rank"))).drop("_src", "_nth")


#: Characters of a chunk's text that tell its subsystem.
BODY_CHARS = 600


def chunk_topics() -> Column:
    """Topics of a chunk's section and of the head of its text."""
    return F.array_union(routing.topics(F.col("section")), routing.topics(F.left("text", F.lit(BODY_CHARS))))


def on_diagnosis(question: Column, intent: Column) -> Column:
    """False for chunks of other subsystems where a question is about a battery or charging fault."""
    focused = (intent == "diagnostic") & routing.has(question, routing.BATTERY)
    return ~focused | ~routing.has(F.lower(F.concat("section", F.lit("\n"), "text")), routing.OFF_DIAGNOSTIC)


def on_procedure(question: Column, intent: Column) -> Column:
    """Whether a chunk has a phrase or two terms of a question about a procedure; true for other questions."""
    hay = F.lower(F.concat("section", F.lit("\n"), "text"))
    phrases, terms = routing.key_phrases(question), routing.key_terms(question)
    bare = (F.size(phrases) == 0) & (F.size(terms) == 0)
    return (intent != "procedure") | bare | F.exists(phrases, lambda p: F.contains(hay, p)) | (F.size(F.filter(terms, lambda t: F.contains(hay, t))) >= 2)


def diagnostic_focus(matches: DataFrame, on: Column) -> DataFrame:
    return guarded(matches, on)


def procedure_focus(matches: DataFrame, on: Column) -> DataFrame:
    """The first two matches, and those on the procedure."""
    return guarded(matches, (F.col("rank") <= 2) | on)


def dominant_section(matches: DataFrame, question: Column) -> DataFrame:
    """query_id and the section to expand on (null: none).

    The section whose name holds most keywords of the question's topics and words; else
    the first match's on a clear gap of scores, if its topics meet the question's; else
    the majority's.
    """
    asked = routing.topics(question)
    words = F.filter(F.transform(F.split(F.lower(question), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,?!:;()'\"]+|[.,?!:;()'\"]+$", "")), lambda w: F.length(w) >= 4)
    keys = F.array_distinct(F.concat(words, *[F.when(F.array_contains(asked, name), F.array(*map(F.lit, found))).otherwise(F.array().cast("array<string>")) for name, found in routing.TOPICS.items()]))
    rows = matches.withColumn("_asked", asked).withColumn("_keys", keys)
    rows = rows.withColumn("_hits", F.when(F.size("_asked") > 0, F.size(F.filter("_keys", lambda x: F.contains(F.lower(F.col("section")), x)))).otherwise(0))
    named = rows.groupBy("query_id").agg(
        F.min_by("section", F.when(F.col("_hits") > 0, F.struct(-F.col("_hits"), -F.col("score"), "rank"))).alias("named"),
        F.max_by("section", -F.col("rank")).alias("lead"),
        F.max_by((F.size("_asked") == 0) | F.arrays_overlap("_asked", chunk_topics()), -F.col("rank")).alias("_on"),
    )
    gaps = named.join(median_gap(matches).select("query_id", F.col("gap") & (F.col("middle") > 0)), "query_id").toDF("query_id", "named", "lead", "_on", "gap")
    return gaps.join(majority(matches), "query_id", "left").select("query_id", F.coalesce("named", F.when(F.col("gap") & F.col("_on"), F.col("lead")), "section").alias("section"))


def section_relevance(matches: DataFrame, question_topics: Column, chunk_topics: Column, min_keep: int | Column) -> DataFrame:
    """Chunks whose topics are empty or meet the question's; rejected ones fill up to ``min_keep``, behind the others."""
    off = (F.size(question_topics) > 0) & (F.size(chunk_topics) > 0) & ~F.arrays_overlap(question_topics, chunk_topics)
    marked = matches.withColumn("_off", off).withColumn("_on", F.count_if(~F.col("_off")).over(_query())).withColumn("new_rank", F.row_number().over(_query().orderBy("_off", "rank")))
    return marked.where(F.col("new_rank") <= F.greatest(F.col("_on"), F.lit(min_keep))).drop("_off", "_on")


def median_gap(matches: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Queries whose first score is at least ``ratio`` times the middle of the other scores (the lower one of two)."""
    best = F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top")
    rest = F.reverse(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.col("score"))))).alias("rest")
    grouped = matches.groupBy("query_id").agg(best, rest)
    middle = F.try_element_at("rest", (F.floor(F.size("rest") / 2) + 1).cast("int"))
    return grouped.select("query_id", "top", middle.alias("middle"), F.coalesce(F.col("top") >= ratio * middle, F.lit(False)).alias("gap"))


def majority(matches: DataFrame, top: int = 3, share: float = 0.5) -> DataFrame:
    """The most frequent section of the first rows if it has its share; the first seen wins ties."""
    seen = matches.where(F.col("rank") <= top).groupBy("query_id", "section").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    ranked = seen.withColumn("_place", F.row_number().over(_query().orderBy(F.desc("n"), "first"))).withColumn("_all", F.sum("n").over(_query()))
    return ranked.where((F.col("_place") == 1) & (F.col("n") >= share * F.col("_all"))).select("query_id", "section", "n")


def neighbours(matches: DataFrame, chunks: DataFrame, pages: int = 2, most: int | None = None) -> DataFrame:
    """Chunks of the same source within some pages of a match, itself excluded, foreign vehicles left out.

    The range becomes an equality join on (source, page) by listing each seed's
    few pages, so that a source with many rows is spread over its pages. With ``most``
    each match gets those of its ``most`` smallest doc_ids, and their pairs alone are made: of a page and
    vehicle no others than the ``most`` + 1 smallest (the match may be one) can be among them.
    """
    seeds = matches.select("query_id", F.col("doc_id").alias("seed_id"), "source", F.col("vehicle").alias("seed_vehicle"), F.explode(F.sequence(F.col("page") - pages, F.col("page") + pages)).alias("page"))
    own = chunks.select("doc_id", "source", "page", "vehicle")
    first = lambda df, n, *keys: df.withColumn("_place", F.dense_rank().over(W.partitionBy(*keys).orderBy("doc_id"))).where(F.col("_place") <= n).drop("_place")
    if most is not None:
        own = first(own.where("doc_id is not null"), most + 1, "source", "page", "vehicle")
    found = seeds.join(own, ["source", "page"]).where("doc_id <> seed_id")
    near = found.where("vehicle is null or seed_vehicle is null or vehicle = seed_vehicle").select("query_id", "seed_id", "doc_id", F.lit(0.0).alias("score"))
    return near if most is None else first(near, most, "query_id", "seed_id")
