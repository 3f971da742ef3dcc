"""Exact top-k inner product search by MaxScore over sharded postings.

A dimension is a term, its posting the vectors whose component there is not
zero. A term's bound is the largest contribution that the query's component
times any component of the posting can make (zero at least). While the bounds of
the smallest terms sum to less than the k-th best score so far, those terms are
non-essential: a vector found in their postings alone cannot compete. Essential
postings are traversed; candidates are then probed in the other terms, largest
bound first, only while partial score plus remaining bounds is competitive.
Shards work alone; their k best per query are merged.

Every vector goes to one shard, once. Queries go to all shards and pass each one's
postings in small batches, so that a task holds one shard (bounded in bytes) and one
batch of queries, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, tune

#: Vectors of a shard while there are few (up to SHARDS shards), and bytes of one when there are many.
SHARD_ROWS = 8192
SHARDS = 64
SHARD_BYTES = 64 << 20
#: Candidates traversed before the threshold is looked at again, and terms probed at a time.
STRIDE = 1024
PROBES = 8


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """row (unique), vec_id and v (floor(scale * x) of every component) of the usable rows.

    Null vectors and vectors with a null, non-finite or (scaled) more than
    64-bit component take no part.
    """
    x = f"try_cast(floor({scale}D * cast(x as double)) as bigint)"
    usable = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
    rows = vectors.selectExpr("vec_id", "embedding").where(usable).selectExpr("vec_id", f"transform(embedding, x -> {x}) as v")
    return rows.where("not exists(v, x -> x is null)").select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def _matrix(rows: pa.ListArray) -> np.ndarray:
    """Vectors as columns: one row for each dimension; shorter vectors end in zeros."""
    size = rows.value_lengths().to_numpy()
    flat = rows.flatten().to_numpy()
    width = int(size.max()) if len(size) else 0
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width).T.copy()
    out = np.zeros((width, len(size)), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[at, np.repeat(np.arange(len(size)), size)] = flat
    return out


class Shard:
    """Postings of one shard, candidates in the order of their ids (unknown ones last)."""

    def __init__(self, ids: np.ndarray, unknown: np.ndarray, rows: np.ndarray, columns: np.ndarray):
        order = np.lexsort((rows, ids, unknown))
        self.ids, self.unknown, self.rows = ids[order], unknown[order], rows[order]
        #: Posting entries that searches have read so far.
        self.touched = 0
        self.columns = columns[:, order]
        self.high = np.maximum(self.columns.max(axis=1, initial=0), 0).astype(float)
        self.low = np.minimum(self.columns.min(axis=1, initial=0), 0).astype(float)
        self.largest = np.abs(self.columns).max(initial=0)
        self.exact = None

    def values(self, query: np.ndarray) -> np.ndarray:
        """The postings as doubles where sums stay exact in them, else as 64-bit integers."""
        if float(self.largest) * float(np.abs(query).max(initial=0)) * max(1, len(query)) >= 2**52:
            return self.columns
        if self.exact is None:
            self.exact = self.columns.astype(float)
        return self.exact

    def top(self, query: np.ndarray, own_row: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates (positions) and scores of the k best other rows, ties to the smaller id."""
        n = min(len(query), len(self.columns))
        query = query[:n]
        bound = np.maximum(np.maximum(query * self.high[:n], query * self.low[:n]), 0)
        terms = np.flatnonzero(query)
        terms = terms[np.argsort(-bound[terms], kind="stable")]
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0.0)  # rest[i]: bounds of terms i and on
        values = self.values(query)
        weight = query.astype(values.dtype)
        best_at, best = np.zeros(0, np.int64), np.zeros(0, values.dtype)
        threshold = -np.inf
        for lo in range(0, len(self.ids), STRIDE):
            hi = min(lo + STRIDE, len(self.ids))
            essential = int(np.searchsorted(-rest, -threshold, side="right")) if threshold > 0 else len(terms)
            essential = min(essential, len(terms))
            part = terms[:essential]
            score = weight[part] @ values[part, lo:hi] if essential else np.zeros(hi - lo, values.dtype)
            self.touched += essential * (hi - lo)
            at = np.arange(lo, hi)
            live = self.rows[lo:hi] != own_row
            if threshold > 0:
                live &= (values[part, lo:hi] != 0).any(axis=0) if essential < len(terms) else True
            for step in range(essential, len(terms) + PROBES, PROBES):
                live &= score + rest[min(step, len(terms))] >= threshold
                at, score, live = at[live], score[live], np.ones(int(live.sum()), bool)
                if step >= len(terms) or not len(at):
                    break
                more = terms[step : step + PROBES]
                self.touched += len(more) * len(at)
                score = score + weight[more] @ values[np.ix_(more, at)]
            if len(at):
                best_at, best = np.append(best_at, at), np.append(best, score)
                order = np.lexsort((best_at, -best))[:k]
                best_at, best = best_at[order], best[order]
                if len(best) == k:
                    threshold = float(best[-1])
        return best_at, best


def _search(k: int):
    """Passes rows sorted by shard, each shard's vectors before its queries."""

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
                    continue
                if not held and shard is None:
                    continue
                if shard is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    ids = rows["vec_id"].combine_chunks()
                    columns = _matrix(rows["v"].chunk(0))
                    shard = Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), rows["row"].to_numpy(), columns)
                    held = []
                yield _answers(shard, part, k)

    return run


def _answers(shard: Shard, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
    row, key, found, scores, n = queries.column(2).to_numpy(), queries.column(3).to_numpy(), [], [], []
    for own, query in zip(row, _matrix(queries.column(4)).T):
        at, score = shard.top(query, own, k)
        found.append(at)
        scores.append(score.astype(np.int64))
        n.append(len(at))
    at = np.concatenate(found)
    arrays = [pa.array(np.repeat(row, n)), pa.array(np.repeat(key, n)), pa.array(shard.ids[at], mask=shard.unknown[at]), pa.array(np.concatenate(scores))]
    return pa.RecordBatch.from_arrays(arrays, ["row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every row whose vec_id is divisible by ``every``.

    ``vectors(vec_id, embedding, ...)``: every usable row but the query's own is a
    candidate. A repeated vec_id is a row of its own, as query and as candidate.
    Null ids are never queries, and as candidates come last among ties. Shorter
    vectors count as ending in zeros. Sums beyond 64 bits are not defined. Other
    columns are ignored; an empty table gives an empty result.
    """
    tune(vectors.sparkSession)
    rows = keep(quantised(vectors, scale).withColumn("vec_id", F.col("vec_id").cast("long")))
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("cells")).first()
    shards = max(1, -(-8 * sizes.cells // SHARD_BYTES), min(SHARDS, -(-sizes.n // shard_rows)))
    own = rows.select(F.expr(f"cast(pmod(xxhash64(row), {shards}) as int)").alias("shard"), F.lit(0).alias("kind"), "row", "vec_id", "v")
    asked = rows.where(f"vec_id % {every} = 0").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "row", "vec_id", "v")
    dealt = own.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    ranked = found.selectExpr("*", "row_number() over (partition by row order by score desc, vec_id asc nulls last) as rank").where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
