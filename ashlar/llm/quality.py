"""Quality classifier: hashed word n-gram logistic regression with FTRL updates.

Tokens are maximal runs of one byte class (letters, digits, other symbols), so
that ``word###`` gives a word and a symbol run. Features are hashed unigrams and
bigrams, and for n-grams that end as they begin (a token equal to the one 1 to
``LAGS`` places before) one feature for each distance, whatever the token. A
document's value of a feature is its share of all tokens times ``SCALE``, and
its score the logistic of the sparse dot product with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import is_held, one_text, sampled, tune
from .ftrl import Ftrl, sigmoid

BITS = 18
SCALE = 32.0
LAGS = 4
#: Bound of the labelled rows that training reads; one task holds their hashed features.
TRAIN_ROWS = 4000
EPOCHS = 6
THRESHOLD = 0.3


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature and document number of every unigram, bigram and returning n-gram."""
    starts, ends, _, doc = kernel.runs(kernel.CLASS[data], offsets)
    hashed = kernel.xxh64(data, starts, ends)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    both = kernel.mix(hashed[pair], hashed[pair + 1])
    parts, owners = [hashed, both], [doc, doc[pair]]
    for lag in range(1, LAGS + 1):
        again = np.flatnonzero((hashed[lag:] == hashed[:-lag]) & (doc[lag:] == doc[:-lag]))
        parts.append(np.full(len(again), kernel.mix(np.array([lag], np.uint64), kernel.P5)[0]))
        owners.append(doc[again])
    feature = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
    return feature, np.concatenate(owners)


def logits(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.full(len(offsets) - 1, weights[-1])
    for lo, hi in kernel.slices(offsets):
        feature, doc = occurrences(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n = np.maximum(np.bincount(doc, minlength=hi - lo), 1)
        out[lo:hi] += SCALE * kernel.group_sums(weights[feature], doc, hi - lo) / n
    return out


def train(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the bias last) from one buffer of whole texts; the order of updates follows a fixed seed."""
    rows = []
    for lo, hi in kernel.slices(offsets):
        feature, doc = occurrences(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for d in range(hi - lo):
            index, count = np.unique(feature[doc == d], return_counts=True)
            value = SCALE * count / max(1, count.sum())
            rows.append((np.append(index, 1 << BITS), np.append(value, 1.0)))
    model = Ftrl(1 << BITS, alpha=0.5, beta=1.0, l1=0.02, l2=0.001)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            index, value = rows[i]
            weight = model.weights(index)
            model.update(index, weight, loss_slope(weight, value, labels[i]))
    return model.weights().astype(np.float32)


def loss_slope(weight: np.ndarray, value: np.ndarray, label: float) -> np.ndarray:
    """How the log loss of one document changes with each of its weights."""
    return (sigmoid(weight @ value) - label) * value


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [b for b in batches if b.num_rows]
    weights = np.zeros((1 << BITS) + 1, np.float32)
    if found:
        rows = pa.Table.from_batches(found).sort_by([("doc_id", "ascending"), ("label", "ascending")])
        data, offsets = kernel.flat(rows["text"])
        weights = train(data, offsets, rows["label"].to_numpy().astype(float))
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()])], ["model"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and label of at most about ``rows`` rows that are not held out.

    The ids are chosen by hash from the labels alone; only that bounded list is
    joined with the texts. A null label, text or id is not learned from. An id
    that repeats gives one row, that of the text with the smallest hash.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~is_held("doc_id", 5, 0))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = sampled(known, "doc_id", rows, known.count())
    return one_text(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned by one task from the bounded sample of ``labelled``."""
    tune(docs.sparkSession)
    sample = labelled(docs, labels, label, rows)
    held = sample.repartition(1).mapInArrow(_train_batches, "model binary").first()
    return np.frombuffer(held[0], np.float32) if held else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; an empty or null text scores by the bias alone."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.astype(float)
        for batch in batches:
            value = sigmoid(logits(*kernel.flat(batch.column(1)), own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(value), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", is_held("doc_id", 5, 0).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Scores of ``docs(doc_id, text, ...)`` after learning from ``labels(doc_id, quality, ...)``.

    Every row of ``docs`` gives one row, repeated ids included. Without any
    usable label all scores are 0.5. A doc_id that is labelled twice counts with
    its larger label. A text of any length is scored whole; an empty table gives an
    empty result.
    """
    return score(docs, fit(docs, labels, "quality", rows))


def accepted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the model predicts as 1.

    The batch itself is filtered where it is scored: no join, no shuffle.
    """
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, "quality", rows))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.astype(float)
        for batch in batches:
            value = sigmoid(logits(*kernel.flat(batch.column(place)), own))
            yield batch.filter(pa.array(value >= threshold))

    return docs.mapInArrow(run, docs.schema)
