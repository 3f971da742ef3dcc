"""Toxicity by multiple-instance learning over sentences.

A sentence's logit is the bias plus the weights of its words (hashed, A-Z
lower-cased) and of the words' beginnings of ``PREFIXES`` bytes, which carry
inflected forms. A document is toxic unless every sentence is not:
``1 - prod(1 - p_s)``, the noisy-or. Document labels train the sentence weights
through that formula; afterwards the sentence scores locate what offends.

Of a sentence's hazard only what exceeds that of a probability of ``FLOOR`` counts in
full. What lies below is background, of which a document has no more than
``BACKGROUND`` sentences of the initial bias: neutral sentences do not add up to a
toxic text at any length. Training and scoring use this same formula; it was chosen
by cross-validation within the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import is_held, tune
from .ftrl import Ftrl, sigmoid
from .quality import labelled

BITS = 18
#: Bound of the labelled rows that training reads; one task holds their hashed words.
TRAIN_ROWS = 8000
EPOCHS = 8
THRESHOLD = 0.5
BIAS = -6.0
#: Sentence probability up to which a sentence is background, and the neutral sentences that a document's background counts at most.
FLOOR = 0.01
BACKGROUND = 16
PREFIXES = (4, 5, 6, 7, 8)
#: Bytes that end a sentence.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


def instances(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashed feature and sentence number, by sentence; of every sentence its document, first and last byte."""
    low = kernel.lower_ascii(data)
    starts, ends, kind, doc = kernel.runs(kernel.CLASS[low], offsets)
    letters = kind == kernel.LETTER
    starts, ends, doc = starts[letters], ends[letters], doc[letters]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    passed = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ENDS[data], out=passed[1:])
    mark = passed[starts]
    new = np.append(True, (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1]))
    sentence = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    parts, owners = [kernel.xxh64(low, starts, ends)], [sentence]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts >= n)
        parts.append(kernel.xxh64(low, starts[long], starts[long] + n, seed=n))
        owners.append(sentence[long])
    order = np.argsort(np.concatenate(owners), kind="stable")
    feature = (np.concatenate(parts)[order] >> np.uint64(64 - BITS)).astype(np.int64)
    return feature, np.concatenate(owners)[order], doc[head], starts[head], ends[tail]


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sentence_logits(word: np.ndarray, sentence: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return weights[-1] + BIAS + kernel.group_sums(weights[word], sentence, n)


HAZARD = float(-np.log1p(-FLOOR))
MOST = BACKGROUND * float(softplus(BIAS))


def document_hazards(hazard: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Each document's sum of its sentences' hazards, with a bounded background."""
    below = kernel.group_sums(np.minimum(hazard, HAZARD), doc, docs)
    return kernel.group_sums(np.maximum(hazard - HAZARD, 0), doc, docs) + np.minimum(below, MOST)


def loss_slopes(logit: np.ndarray, label: float) -> np.ndarray:
    """How the log loss of one document changes with each sentence's logit, between -1 and 1."""
    hazard = softplus(logit)
    total = float(document_hazards(hazard, np.zeros(len(logit), np.int64), 1)[0])
    counts = (hazard > HAZARD) | (np.minimum(hazard, HAZARD).sum() <= MOST)
    return np.clip(sigmoid(logit) * counts * (1.0 if label == 0 else -1 / np.expm1(np.clip(total, 1e-6, 500))), -1, 1)


def passes(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, tuple[np.ndarray, ...]]]:
    """Range of documents, their scores, and of their sentences: document, first byte in it, length, score."""
    for lo, hi in kernel.slices(offsets):
        first = offsets[lo : hi + 1] - offsets[lo]
        word, sentence, doc, start, end = instances(data[offsets[lo] : offsets[hi]], first)
        logit = sentence_logits(word, sentence, len(doc), weights)
        yield lo, hi, -np.expm1(-document_hazards(softplus(logit), doc, hi - lo)), (doc + lo, start - first[doc], end - start, sigmoid(logit))


def document_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(score for _, _, score, _ in passes(data, offsets, weights))])


def offending(scores: np.ndarray, sentences: list[tuple[np.ndarray, ...]], threshold: float) -> pa.Array:
    """Of every document at or over the threshold the sentences at or over it (else its worst one), in order; of others none."""
    doc, start, length, score = (np.concatenate(x) for x in zip(*sentences)) if sentences else (np.zeros(0, np.int64),) * 4
    best = np.full(len(scores), -1.0)
    np.maximum.at(best, doc, score)
    hit = np.flatnonzero((scores[doc] >= threshold) & ((score >= threshold) | (score == best[doc])))
    bounds = np.searchsorted(doc[hit], np.arange(len(scores) + 1))
    items = pa.StructArray.from_arrays([pa.array(start[hit], pa.int64()), pa.array(length[hit], pa.int64()), pa.array(score[hit], pa.float64())], ["start", "length", "score"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)


def train(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Word weights (the bias last) by FTRL steps on the noisy-or likelihood of document labels."""
    bags = []
    for lo, hi in kernel.slices(offsets):
        word, sentence, doc, _, _ = instances(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        cut = np.searchsorted(sentence, first)
        for d in range(hi - lo):
            index, place = np.unique(word[cut[d] : cut[d + 1]], return_inverse=True)
            bags.append((np.append(index, 1 << BITS), place, sentence[cut[d] : cut[d + 1]] - first[d], int(first[d + 1] - first[d])))
    model = Ftrl(1 << BITS, alpha=1.0, beta=1.0, l1=1.5, l2=0.001)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            index, place, sentence, n = bags[i]
            if not n:
                continue
            weight = model.weights(index)
            logit = BIAS + weight[-1] + kernel.group_sums(weight[:-1][place], sentence, n)
            slope = loss_slopes(logit, labels[i])
            gradient = np.append(kernel.group_sums(slope[sentence], place, len(index) - 1), slope.sum())
            model.update(index, weight, np.clip(gradient, -4, 4))
    return model.weights().astype(np.float32)


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [b for b in batches if b.num_rows]
    weights = np.zeros((1 << BITS) + 1, np.float32)
    if found:
        rows = pa.Table.from_batches(found).sort_by([("doc_id", "ascending"), ("label", "ascending")])
        data, offsets = kernel.flat(rows["text"])
        weights = train(data, offsets, rows["label"].to_numpy().astype(float))
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()])], ["model"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    tune(docs.sparkSession)
    sample = labelled(docs, labels, "toxic", rows)
    held = sample.repartition(1).mapInArrow(_train_batches, "model binary").first()
    return np.frombuffer(held[0], np.float32) if held else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and offending (sentences: start and length in UTF-8 bytes, score) of every row; a text without words scores zero."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.astype(float)
        for batch in batches:
            value, sentences = np.zeros(batch.num_rows), []
            for lo, hi, part, held in passes(*kernel.flat(batch.column(1)), own):
                value[lo:hi] = part
                sentences.append(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(value), pa.array((value >= threshold).astype(np.int32)), offending(value, sentences, threshold)],
                ["doc_id", "held_out", "score", "predicted", "offending"],
            )

    rows = docs.select("doc_id", "text", is_held("doc_id", 5, 0).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, offending array<struct<start: long, length: long, score: double>>")


def locate(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The offending sentences: doc_id, start and length in UTF-8 bytes, sentence text, score at or over the threshold."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.astype(float)
        for batch in batches:
            data, offsets = kernel.flat(batch.column(1))
            for _, _, _, (doc, start, length, value) in passes(data, offsets, own):
                hit = np.flatnonzero(value >= threshold)
                at = offsets[doc[hit]] + start[hit]
                text = [data[a : a + n].tobytes().decode() for a, n in zip(at.tolist(), length[hit].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[hit])), pa.array(start[hit]), pa.array(length[hit]), pa.array(text, pa.string()), pa.array(value[hit])],
                    ["doc_id", "start", "length", "sentence", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, sentence string, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Scores of ``docs(doc_id, text, ...)`` after learning from ``labels(doc_id, toxic, ...)``.

    Every row of ``docs`` gives one row, repeated ids included, with the sentences
    that make it toxic. Null and empty texts score zero. Without any usable label
    every word weighs nothing. A text of any length is scored whole; an empty table
    gives an empty result.
    """
    return score(docs, fit(docs, labels, rows))


def accepted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the model does not predict as 1.

    The batch itself is filtered where it is scored: no join, no shuffle.
    """
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.astype(float)
        for batch in batches:
            value = document_scores(*kernel.flat(batch.column(place)), own)
            yield batch.filter(pa.array(value < threshold))

    return docs.mapInArrow(run, docs.schema)
