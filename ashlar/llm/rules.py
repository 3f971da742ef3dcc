"""Quality rules: text statistics, hard limits, and an isolation forest for what remains.

Base statistics are exact. The forest isolates documents by random splits of
ratios of the statistics; documents with short average paths are anomalous. Its
trees hold good labelled documents, and split the whole range that labelled
documents, good and bad, take: where no good document lies, a path ends early. That
range and the threshold come from all labelled rows; of many, each tree draws its
own, as the method has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import is_held, keep, sampled, tune

TREES = 256
#: Good documents of each tree, and its depth.
LEAVES = 256
DEPTH = 10
#: Labelled rows whose statistics (not texts) reach the driver whole. Of more, so many good ones do, for the trees to draw from.
POOL = TREES * LEAVES
#: Share of good labelled rows that the threshold must keep.
KEEP_GOOD = 0.995
#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts that only the forest reads.
EXTRA = ("n_lines", "n_upper", "n_digits", "n_punct")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATS + EXTRA for every document of a flat buffer."""
    out = np.zeros((len(offsets) - 1, len(STATS) + len(EXTRA)), np.int64)
    for lo, hi in kernel.slices(offsets):
        out[lo:hi] = _slice_statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
    return out


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _slice_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    docs = len(offsets) - 1
    kinds = kernel.CLASS[data]
    filled = kinds != kernel.SPACE
    starts, ends, _, doc = kernel.runs(filled.view(np.uint8), offsets)
    n_words = np.bincount(doc, minlength=docs)
    word_chars = _per_doc(filled & ((data & 0xC0) != 0x80), offsets)
    hashed = kernel.xxh64(data, starts, ends)
    upper = (data >= 65) & (data <= 90)
    columns = [
        n_words,
        word_chars,
        _per_doc(SYMBOLS[data], offsets),
        _repeated_lines(data, offsets, starts, doc),
        _repeated_words(hashed, doc, docs),
        _per_doc(data == 10, offsets) + 1,
        _per_doc(upper, offsets),
        _per_doc(kinds == kernel.DIGIT, offsets),
        _per_doc(kinds == kernel.SYMBOL, offsets),
    ]
    return np.stack(columns, axis=1)


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    docs = len(offsets) - 1
    if not len(starts):
        return np.zeros(docs, np.int64)
    breaks = np.flatnonzero(data == 10)
    heads = np.union1d(offsets[:-1][offsets[:-1] < len(data)], breaks + 1)
    heads = heads[heads <= len(data)]
    line = np.unique(np.searchsorted(heads, starts, side="right") - 1)
    at = heads[line]
    owner = np.searchsorted(offsets, at, side="right") - 1
    after = np.searchsorted(breaks, at, side="left")
    stop = np.where(after < len(breaks), breaks[np.minimum(after, len(breaks) - 1)] if len(breaks) else len(data), len(data))
    end = np.minimum(stop, offsets[owner + 1])
    key = kernel.mix(kernel.xxh64(data, at, end), owner.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    return np.bincount(owner, minlength=docs) - np.bincount(owner[first], minlength=docs)


def _repeated_words(hashed: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Words that lie in a 3-word window found twice or more in their document."""
    n = len(hashed)
    if n < 3:
        return np.zeros(docs, np.int64)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    key = kernel.mix(kernel.mix(kernel.mix(hashed[at], hashed[at + 1]), hashed[at + 2]), doc[at].astype(np.uint64))
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    again = at[count[place] > 1]
    covered = np.zeros(n, bool)
    for step in range(3):
        covered[again + step] = True
    return np.bincount(doc[covered], minlength=docs)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])


def ratios(stats: np.ndarray) -> np.ndarray:
    """What the forest splits: shares that do not grow with a document's length, as square roots (small shares are told apart)."""
    s = stats.astype(float)
    words, chars = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1)
    return np.sqrt(np.stack([chars / words, s[:, 2] / chars, s[:, 3] / np.maximum(s[:, 5], 1), s[:, 4] / words, s[:, 6] / chars, s[:, 7] / chars, s[:, 8] / chars], axis=1))


class Forest:
    """Isolation trees of ``rows`` as flat arrays of split feature, split value and expected remaining path.

    Splits fall anywhere in the box around ``among`` (by default the rows themselves),
    not only between a node's own rows.
    """

    def __init__(self, rows: np.ndarray, among: np.ndarray | None = None, trees: int = TREES, leaves: int = LEAVES, depth: int = DEPTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        among = rows if among is None else np.concatenate([rows, among])
        self.size = max(2, min(leaves, len(rows)))
        self.depth = depth
        nodes = (1 << (depth + 1)) - 1
        self.feature = np.full((trees, nodes), -1, np.int32)
        self.value = np.zeros((trees, nodes))
        self.path = np.zeros((trees, nodes))
        low, high = among.min(axis=0), among.max(axis=0)
        for tree in range(trees):
            sample = rows[rng.choice(len(rows), min(self.size, len(rows)), replace=False)]
            self._grow(tree, 0, 0, sample, low, high, rng)

    def _grow(self, tree: int, node: int, depth: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> None:
        wide = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(wide):
            self.path[tree, node] = depth + average_path(len(rows))
            return
        feature = int(rng.choice(wide))
        value = rng.uniform(low[feature], high[feature])
        self.feature[tree, node], self.value[tree, node] = feature, value
        left = rows[:, feature] < value
        below, above = high.copy(), low.copy()
        below[feature] = above[feature] = value
        self._grow(tree, 2 * node + 1, depth + 1, rows[left], low, below, rng)
        self._grow(tree, 2 * node + 2, depth + 1, rows[~left], above, high, rng)

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for rows that few splits isolate."""
        total = np.zeros(len(rows))
        index = np.arange(len(rows))
        for tree in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                feature = self.feature[tree, node]
                inner = feature >= 0
                right = rows[index, np.maximum(feature, 0)] >= self.value[tree, node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += self.path[tree, node]
        return 2.0 ** (-total / len(self.feature) / average_path(self.size))


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n rows."""
    if n < 2:
        return 0.0
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut that best separates labelled rows while at least KEEP_GOOD of the good ones stay; infinite without both labels."""
    good, bad = np.sort(scores[labels == 1]), scores[labels == 0]
    if not len(good) or not len(bad):
        return float("inf")
    least = good[min(len(good) - 1, int(np.ceil(KEEP_GOOD * len(good))))]
    cuts = np.unique(np.concatenate([scores[scores >= least], [least]]))
    gain = [np.mean(bad > c) - np.mean(good > c) for c in cuts]
    best = int(np.argmax(gain))
    above = bad[bad > cuts[best]]
    return float((cuts[best] + above.min()) / 2) if len(above) else float(cuts[best])


def _best_cut(cuts: np.ndarray, bad: np.ndarray, good: np.ndarray, least_bad: np.ndarray) -> float:
    """``threshold`` from counts: of bad and good rows with so many cuts below them, and the least bad score of each."""
    over = lambda n: n.sum() - np.cumsum(n)[:-1]
    best = int(np.argmax(over(bad) / bad.sum() - over(good) / good.sum()))
    above = least_bad[best + 1 :].min()
    return float((cuts[best] + above) / 2) if np.isfinite(above) else float(cuts[best])


def spread_threshold(scored: DataFrame, goods: int) -> float:
    """``threshold`` of a written table ``scored(label, score)`` with both labels, of which only the highest good scores reach the driver.

    A cut between two good scores gains less than one at the lower of them, so that only these are tried.
    """
    high = goods - min(goods - 1, int(np.ceil(KEEP_GOOD * goods)))
    top = scored.where("label = 1").orderBy(F.desc("score")).limit(high).toArrow()["score"].to_numpy()
    cuts = np.unique(top)
    sent = scored.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.searchsorted(sent.value, batch.column(1).to_numpy(), side="left")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), batch.column(1)], ["label", "place", "score"])

    found = scored.mapInArrow(run, "label int, place long, score double").groupBy("label", "place").agg(F.count("*").alias("n"), F.min("score").alias("least")).toArrow()
    label, place, n, least = (found[c].to_numpy() for c in ("label", "place", "n", "least"))
    counts, least_bad = np.zeros((2, len(cuts) + 1)), np.full(len(cuts) + 1, np.inf)
    np.add.at(counts, (label, place), n)
    least_bad[place[label == 0]] = least[label == 0]
    return _best_cut(cuts, counts[0], counts[1], least_bad)


COUNTS = ", ".join(f"{c} long" for c in STATS + EXTRA)


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = statistics(*kernel.flat(batch.column(2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(x)) for x in stats.T)], ["doc_id", "hash", *STATS, *EXTRA])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text and statistics of every row, written: texts are read once."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keep(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(_stat_batches, f"doc_id {kind}, hash long, {COUNTS}"))


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([batch[c].to_numpy() for c in STATS + EXTRA]) if batch.num_rows else np.zeros((0, len(STATS + EXTRA)), np.int64)


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of bounded rows on the driver: ten integers a row."""
    held = rows.select("label", *STATS, *EXTRA).toArrow().to_pandas()
    held = held.sort_values(list(held.columns)).to_numpy().astype(np.int64)
    return held[:, 1:], held[:, 0]


def _ratio_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and the largest ratios of each batch."""
    for batch in batches:
        if batch.num_rows:
            split = ratios(_matrix(batch))
            ends = np.stack([split.min(axis=0), split.max(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in ends.T], [f"r{i}" for i in range(ends.shape[1])])


def fit(docs: DataFrame, labels: DataFrame, pool: int = POOL) -> tuple[Forest | None, float]:
    """Forest and threshold from all labelled rows that pass the base rules; a repeated id counts once."""
    return _fit(measured(docs), labels, pool)


def _fit(stats: DataFrame, labels: DataFrame, pool: int) -> tuple[Forest | None, float]:
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held("doc_id", 5, 0))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    one = stats.join(known, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by(F.struct(*STATS, *EXTRA), "hash").alias("s"))
    each = keep(one.select("doc_id", "label", "s.*"))
    if each.count() <= pool:
        held, marks = _collected(each)
        passed = ~base_failed(held)
        return learned(ratios(held[passed]), marks[passed])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    usable = each.where(~failed & F.col("label").isin(0, 1))
    goods, bads = usable.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if goods < 2 or not bads:
        return None, float("inf")
    width = ratios(np.zeros((1, len(STATS + EXTRA)))).shape[1]
    spans = usable.mapInArrow(_ratio_batches, ", ".join(f"r{i} double" for i in range(width)))
    among = np.array(spans.agg(*(f(f"r{i}") for f in (F.min, F.max) for i in range(width))).first(), float).reshape(2, width)
    drawn, _ = _collected(sampled(usable.where("label = 1"), "doc_id", pool, goods))
    forest = Forest(ratios(drawn), among)
    sent = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(sent.value.anomaly(ratios(_matrix(batch))))], ["label", "score"])

    return forest, spread_threshold(keep(usable.mapInArrow(run, "label int, score double")), goods)


def learned(rows: np.ndarray, labels: np.ndarray) -> tuple[Forest | None, float]:
    """Forest and threshold of some labelled rows; none, and no limit, without both labels."""
    good = rows[labels == 1]
    if len(good) < 2 or not (labels == 0).any():
        return None, float("inf")
    forest = Forest(good, rows)
    return forest, threshold(forest.anomaly(rows), labels)


def judged(docs: DataFrame, forest: Forest | None, cut: float) -> DataFrame:
    """Base statistics, base verdict, kept and anomaly of every row."""
    return _judged(measured(docs), forest, cut)


def _judged(stats: DataFrame, forest: Forest | None, cut: float) -> DataFrame:
    kind = stats.schema["doc_id"].dataType.simpleString()
    sent = stats.sparkSession.sparkContext.broadcast((forest, cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limit = sent.value
        for batch in batches:
            held = _matrix(batch)
            failed = base_failed(held)
            score = model.anomaly(ratios(held)) if model else np.zeros(len(held))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(batch[c] for c in STATS), pa.array(failed), pa.array(~failed & (score <= limit)), pa.array(score)], ["doc_id", *STATS, "base_failed", "kept", "anomaly"])

    columns = ", ".join(f"{c} long" for c in STATS)
    return stats.mapInArrow(run, f"doc_id {kind}, {columns}, base_failed boolean, kept boolean, anomaly double")


def rule_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts on every row of ``docs(doc_id, text, ...)``, calibrated by ``labels(doc_id, quality, ...)``.

    Null and blank texts have no words and fail the base rules. Without both
    labels (two good rows, one bad) the forest rejects nothing. Repeated rows each
    keep a row; other columns are ignored. A text of any length is counted whole;
    an empty table gives an empty result.
    """
    stats = measured(docs)
    return _judged(stats, *_fit(stats, labels, POOL))
