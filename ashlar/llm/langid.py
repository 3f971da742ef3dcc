"""Language identification by word-first backoff.

A word of the model's vocabulary scores by its log frequency in each language.
Any other word falls back to character n-grams: those of the greatest length of
which at least one is known, from ``NGRAM`` down to one character. A document's
language has the largest sum over all its words. Words are runs of letters
(``\\p{L}``), in training and in scoring.

The model is a few sorted arrays: hashed words and n-grams, and for each the
languages that have it. Looking up many words is a binary search.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import byte_groups, crc_rest, is_held, keep, one_text, tune

NGRAM = 5
#: Bounds of the sample that the model is learned from: documents of each language, and of all languages (each has one at least).
LANGUAGE_ROWS = 1000
SAMPLE_ROWS = 20_000
#: Bytes of words and their vectors that a worker remembers between documents.
MEMORY_BYTES = 96 << 20
UNKNOWN = "und"
#: The scorer of the last model that this Python worker used; it outlives a task.
_HELD: dict[str, "Scorer"] = {}
#: Beyond these characters letters and numbers are told apart by the full pattern.
_RARE = re.compile("[²³¹¼-¾]|[^\x00-ɏ]")
_PLAIN = re.compile(r"[^\W\d_]+")
_FULL = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """Runs of letters of a text, in lower case."""
    low = text.lower()
    return (_FULL if _RARE.search(low) else _PLAIN).findall(low)


class Words:
    """The code points of some words on end, each between boundary marks."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.head = np.cumsum(self.size + 2) - self.size - 2

    def whole(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every chosen word, and their numbers."""
        out = np.zeros(len(which), np.uint64)
        size, head = self.size[which], self.head[which] + 1
        for step in range(int(size.max(initial=0))):
            more = np.flatnonzero(size > step)
            out[more] = kernel.mix(out[more], self.code[head[more] + step])
        return out, np.arange(len(which))

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the character n-grams of the chosen words (the marks alone are no unigram), and the words' numbers."""
        pad = 0 if n == 1 else 1
        count = np.maximum(self.size[which] + 2 * pad - n + 1, 0)
        owner = np.repeat(np.arange(len(which)), count)
        at = self.head[which][owner] + (1 - pad) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        out = np.full(len(owner), np.uint64(n))
        for step in range(n):
            out = kernel.mix(out, self.code[at + step])
        return out, owner


class Level:
    """Log frequencies of keys by language: what a language gives a key that it lacks, and by how much each cell exceeds that."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, weight: np.ndarray, languages: int):
        self.languages = languages
        cell = np.lexsort((lang, key))
        key, lang, weight = key[cell], lang[cell], weight[cell]
        new = np.append(True, (key[1:] != key[:-1]) | (lang[1:] != lang[:-1]))[: len(key)]
        sums = np.add.reduceat(weight, np.flatnonzero(new)) if len(key) else weight
        key, self.lang = key[new], lang[new].astype(np.int32)
        head = np.append(True, key[1:] != key[:-1])[: len(key)]
        self.keys = key[head]
        self.bounds = np.append(np.flatnonzero(head), len(key))
        total = np.bincount(self.lang, weights=sums, minlength=languages) + 0.5 * len(self.keys) + 1e-9
        self.base = np.log(0.5 / total)
        self.over = (np.log((sums + 0.5) / total[self.lang]) - self.base[self.lang]).astype(np.float32)

    def places(self, key: np.ndarray) -> np.ndarray:
        """Place of every key, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def means(self, place: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """Mean log frequencies, by language, of the known keys of each owner (at least one each)."""
        first, n = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        cell = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row = np.repeat(owner, n)
        sums = np.bincount(row * self.languages + self.lang[cell], weights=self.over[cell], minlength=owners * self.languages).reshape(owners, self.languages)
        return self.base + sums / np.bincount(owner, minlength=owners)[:, None]


class Model:
    """Per-language log frequencies of words (level 0) and of character n-grams of each length."""

    def __init__(self, counts: Iterable[tuple[str, str, int]]):
        rows = list(counts)
        self.languages = sorted({lang for lang, _, _ in rows})
        place = {lang: i for i, lang in enumerate(self.languages)}
        lang = np.array([place[x] for x, _, _ in rows], np.int64)
        weight = np.array([n for _, _, n in rows], float)
        words = Words([w for _, w, _ in rows])
        every = np.arange(len(rows))
        self.levels = []
        for n in range(NGRAM + 1):
            key, owner = words.grams(every, n) if n else words.whole(every)
            self.levels.append(Level(key, lang[owner], weight[owner], max(1, len(place))))

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for every word, by the longest level that knows the word."""
        out = np.zeros((len(words), max(1, len(self.languages))), np.float32)
        held, left = Words(words), np.arange(len(words))
        for n in (0, *range(NGRAM, 0, -1)):
            if not len(left):
                break
            key, owner = held.grams(left, n) if n else held.whole(left)
            place = self.levels[n].places(key)
            place, owner = place[place >= 0], owner[place >= 0]
            known, owner = np.unique(owner, return_inverse=True)
            if len(known):
                out[left[known]] = self.levels[n].means(place, owner, len(known))
                left = np.delete(left, known)
        return out


class Scorer:
    """Scores texts, remembering the vectors of words between them."""

    def __init__(self, model: Model):
        self.model = model
        self.width = max(1, len(model.languages))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.bytes = 0
        self.rows = np.zeros((1024, self.width), np.float32)

    def learn(self, texts: list[list[str]]) -> None:
        """Makes room for the words of some texts, and their vectors."""
        new = set().union(*texts).difference(self.index)
        size = lambda words: sum(map(len, words)) + len(words) * (100 + 4 * self.width)
        if self.bytes + size(new) > MEMORY_BYTES:
            self.clear()
            new = set().union(*texts)
        self.bytes += size(new)
        words = list(new)
        first = len(self.index)
        while first + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[first : first + len(words)] = self.model.vectors(words)
        self.index.update(zip(words, range(first, first + len(words))))

    def best(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(text or "") for text in texts]
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        self.learn(split)
        size = np.array([len(words) for words in split], np.int64)
        full = np.flatnonzero(size)
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not len(full):
            return out
        index = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        heads = (np.cumsum(size) - size)[full]
        sums = np.stack([np.add.reduceat(column[index], heads, dtype=float) for column in self.rows.T], axis=1)
        top = sums.argmax(axis=1)
        share = 1 / np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -700)).sum(axis=1)
        for i, best, score in zip(full.tolist(), top.tolist(), share.tolist()):
            out[i] = (self.model.languages[best], score)
        return out


def held_scorer(name: str, sent) -> Scorer:
    """This worker's scorer of a broadcast model, made at its first task."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Scorer(sent.value)
    return _HELD[name]


def sample_by_language(usable: DataFrame, rows: int, total: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` documents (all, if there are no more) of every language, chosen by a hash of doc_id.

    Where that makes more than ``total`` documents, every language gives fewer,
    and one of its own at least.
    """
    # a sketch counts each language's ids to about 1 %; no ids are shuffled
    sizes = keep(usable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.01).alias("n"), F.min(F.xxhash64(F.lit("sample"), F.col("doc_id"))).alias("least")))
    each = max(1, min(rows, total // max(1, sizes.count())))
    share = sizes.select("lang", "least", F.least(F.lit(1.0), 1.05 * each / F.greatest(F.col("n"), F.lit(1))).alias("share"))
    place = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    chosen = usable.join(share, "lang").where((F.pmod(place, F.lit(1 << 30)) < F.col("share") * (1 << 30)) | (place == F.col("least")))
    return one_text(chosen.select("doc_id", "lang", "text"))


def fit(docs: DataFrame, rows: int = LANGUAGE_ROWS) -> Model:
    """Model of the text and non-null lang of a bounded sample, without documents whose id's CRC-32 mod 4 is 2.

    Every language is learned from about ``rows`` usable documents, or from all that it has,
    however many rows the table has, and from all words of those. Spark counts words by
    language; the driver gets the distinct words of the sample.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_rest("doc_id", 4) != 2))
    sample = sample_by_language(usable, rows)
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    return Model(zip(*(counts.column(name).to_pylist() for name in ("lang", "word", "n"))))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held_scorer(name, sent)
        for batch in batches:
            found = [x for texts in byte_groups(batch.column(1)) for x in scorer.best(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", "text", is_held("doc_id", 4, 2).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, rows: int = LANGUAGE_ROWS) -> DataFrame:
    """Predicted language of every row of ``docs(doc_id, text, lang, ...)``.

    Null texts and texts without a letter give ``und`` and score 0; so does every
    text if nothing can be learned. Numbers are no letters, whatever they look like.
    Ties go to the language first in order. Repeated rows each keep a row; other
    columns are ignored. A text of any length is read whole, in a group of its own.
    """
    return predict(docs, fit(docs, rows))
