"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round finds the rank of
every neighbouring pair by binary search over the sorted pair keys, takes each
word's lowest rank, and merges that pair's places in all words at once; words
without a known pair leave the array. A merged symbol has one merge that makes
it, and pairs with it rank later, so merging all places of one pair in a round
gives what one merge at a time gives.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import byte_groups, tune

#: Bytes of words, ids and shown tokens that a worker remembers between documents (about, with 300 for each word).
MEMORY_BYTES = 128 << 20

NONE = np.iinfo(np.int64).max
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
#: What the plain pattern does not classify as the full one: other scripts, other numbers, information separators.
_RARE = re.compile("[\x1c-\x1f²³¹¼-¾]|[^\x00-ɏ]")
_PLAIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_FULL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")

_HELD: dict[str, "WordBpe"] = {}


def byte_characters() -> list[str]:
    """The visible character that stands for each byte value in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in names)
    names |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class WordBpe:
    """A lower-casing byte-level BPE vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.digits = {i: str(i) for i in self.token}
        names = byte_characters()
        self.inner = np.array([vocab[c] for c in names], np.int64)
        self.last = np.array([vocab[c + suffix] for c in names], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.clear()

    def clear(self) -> None:
        self.bytes = 0
        self.ids: dict[str, str] = {t: str(i) for t, i in self.special.items()}
        self.shown: dict[str, str] = {t: t for t in self.special}

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text after NFC and lower-casing; special tokens stay whole."""
        if self.split_special and any(t in text for t in self.special):
            parts = self.split_special.split(text)
            return list(chain.from_iterable([part] if i % 2 else self._plain_words(part) for i, part in enumerate(parts)))
        return self._plain_words(text)

    @staticmethod
    def _plain_words(text: str) -> list[str]:
        low = text.lower()
        if not _RARE.search(low):
            return _PLAIN.findall(low)
        # one character at a time: a sigma at a word's end is lower-cased like any other
        return _FULL.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _ranks(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if no merge) and merged symbol of the pairs that start at some places."""
        after = np.minimum(at + 1, len(symbol) - 1)
        key = (symbol[at] << 32) | symbol[after]
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[slot] == key) & (owner[after] == owner[at]) & (after > at)
        return np.where(known, self.rank[slot], NONE), self.made[slot]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words on end, and where each word's begin (one more: where all end)."""
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        tail = (np.cumsum(size) - 1)[size > 0]
        symbol[tail] = self.last[data[tail]]
        owner = np.repeat(np.arange(len(words)), size)
        rank, made = self._ranks(symbol, owner, np.arange(len(symbol)))
        done_symbol, done_owner = [symbol[:0]], [owner[:0]]
        while len(symbol):
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, head)
            least = np.repeat(least, np.diff(np.append(head, len(symbol))))
            alive = least < NONE
            done_symbol.append(symbol[~alive])
            done_owner.append(owner[~alive])
            place = np.flatnonzero((rank == least) & alive)
            if not len(place):
                break
            # of places that overlap (a symbol paired with itself), every second one from the left
            nth = np.arange(len(place))
            start = np.maximum.accumulate(np.where(np.append(True, np.diff(place) != 1), nth, 0))
            place = place[(nth - start) % 2 == 0]
            symbol[place] = made[place]
            alive[place + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[place] = True
            changed[np.maximum(place - 1, 0)] = True
            symbol, owner, rank, made = symbol[alive], owner[alive], rank[alive], made[alive]
            at = np.flatnonzero(changed[alive])
            rank[at], made[at] = self._ranks(symbol, owner, at)
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def learn(self, texts: list[list[str]]) -> None:
        new = set().union(*texts).difference(self.ids)
        if self.bytes > MEMORY_BYTES:
            self.clear()
            new = set().union(*texts).difference(self.ids)
        self.bytes += 8 * sum(map(len, new)) + 300 * len(new)
        if not new:
            return
        words = list(new)
        flat, bounds = self.merge(words)
        flat, bounds = flat.tolist(), bounds.tolist()
        ids, shown = [self.digits[i] for i in flat], [self.token[i] for i in flat]
        for word, a, b in zip(words, bounds, bounds[1:]):
            self.ids[word] = " ".join(ids[a:b])
            self.shown[word] = " ".join(shown[a:b])

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        self.learn([words])
        return [int(i) for w in words for i in self.ids[w].split()]

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by one space (the vocabulary has no decoder of its own)."""
        return " ".join([self.token[i] for i in ids if i in self.token])

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Token count, SHA-256 of the ids and of the decoded text, of every text."""
        split = [self.words(text) for text in texts]
        self.learn(split)
        for words in split:
            ids = " ".join(map(self.ids.__getitem__, words))
            shown = " ".join(map(self.shown.__getitem__, words))
            yield ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


def held(path: str) -> WordBpe:
    """This Python worker's vocabulary, read once."""
    if path not in _HELD:
        _HELD[path] = WordBpe(path)
    return _HELD[path]


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row; a null text counts as empty."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(path)
        for batch in batches:
            ids = [model.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``rows(doc_id, ids)``; ids outside the vocabulary are left out."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(path)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no tokens; their digests are those of the empty
    string. Repeated rows each keep a row; other columns are ignored. A text of any
    length is encoded whole, in a group of its own; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(path)
        for batch in batches:
            found = [x for texts in byte_groups(batch.column(1)) for x in model.digest([text or "" for text in texts])]
            counts, ids, shown = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
