"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into phrases, each the longest phrase known so
far and one symbol more. The set of phrases is what a dictionary compressor has
learned of the text; two texts that compress each other well share many. A
fingerprint is a minimum-hash signature of that set: the smallest hash of each of
``SLOTS`` slots, empty slots borrowing from fixed others, one byte each.

Symbols are runs of letters, digits or other marks (white space only separates),
and the single bytes of runs longer than ``LONGEST``, so that texts without spaces
resemble each other as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import GROUP_CHARS, GROUP_TEXTS, keep, tune

#: Slots of a signature.
SLOTS = 128
#: Bytes of the longest run that is one symbol.
LONGEST = 24
#: Phrases and symbols are numbers of 60 bits.
MASK = (1 << 60) - 1
STEP = 0x9E3779B97F4A7C15
NONE = np.uint64(2**64 - 1)
WHOLE, HEAD, OPEN = 0, 1, 2
#: Results as tasks make them: digests are bytes, and become digits at the end.
RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
DIGESTS = NAMES[1:4]


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every symbol of a slice: its number, where its run ends, and the first symbol of each document (and the end)."""
    start, end, _, doc = kernel.runs(kernel.CLASS[data], offsets)
    size = end - start
    times = np.where(size > LONGEST, size, 1)
    at = np.repeat(start - (np.cumsum(times) - times), times) + np.arange(times.sum())
    stop = np.repeat(end, times)
    number = kernel.xxh64(data, at, np.where(np.repeat(times, times) > 1, at + 1, stop)) >> np.uint64(4)
    return number.astype(np.int64), stop, np.searchsorted(np.repeat(doc, times), np.arange(len(offsets)))


def parse(known: dict[int, int], symbols: list[int], node: int = 0) -> int:
    """Goes on with a parse at ``node``: what was learned is added to ``known`` (by phrase and symbol); the last, unfinished phrase is returned."""
    get = known.get
    for symbol in symbols:
        key = node ^ symbol
        node = get(key)
        if node is None:
            known[key] = key * STEP & MASK
            node = 0
    return node


def signatures(phrases: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``SLOTS`` bytes for each set of phrases; that of an empty set is zero."""
    sets = len(bounds) - 1
    hashed = kernel.mix(phrases.astype(np.uint64), phrases.astype(np.uint64))
    place = np.repeat(np.arange(sets), np.diff(bounds)) * SLOTS + (hashed >> np.uint64(57)).astype(np.int64)
    least = np.full(sets * SLOTS, NONE)
    np.minimum.at(least, place, hashed & np.uint64((1 << 57) - 1))
    least = least.reshape(sets, SLOTS)
    filled = least.copy()
    row, column = np.nonzero((least == NONE) & (np.diff(bounds) > 0)[:, None])
    turn = 0
    while len(row):  # every set's slots ask the same others in the same order, so that equal sets borrow alike
        turn += 1
        asked = (kernel.mix(column.astype(np.uint64), np.full(len(column), turn, np.uint64)) % np.uint64(SLOTS)).astype(np.int64)
        got = least[row, asked]
        filled[row, column] = got
        row, column = row[got == NONE], column[got == NONE]
    out = (kernel.mix(filled, filled) & np.uint64(255)).astype(np.uint8)
    out[np.diff(bounds) == 0] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """The share of phrases in common that two rows of signatures tell of; ``some_a``, ``some_b``: whether the sets hold any."""
    equal = (a == b).mean(axis=1)
    return np.where(some_a & some_b, np.maximum((256 * equal - 1) / 255, 0), (some_a == some_b).astype(float))


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)


def compared(texts: list[str]) -> list[pa.Array]:
    """The result columns of all texts but the last, each against the one behind it."""
    own = [t.encode() for t in texts]
    data, offsets = _joined(own)
    number, stop, first = symbols(data, offsets)
    moved = [len(t) // 4 for t in texts]
    tails, shared, digest = [], [], []
    for i, text in enumerate(texts[:-1]):
        kept = text[: len(text) - moved[i]].encode()
        lent = texts[i + 1][: moved[i]].encode()
        # runs that end before the cut are those of the edited text too
        same = int(np.searchsorted(stop[first[i] : first[i + 1]], offsets[i] + len(kept)))
        begin = int(stop[first[i] + same - 1] - offsets[i]) if same else 0
        tails.append(kept[begin:] + lent)
        shared.append(same)
        digest.append(hashlib.sha256(kept + lent).digest())
    tail, _, tail_first = symbols(*_joined(tails))
    number, tail = number.tolist(), tail.tolist()
    sets: list[np.ndarray] = []
    edited: list[np.ndarray] = []
    for i in range(len(texts)):
        known: dict[int, int] = {}
        mine = number[first[i] : first[i + 1]]
        if i == len(texts) - 1:
            parse(known, mine)
            sets.append(np.fromiter(known.values(), np.int64, len(known)))
            break
        node = parse(known, mine[: shared[i]])
        common = len(known)
        parse(known, mine[shared[i] :], node)
        sets.append(np.fromiter(known.values(), np.int64, len(known)))
        while len(known) > common:  # the parse forks here
            known.popitem()
        parse(known, tail[tail_first[i] : tail_first[i + 1]], node)
        edited.append(np.fromiter(known.values(), np.int64, len(known)))
    every = sets + edited
    size = np.array([len(s) for s in every])
    made = signatures(np.concatenate(every), np.append(0, np.cumsum(size)))
    n = len(edited)
    a, some = made[: n + 1], size > 0
    near_edited = likeness(a[:-1], made[n + 1 :], some[:n], some[n + 1 :])
    near_next = likeness(a[:-1], a[1:], some[:n], some[1 : n + 1])
    text = [row.tobytes() if any_ else b"" for row, any_ in zip(made, some)]
    columns = [[len(t) for t in texts[:-1]], digest, text[:n], text[n + 1 :]]
    return [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))] + [pa.array(near_edited), pa.array(near_next)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """ids and texts, few or few characters at a time."""
    for batch in batches:
        ids, texts, chars = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if texts and (len(texts) >= GROUP_TEXTS or chars + len(text) > GROUP_CHARS):
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(key)
            texts.append(text)
            chars += len(text)
        if texts:
            yield ids, texts


def _ordered_batches(schema: pa.Schema):
    """Results of all texts of an ordered partition but the last, which stays open, and the first text, which another partition waits for."""

    def edge(kind: int, part: int, key, text: str) -> pa.RecordBatch:
        row = {"doc_id": key, "kind": kind, "part": part, "text": text}
        return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple[list, list[str]] = ([], [])
        for ids, texts in _groups(batches):
            if not last[0]:
                yield edge(HEAD, part, ids[0], texts[0])
            ids, texts = last[0] + ids, last[1] + texts
            if len(ids) > 1:
                n = len(ids) - 1
                fixed = [pa.array(ids[:-1], schema.field("doc_id").type), pa.array([WHOLE] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays([*fixed, *compared(texts)], schema=schema)
            last = ids[-1:], texts[-1:]
        if last[0]:
            yield edge(OPEN, part, last[0][0], last[1][0])

    return run


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *compared([batch.column(1)[i].as_py(), batch.column(2)[i].as_py()])], ["doc_id", *NAMES])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    Rows are dealt by ranges of the key, a hash of the text and the row, so that
    neighbours meet in one task and no key is a task's alone; only the last row of
    each range needs a text of another one, and those are joined. Rows of null keys
    come first; rows of one key follow each other by the hash of the text. A null text
    is empty; a text without symbols has the empty fingerprint, like (1) others
    without and unlike (0) the rest. Texts of fewer than four code points are their own
    edited text, and a single row is its own next document. Texts of any length are
    parsed whole; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = ("doc_id", "hash", "row")
    ordered = rows.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = f"doc_id {kind}, kind int, part int, text string, {RESULT}"
    shape = pa.schema([("doc_id", _arrow_type(docs, key)), ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string()), ("n_chars", pa.int64()), *((c, pa.binary()) for c in DIGESTS), *((c, pa.float64()) for c in NAMES[4:])])
    made = keep(ordered.select("doc_id", "text").mapInArrow(_ordered_batches(shape), schema))
    parts = sorted(r["part"] for r in made.where(F.col("kind") == HEAD).select("part").collect())  # one number a range
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    heads = made.where(F.col("kind") == HEAD).select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    pairs = made.where(F.col("kind") == OPEN).select("doc_id", "text", "part").join(F.broadcast(follows), "part").join(heads, "next")
    edges = pairs.select("doc_id", "text", "next_text").mapInArrow(_pair_batches, f"doc_id {kind}, {RESULT}")
    every = made.where(F.col("kind") == WHOLE).select("doc_id", *NAMES).unionByName(edges)
    return every.select(F.col("doc_id").alias(key), *(F.lower(F.hex(c)).alias(c) if c in DIGESTS else F.col(c) for c in NAMES))


def _arrow_type(docs: DataFrame, key: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[key].dataType)
