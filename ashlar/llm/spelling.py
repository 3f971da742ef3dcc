"""Spelling variants by a symmetric-delete join.

Every word of the vocabulary emits a key for itself and one for each of its
distinct single deletions; words that share a key are candidates, verified by
their exact distance. A key is a hash that costs the same for every deletion of
a word (two prefix sums and a shift), so that a word of a million letters costs a
million keys and not their square in letters. A key meets few words however many
rows a word has: those that one letter in one place tells apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import byte_groups, keep, tune

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One of so many runs loses a letter, by the CRC-32 of its document and itself.
SPOILED = 97
#: A form occurs at least so many times as often as the word.
RATIO = 2
#: Bytes of text whose runs are counted together.
SLICE_BYTES = 4 << 20
#: Words of so many code points at most go along with their keys; of longer ones only the ids do.
INLINE = 64
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of every span of bytes, each continued from that of what stands before it."""
    order = np.argsort(-np.minimum(size, INLINE + 1), kind="stable")
    out = np.empty(len(size), np.uint32)
    long = int(np.count_nonzero(size > INLINE))
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes(), int(before[i]))
    order = order[long:]
    at, rest, value = start[order], size[order], ~before[order].astype(np.uint32)
    for step in range(int(rest[0]) if len(rest) else 0):
        open_ = int(np.searchsorted(-rest, -step, side="left"))
        part = value[:open_]
        value[:open_] = CRC[(part ^ data[at[:open_] + step]) & np.uint32(255)] ^ part >> np.uint32(8)
    out[order] = ~value
    return out


def _spoil(word: str, crc: int) -> str:
    at = crc % len(word)
    return word[:at] + word[at + 1 :]


def counted(data: np.ndarray, offsets: np.ndarray, keys: list[str | None]) -> tuple[pa.Array, pa.Array]:
    """The distinct words of at least ``LEAST_LENGTH`` code points of a slice of texts, and how often each occurs.

    A word is a run of ASCII letters and U+00C0 to U+00FF (in UTF-8: C3 and one more
    byte), A-Z lower-cased, one of ``SPOILED`` with a letter deleted.
    """
    low = kernel.lower_ascii(data)
    two = low == 0xC3
    letter = (low >= ord("a")) & (low <= ord("z")) | two
    letter[1:] |= two[:-1]
    start, end, _, doc = kernel.runs(letter.view(np.uint8), offsets)
    twos = np.append(0, np.cumsum(two))
    points = (end - start) - (twos[end] - twos[start])
    long = points >= LEAST_LENGTH
    start, end, doc = start[long], end[long], doc[long]
    before = np.array([zlib.crc32(f"{'' if key is None else key}:".encode()) for key in keys], np.uint32)
    crc = crc32(low, start, end - start, before[doc])
    spoiled = crc % SPOILED == 0
    odd = [_spoil(low[a:b].tobytes().decode(), int(c)) for a, b, c in zip(start[spoiled], end[spoiled], crc[spoiled])]
    start, size = start[~spoiled], (end - start)[~spoiled]
    ends = np.append(0, np.cumsum(size))
    packed = low[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed))
    words = pa.concat_arrays([words, pa.array([w for w in odd if len(w) >= LEAST_LENGTH], pa.large_string())])
    found = pc.value_counts(words)
    return found.field("values").cast(pa.string()), found.field("counts")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_pylist()
        data, offsets = kernel.flat(batch.column(1))
        for lo, hi in kernel.slices(offsets, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([*counted(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], keys[lo:hi])], ["word", "n"])


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of all words long and frequent enough; counted before the shuffle, so that a frequent word is a row a slice at most."""
    found = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(_count_batches, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def delete_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words and of their distinct single deletions, and the word's place of each."""
    size = np.array([len(w) for w in words])
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    with np.errstate(over="ignore"):
        up, down = powers(len(code), BASE), powers(len(code), BACK)
        total = np.append(np.uint64(0), np.cumsum(kernel.mix(code, code) * up[:-1]))
        first, last = total[start], total[start + size]
        # deleting one letter of a run of equal ones is deleting its first
        at = np.flatnonzero((np.append(np.uint64(0), code[:-1]) != code) | (np.arange(len(code)) == start[owner]))
        own = owner[at]
        rest = ((total[at] - first[own]) + (last[own] - total[at + 1]) * np.uint64(BACK)) * down[start[own]]
        whole = (last - first) * down[start]
    keys = np.concatenate([kernel.mix(whole, size.astype(np.uint64)), kernel.mix(rest, size[own].astype(np.uint64) - np.uint64(1))])
    return keys.view(np.int64), np.concatenate([np.arange(len(words)), own])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for words in byte_groups(batch.column(0)):
            keys, place = delete_keys(words)
            own = batch.slice(at, len(words)).take(pa.array(place))
            at += len(words)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *own.columns[1:]], ["key", *batch.schema.names[1:]])


def _met(words: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs a < b of words that share a key, with some of their columns. Near words share one key only, so that no pair comes twice."""
    held = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in columns)
    keys = words.select(F.col("word").alias("_word"), *columns).mapInArrow(_key_batches, f"key long, {held}")
    sides = [keys.select("key", *(F.col(c).alias(f"{side}_{c}") for c in columns)) for side in "ab"]
    return sides[0].join(sides[1], "key").where("a_id < b_id")


def apart_by_one(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced: what follows the first difference agrees."""
    if len(a) > len(b):
        a, b = b, a
    x, y = (np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in (a, b))
    if len(y) - len(x) > 1 or a == b:
        return False
    differ = x != y[: len(x)]
    at = int(differ.argmax()) if differ.any() else len(x)
    return bool((x[at + (len(x) == len(y)) :] == y[at + 1 :]).all())


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("a_word").to_pylist(), batch.column("b_word").to_pylist())
        yield batch.filter(pa.array([apart_by_one(a, b) for a, b in pairs], pa.bool_()))


def near(words: DataFrame) -> DataFrame:
    """The pairs of ``words(id, word, n)`` at distance one (an inserted, deleted or replaced code point): id, word and n of both."""
    size = F.char_length("word")
    names = [f"{side}_{c}" for side in "ab" for c in ("id", "word", "n")]
    short = _met(words.where(size <= INLINE), ["id", "word", "n"]).where(F.levenshtein("a_word", "b_word", 1) == 1)
    long = _met(words.where(size >= INLINE).withColumn("size", size), ["id", "n", "size"]).where(F.greatest("a_size", "b_size") > INLINE)
    for side in "ab":
        long = long.join(words.select(F.col("id").alias(f"{side}_id"), F.col("word").alias(f"{side}_word")), f"{side}_id")
    long = long.select(names)
    return short.select(names).unionByName(long.mapInArrow(_verify_batches, long.schema))


def roots(forms: DataFrame) -> DataFrame:
    """id and root of every row of ``forms(id, form)``, following forms to the last by doubling joins.

    A form occurs more often than its word, so that forms make no circle; each round
    is a written table, and there are as many as the longest path has binary digits.
    """
    found = keep(forms.select("id", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        if found.join(onward, "root", "left_semi").isEmpty():
            return found
        found = keep(found.join(onward, "root", "left").select("id", F.coalesce("beyond", "root").alias("root")))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts.

    Null and empty texts have no words, a null key counts as an empty one, and a
    repeated row counts again. Of near words of equal n the smallest in code-point
    order is the form. Words of any length are compared whole. Without words (an empty
    table as well) the result is empty. Only the key and the text are read.
    """
    tune(docs.sparkSession)
    words = keep(vocabulary(docs, key, text).select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    pair = near(words)
    ways = [F.struct(F.col(f"{own}_id").alias("id"), (-F.col(f"{other}_n")).alias("fewer"), F.col(f"{other}_word").alias("word"), F.col(f"{other}_id").alias("other")) for own, other in ("ab", "ba")]
    others = pair.select(F.explode(F.array(*ways)).alias("way")).select("way.id", F.struct("way.fewer", "way.word", "way.other").alias("other"))
    linked = others.groupBy("id").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    formed: Column = -F.col("best.fewer") >= RATIO * F.col("n")
    judged = keep(
        words.join(linked, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, F.col("best.other")).alias("form_id"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.fewer")).alias("form_n"),
        )
    )
    led = roots(judged.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = led.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return judged.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
