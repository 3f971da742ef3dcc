"""SimHash near-duplicate groups by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. If two fingerprints differ in at
most three bits, one segment differs in at most one, so both share that segment
with one bit position left out. Every distinct fingerprint is indexed under all
its one-wildcard segment variants; equal variants meet in an equality join
(a partitioned and sorted run of equal keys) and are verified bit by bit.

A run of more than ``RUN_ROWS`` fingerprints is not paired: its rows are indexed
again by variants of the bits that its key does not fix. After two such levels
a key fixes 53 bits, so that a run cannot exceed ``RUN_ROWS`` distinct values:
the search is exact at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import keep, tune
from .components import components

MAX_BITS = 3
RUN_ROWS = 2048
#: Runs up to this size are compared at all offsets at once.
SHORT_RUN = 8
#: Row numbers that are broadcast at most to filter texts (about 100 bytes each as a hash table); more meet them in a shuffle.
BROADCAST_ROWS = 1 << 18
#: Shingles of one numpy pass.
PASS_SHINGLES = 1 << 16
SEED = 42


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    """Unsigned SimHash of every document of a flat buffer."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for lo, hi in kernel.slices(offsets):
        held = kernel.lower_ascii(data[offsets[lo] : offsets[hi]])
        out[lo:hi] = _slice_fingerprints(*kernel.squeeze(held, offsets[lo : hi + 1] - offsets[lo]), width)
    return out


def _slice_fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    docs = len(offsets) - 1
    starts, ends, _, doc = kernel.runs((data != 32).view(np.uint8), offsets)
    words = np.bincount(doc, minlength=docs)
    first = np.zeros(docs + 1, np.int64)
    np.cumsum(words, out=first[1:])
    shingles = np.where(words == 0, 0, np.maximum(words - width + 1, 1))
    head = np.zeros(docs + 1, np.int64)
    np.cumsum(shingles, out=head[1:])
    votes = np.zeros((docs, 64), np.int64)
    for at in range(0, int(head[-1]), PASS_SHINGLES):
        index = np.arange(at, min(at + PASS_SHINGLES, int(head[-1])))
        owner = np.searchsorted(head, index, side="right") - 1
        word = first[owner] + index - head[owner]
        last = np.minimum(word + width, first[owner + 1]) - 1
        hashed = kernel.xxh64(data, starts[word], ends[last], SEED)
        _vote(votes, hashed, owner)
    bits = (2 * votes > shingles[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _vote(votes: np.ndarray, hashed: np.ndarray, owner: np.ndarray) -> None:
    """Adds each hash's set bits to its document's counts; byte lanes sum at most 255 rows before they are widened."""
    lanes = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    length = np.diff(np.append(edge, len(owner)))
    parts = (length + 254) // 255
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = np.repeat(edge, parts) + 255 * nth
    sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(-1, 64)
    np.add.at(votes, owner[cuts], sums)


def _fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.flat(batch.column(1))
            found = fingerprints(data, offsets, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return run


def fingerprint_table(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row; a null text counts as empty."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches(width), f"doc_id {kind}, fp long")


def _variants(rows: DataFrame, low: int, bits: int, level: int) -> DataFrame:
    """Each row under every one-wildcard variant of the two halves of bits ``low`` to ``low + bits``."""
    half = bits // 2
    window = F.expr(f"shiftrightunsigned(fp, {low} + {half} * (v div {half})) & {(1 << half) - 1}L")
    masked = window.bitwiseAND(F.expr(f"~shiftleft(1L, v % {half})"))
    free = F.when(F.col("v") < half, F.lit(low + half)).otherwise(F.lit(low))
    exploded = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    before = F.col("key") if level else F.lit(0).cast("long")
    return exploded.select(F.xxhash64(before, "v", masked).alias("key"), free.alias("free"), F.lit(half).alias("bits"), "fp")


def _runs(bits: int, limit: int):
    """Links inside runs of equal keys of sorted rows; rows of longer runs come back as deferred."""
    none = np.zeros(0, np.int64)

    def emit(kind: int, a: np.ndarray, b: np.ndarray, free: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(free.astype(np.int32)), pa.array(key)],
            ["kind", "a", "b", "free", "key"],
        )

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count((x ^ y).view(np.uint64)) <= bits

    def span(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning tree of every group of links inside one run, without listing all its pairs."""
        left, a, b = fps, [], []
        while len(left):
            seed, left = left[:1], left[1:]
            front = seed
            while len(front) and len(left):
                new = np.zeros(len(left), bool)
                for x in front:
                    new |= near(left, x)
                front, left = left[new], left[~new]
                a.append(np.repeat(seed, len(front)))
                b.append(front)
        return (np.concatenate(a), np.concatenate(b)) if a else (none, none)

    def settled(key: np.ndarray, fp: np.ndarray, free: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs."""
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(np.append(edge, len(key)))
        size = np.repeat(length, length)
        short = (size > 1) & (size <= SHORT_RUN)
        a, b = [], []
        for step in range(1, SHORT_RUN):
            at = np.flatnonzero(short[:-step] & (key[:-step] == key[step:]) & (fp[:-step] != fp[step:]))
            at = at[near(fp[at], fp[at + step])]
            a.append(fp[at])
            b.append(fp[at + step])
        for start, n in zip(edge[length > SHORT_RUN].tolist(), length[length > SHORT_RUN].tolist()):
            fps, at = np.unique(fp[start : start + n], return_index=True)
            if len(fps) > limit:
                yield emit(1, fps, fps, free[start + at], key[start + at])
                continue
            x, y = span(fps)
            a.append(x)
            b.append(y)
        x, y = np.concatenate(a), np.concatenate(b)
        if len(x):
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            blank = np.zeros(len(pairs), np.int64)
            yield emit(0, pairs[:, 0].copy(), pairs[:, 1].copy(), blank, blank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [none, none, none]
        open_key: int | None = None  # of a run already found too long
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]  # key, free, fp
            if open_key is not None:
                more = int(np.searchsorted(new[0], open_key, side="right"))
                if more:
                    yield emit(1, new[2][:more], new[2][:more], new[1][:more], new[0][:more])
                    new = [x[more:] for x in new]
                if not len(new[0]):
                    continue
                open_key = None
            held = [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1], side="left"))
            if cut:
                yield from settled(held[0][:cut], held[2][:cut], held[1][:cut])
                held = [x[cut:] for x in held]
            if len(held[0]) > 2 * limit:
                fps, at = np.unique(held[2], return_index=True)
                held = [held[0][at], held[1][at], fps]
                if len(fps) > limit:
                    open_key = int(held[0][0])
                    yield emit(1, fps, fps, held[1], held[0])
                    held = [none, none, none]
        if len(held[0]):
            yield from settled(held[0], held[2], held[1])

    return run


def near_links(reps: DataFrame, bits: int = MAX_BITS, limit: int = RUN_ROWS) -> DataFrame:
    """Links u < v that connect what pairs of ``reps.fp`` (distinct) at ``bits`` or fewer differing bits connect."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("two segments allow at most three differing bits")
    rows, links = reps.select("fp"), []
    for level, width in enumerate((64, 32, 16)):
        if level == 0:
            keyed = _variants(rows, 0, width, level)
        else:
            low = [x for x in range(0, 64, width)]
            parts = [_variants(rows.where(F.col("free") == x), x, width, level) for x in low]
            keyed = parts[0]
            for part in parts[1:]:
                keyed = keyed.unionByName(part)
        keyed = keyed.select("key", "free", "fp").repartition("key").sortWithinPartitions("key", "fp")
        found = keep(keyed.mapInArrow(_runs(bits, limit), "kind int, a long, b long, free int, key long"))
        links.append(found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")))
        rows = found.where("kind = 1").select(F.col("a").alias("fp"), "free", "key").distinct()
        if level == 2 or found.where("kind = 1").isEmpty():
            break
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _grouped(prints: DataFrame, bits: int, limit: int) -> DataFrame:
    """print and component_id of every distinct fingerprint of a written table ``prints(doc_id, fp)``."""
    reps = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(reps, bits, limit))
    grouped = reps.join(roots, reps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = grouped.where("root <> fp").select("root", "fp", "first")
    heads = linked.select("root").distinct().join(reps.withColumnRenamed("fp", "root"), "root").select("root", F.col("root").alias("fp"), "first")
    members = linked.unionByName(heads)
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    joined = keep(members.join(least, "root").select(F.col("fp").alias("member"), "least"))
    component = F.when(F.col("member").isNull(), F.col("first")).otherwise(F.col("least"))
    return reps.join(joined, reps.fp == joined.member, "left").select(F.col("fp").alias("print"), component.alias("component_id"))


def representatives(docs: DataFrame, bits: int = MAX_BITS, width: int = 3, limit: int = RUN_ROWS) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, all columns as they are.

    The smallest doc_id of a group stays; of rows that repeat it, or of a group
    without any id, the first row. Only the row numbers that stay are joined with
    texts. They are written with the texts: a second scan of ``docs`` may be split
    otherwise and number its rows anew.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    fingerprint = _fingerprint_batches(width)
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fingerprint(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], ["doc_id", "fp", "row"])

    prints = keep(numbered.select("doc_id", "text", row).mapInArrow(run, f"doc_id {kind}, fp long, row long"))
    named = _grouped(prints, bits, limit)
    # per fingerprint first: the copies of one text are combined before they meet the groups
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first"))
    heads = first.join(named, first.fp == named.print).groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).agg(F.min("first").alias("first"))
    stay = keep(heads.select(F.col("first.row").alias("kept")))
    if stay.count() <= BROADCAST_ROWS:
        stay = F.broadcast(stay)
    return numbered.join(stay, numbered[row] == stay["kept"], "left_semi").select(*docs.columns)


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS, width: int = 3, limit: int = RUN_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row of ``docs(doc_id, text, ...)``.

    Texts are lower-cased in A-Z and cut into words without ASCII white space;
    shingles are ``width`` words (a shorter text: all its words). A null, empty or
    blank text has fingerprint zero and links like any other. Rows that repeat a
    doc_id each keep a row. ``component_id`` is the smallest non-null doc_id
    reachable (null if there is none). Other columns are ignored; an empty table
    gives an empty result.
    """
    prints = keep(fingerprint_table(docs, width))
    named = _grouped(prints, bits, limit)
    out = prints.join(named, prints.fp == named.print)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
