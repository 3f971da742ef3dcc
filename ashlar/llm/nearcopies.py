"""Near copies by the exact Jaccard similarity of 5-word shingle sets, of texts that meet by SimHash or in min-hash bands.

Texts whose SimHash fingerprints differ in at most three bits are compared, as ``simhash``
links them. That finds copies, and few of the edited ones: at a similarity of 0.8 two 64-bit SimHash fingerprints differ in about ten bits
(up to 17), too many for an index of bit segments. Texts therefore meet in min-hash
bands as well, if they agree on all ``ROWS`` min-hashes of one of ``BANDS`` bands, which
misses a pair at 0.8 with probability 5e-8.

Texts that meet are not paired. First each is compared with the head of its
band's texts (the one with the fewest shingles that are not frequent: a text that
was not edited), and what is near is joined. A band's texts that are then of
different groups are still open. Those that hold too many shingles which no other
group holds can be near no text of another group, whatever it is; counting
shingles tells which, in work that is linear in the texts. What remains open is
compared inside tasks, block against block, and only the links that join groups
leave a task: a pair of texts is never a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, simhash
from .common import keep, tune
from .components import components

WIDTH = 5
#: Least similarity of near copies, as a fraction of integers.
SHARE = (4, 5)
ROWS, BANDS = 4, 32
#: Words of a shingle of the fingerprints.
FINGERPRINT_WIDTH = 3
#: Frequent shingles are those of every so many-th row; they choose heads, so that only costs depend on them, not results.
HEAD_SHARE = 16
#: Frequent shingles that are broadcast at most (8 bytes each).
FREQUENT = 1 << 20
#: Row numbers that are broadcast at most to filter texts; more meet them in a shuffle.
BROADCAST_ROWS = 1 << 18
#: Bytes of the shingle sets of one block; the texts of a band that hold more are compared block against block.
BLOCK_BYTES = 8 << 20
_RNG = np.random.default_rng(42)
MULTIPLY = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.int64).view(np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document of one slice, sorted by document and hash, and the documents' bounds."""
    docs = len(offsets) - 1
    data, offsets = kernel.squeeze(kernel.lower_ascii(data), offsets)
    starts, ends, _, doc = kernel.runs((data != 32).view(np.uint8), offsets)
    word = kernel.xxh64(data, starts, ends)
    words = np.bincount(doc, minlength=docs)
    end = np.cumsum(words)
    shingles = np.where(words == 0, 0, np.maximum(words - width + 1, 1))
    owner = np.repeat(np.arange(docs), shingles)
    at = np.arange(len(owner)) + np.repeat((end - words) - (np.cumsum(shingles) - shingles), shingles)
    hashed = word[at]
    for step in range(1, width):
        inside = at + step < end[owner]
        hashed = np.where(inside, kernel.mix(hashed, word[np.where(inside, at + step, at)]), hashed)
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.append(True, (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1]))[: len(hashed)]
    return hashed[new], np.searchsorted(owner[new], np.arange(docs + 1))


def _sums(hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that stand for a whole set."""
    total = np.zeros((2, len(hashed) + 1), np.uint64)
    np.cumsum(hashed, out=total[0, 1:])
    np.cumsum(kernel.mix(hashed, hashed), out=total[1, 1:])
    return (total[:, bounds[1:]] - total[:, bounds[:-1]]).view(np.int64)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of a column of texts with their shingle sets."""
    data, offsets = kernel.flat(column)
    for lo, hi in kernel.slices(offsets):
        yield lo, hi, *shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, hashed, bounds in _slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            longs = (*_sums(hashed, bounds), np.diff(bounds))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(np.ascontiguousarray(x)) for x in longs)], ["doc_id", "row", "h1", "h2", "n"])


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, hashed, _ in _slices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64))], ["shingle"])


def _owned_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shingle of every text with its node and root."""
    for batch in batches:
        for lo, hi, hashed, bounds in _slices(batch.column(1)):
            each = pa.array(np.repeat(np.arange(lo, hi), np.diff(bounds)))
            yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), batch.column(0).take(each), batch.column(2).take(each)], ["shingle", "node", "root"])


def band_keys(hashed: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The key of every (not empty) set in each band."""
    first = bounds[:-1]
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(first), band + 1, np.uint64)
            for i in range(band * ROWS, (band + 1) * ROWS):
                mixed = hashed ^ FLIP[i]
                mixed *= MULTIPLY[i]
                key = kernel.mix(key, np.minimum.reduceat(mixed >> np.uint64(32), first))
            yield key.view(np.int64)


def _key_batches(sent):
    """Band keys of every text that is not blank, and its turn: shingles that are not frequent, then chance. ``sent``: the frequent shingles, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for lo, hi, hashed, bounds in _slices(batch.column(1)):
                size = np.diff(bounds)
                node = nodes[lo:hi][size > 0]
                if not len(node):
                    continue
                rare = np.ones(len(hashed), np.int64)
                if len(known):
                    rare = (known[np.minimum(np.searchsorted(known, hashed), len(known) - 1)] != hashed).astype(np.int64)
                size = size[size > 0]
                bounds = np.append(0, np.cumsum(size))
                chance = (kernel.mix(node.view(np.uint64), node.view(np.uint64)) >> np.uint64(33)).astype(np.int64)
                turn = (np.add.reduceat(rare, bounds[:-1]) << 31) + chance
                for key in band_keys(hashed, bounds):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(turn), pa.array(size)], ["key", "node", "turn", "n"])

    return run


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, hashed, bounds in _slices(batch.column(1)):
            sets = [hashed[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["node", "held"])


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
            common = len(np.intersect1d(x, y, assume_unique=True)) if SHARE[1] * min(len(x), len(y)) >= SHARE[0] * max(len(x), len(y)) else 0
            near[i] = SHARE[1] * common >= SHARE[0] * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(near))


def block_links(nodes: np.ndarray, roots: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between texts ``left`` and texts ``right`` (places) that are near and of different groups, as few as join the groups.

    Shingles in common are counted for one text with all others at once, along lists of the texts that hold a shingle.
    """
    size = np.array([len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.append(0, np.cumsum(size))
    held = np.concatenate([place[bounds[y] : bounds[y + 1]] for y in right])
    owner = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    group: dict[int, int] = {}

    def find(root: int) -> int:
        while (up := group.setdefault(root, root)) != root:
            group[root] = group[up] if up in group else up
            root = up
        return root

    links = []
    for x in left:
        own = place[bounds[x] : bounds[x + 1]]
        first, last = np.searchsorted(held, own), np.searchsorted(held, own, side="right")
        times = last - first
        common = np.bincount(owner[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())], minlength=len(right))
        for y in right[(SHARE[0] + SHARE[1]) * common >= SHARE[0] * (size[x] + size[right])]:
            a, b = find(int(roots[x])), find(int(roots[y]))
            if a != b:
                group[a] = b
                links.append((int(nodes[x]), int(nodes[y])))
    return links


def _block_table(rows: pa.Table) -> pa.Table:
    nodes, roots, block, i, j = (rows[c].to_numpy() for c in ("node", "root", "block", "i", "j"))
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows["held"]]
    links = block_links(nodes, roots, np.flatnonzero(block == i), np.flatnonzero(block == j), sets)
    return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})


def _bounded(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """The most frequent shingles of a column of texts (hashes in order), ``FREQUENT`` at most."""
    counts = keep(texts.mapInArrow(_shingle_batches, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2"))
    level = F.floor(F.log2("n")).cast("int")
    least = total = 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += row["count"]
        if total > FREQUENT:
            least = row["level"] + 1
            break
    return np.sort(counts.where(level >= least).select("shingle").toArrow().column(0).to_numpy().view(np.uint64))


def texts_of(numbered: DataFrame, row: str, nodes: DataFrame) -> DataFrame:
    """node and text of the rows whose number is in ``nodes(kept)``."""
    return numbered.join(_bounded(nodes), numbered[row] == nodes["kept"], "left_semi").select(F.col(row).alias("node"), "text")


def open_runs(met: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, n and root of the bands' texts, where a band has three or more and they are of several groups (two have been compared)."""
    rows = met.where("texts > 2").select("key", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows.join(keep(_several(rows)), "key", "left_semi")


def _several(rows: DataFrame) -> DataFrame:
    """The keys of rows of several groups, one key for all that hold the same texts."""
    runs = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("texts"), *(F.bit_xor(F.xxhash64(F.lit(i), F.col("node"))).alias(f"x{i}") for i in range(2)))
    return runs.where("low <> high").groupBy("x0", "x1", "texts").agg(F.min("key").alias("key")).select("key")


def within_reach(rows: DataFrame, shingles: DataFrame) -> DataFrame:
    """Those of ``rows(key, node, n, root)`` that may be near a text of another group in their band.

    ``shingles(shingle, node, root)``: all shingles of their texts. A text holds
    ``own`` shingles that only its group holds. With a text of another group it has
    at most ``n - own`` in common, and together they hold at least ``n`` and the other's own.
    """
    single = shingles.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low = high").select("shingle")
    own = shingles.join(single, "shingle").groupBy("node").agg(F.count("*").alias("own"))
    known = keep(rows.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0))))
    least = keep(known.groupBy("key").agg(F.min("own").alias("least")))  # written, so that a hot key can be split where it is joined
    return known.join(least, "key").where(SHARE[1] * (F.col("n") - F.col("own")) >= SHARE[0] * (F.col("n") + F.col("least"))).select("key", "node", "n", "root")


def _linked_across(met: DataFrame, roots: DataFrame, numbered: DataFrame, row: str) -> DataFrame:
    """The links u, v between texts of different groups that meet in a band."""
    rows = keep(open_runs(met, roots))
    nodes = keep(rows.select("node", "root").distinct())
    held = texts_of(numbered, row, nodes.select(F.col("node").alias("kept"))).join(_bounded(nodes), "node")
    rows = keep(within_reach(rows, held.select("node", "text", "root").mapInArrow(_owned_batches, "shingle long, node long, root long")))
    rows = rows.join(keep(_several(rows)), "key", "left_semi")
    blocks = rows.groupBy("key").agg(F.ceil(8 * F.sum("n") / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = rows.join(keep(blocks), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = keep(dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    sets = texts_of(numbered, row, keep(dealt.select(F.col("node").alias("kept")).distinct())).mapInArrow(_set_batches, "node long, held binary")
    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(lambda rows: _block_table(rows), "u long, v long")


def fingerprint_pairs(numbered: DataFrame, row: str, nodes: DataFrame) -> DataFrame:
    """Pairs a < b of texts (``nodes(kept)``, their row numbers) that meet by SimHash: each with the first of its fingerprint, and the first ones of linked fingerprints."""
    own = texts_of(numbered, row, nodes)
    prints = keep(simhash.fingerprint_table(own.withColumnRenamed("node", "doc_id"), FINGERPRINT_WIDTH))
    heads = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("head")))
    same = prints.join(heads, "fp").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    links = simhash.near_links(heads.select("fp"))
    left = links.join(heads.toDF("u", "x"), "u").join(heads.toDF("v", "y"), "v")
    return same.unionByName(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).where("a <> b")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies of ``docs``, all columns as they are.

    Groups are what pairs of texts with at least 0.8 of their 5-word shingles in
    common connect. The smallest doc_id of a group stays; of rows that repeat it,
    or of a group without any id, the first row. Null and blank texts are one
    group; a text of fewer than five words is one shingle. Row numbers are written
    with the texts, so that every later read finds the same ones. An empty table
    gives an empty result.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()))
    prints = numbered.select("doc_id", "text", row).mapInArrow(_print_batches, f"doc_id {kind}, row long, h1 long, h2 long, n long")
    best = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    texts = keep(prints.groupBy("h1", "h2", "n").agg(F.min("row").alias("node"), F.min(best).alias("first")))

    def of(nodes: DataFrame) -> DataFrame:
        """node and text of some rows."""
        return texts_of(numbered, row, nodes)

    def near(pairs: DataFrame) -> DataFrame:
        """Those of written pairs a < b whose sets are near."""
        nodes = keep(pairs.select(F.explode(F.array("a", "b")).alias("kept")).distinct())
        sets = keep(of(nodes).mapInArrow(_set_batches, "node long, held binary"))
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b").select("a", "b", "x", "y")
        return keep(both.mapInArrow(_near_batches, "u long, v long"))

    sample = numbered.where(F.pmod(F.xxhash64(row), F.lit(HEAD_SHARE)) == 0).select("text")
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(sample))
    index = keep(of(texts.select(F.col("node").alias("kept"))).mapInArrow(_key_batches(sent), "key long, node long, turn long, n long"))
    heads = keep(index.groupBy("key").agg(F.count("*").alias("texts"), F.min_by("node", "turn").alias("head"), F.min_by("n", "turn").alias("head_n")).where("texts > 1"))
    met = keep(index.select("key", "node", "n").join(heads, "key"))

    pair = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    alike = SHARE[1] * F.least("n", "head_n") >= SHARE[0] * F.greatest("n", "head_n")
    tried = keep(met.where((F.col("node") != F.col("head")) & alike).withColumnRenamed("head", "other").select(*pair).distinct())
    met_by_print = fingerprint_pairs(numbered, row, texts.where("n > 0").select(F.col("node").alias("kept")))
    links = near(keep(tried.unionByName(met_by_print).distinct()))
    roots = components(links)

    more = keep(_linked_across(met, roots, numbered, row))
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    groups = texts.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    stay = keep(groups.select(F.col("first.row").alias("kept")))
    return numbered.join(_bounded(stay), numbered[row] == stay["kept"], "left_semi").select(*docs.columns)
