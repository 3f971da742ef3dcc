"""Packing of tokenised documents into fixed windows by non-negative least squares.

A document's ids (with one end id) give full windows and one remainder. Shallow
combinations of remainder lengths that fill a window exactly are enumerated, and
their repeat counts are solved by non-negative least squares against the
corpus-wide histogram of remainders, then rounded down. What the combinations
leave over is packed greedily, longest first, with cuts at window ends. The last
window is cut at powers of two, so that no sequence needs padding.

The driver sees only the histogram (at most one number for each length) and the
plan. Documents find their places by their rank among equal lengths: the task that
writes tokens numbers its own, and counts by (task, length) shift these numbers,
so that a length held by a third of all documents is ranked by all tasks. Ids are
not shuffled while the shifts are few enough to broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, tune

WINDOW = 2048
END_ID = 1
#: Shifts, one for each length of each task, that are broadcast at most (about 100 bytes each as a hash table); more are joined by a shuffle.
BROADCAST_SHIFTS = 1 << 18
#: Sequence ids of full windows are numbered inside tasks, above this many bits.
TASK_BITS = 40
#: Bounds of the enumeration: pairs are complete, triples are those of the most frequent lengths.
TRIPLE_LENGTHS = 96
SWEEPS = 60

_HELD: dict[tuple[str, str], "ByteBpe"] = {}


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file, equal to those of the tokenizers library."""

    #: Fixed value: the byte-level split pattern; possessive, which matches alike and faster.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

    def __init__(self, path: str):
        import json

        import tiktoken

        from .bpe import byte_characters

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.model = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.width = "<u2" if self.model.max_token_value < 1 << 16 else "<u4"

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.model.encode_to_numpy(text, allowed_special="all")
        except Exception:  # the pattern engine's limit on extreme white space  # noqa: BLE001
            from tokenizers import Tokenizer

            return np.array(Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids, np.uint32)


def held(path: str) -> ByteBpe:
    if (path, "bytes") not in _HELD:
        _HELD[path, "bytes"] = ByteBpe(path)
    return _HELD[path, "bytes"]


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """doc_id, n, ids (packed little-endian, ``width`` bytes each) and place of every row; null texts are empty.

    ``part`` is the task, ``rank`` the row's number among the task's rows of equal
    ``rest`` (the length of its remainder), ``full_before`` the number of full
    windows before its own in the task. Write the table before it is used: a
    task's numbers hold together only as one attempt wrote them.
    """
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = held(path)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        seen, full = np.zeros(window, np.int64), 0
        for batch in batches:
            ids = [np.append(model.ids(text or ""), end).astype(model.width) for text in batch.column(1).to_pylist()]
            places = []
            for x in ids:
                rest = len(x) % window
                places.append((len(x), part, rest, int(seen[rest]), full))
                seen[rest] += 1
                full += len(x) // window
            columns = zip(*places) if places else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in columns), pa.array([np.dtype(model.width).itemsize] * len(ids), pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "n", "part", "rest", "rank", "full_before", "width", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, part long, rest long, rank long, full_before long, width int, ids binary")


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Length triples (0: none) that fill a window: every pair that occurs, and triples of frequent lengths."""
    seen = np.flatnonzero(histogram)
    seen = seen[(seen > 0) & (seen < window)]
    if not len(seen):
        return np.zeros((0, 3), np.int64)
    pairs = np.stack([seen, window - seen, np.zeros_like(seen)], axis=1)
    pairs = pairs[(pairs[:, 0] >= pairs[:, 1]) & (histogram[pairs[:, 1]] > 0)]
    often = np.sort(seen[np.argsort(-histogram[seen], kind="stable")][:TRIPLE_LENGTHS])
    a, b = np.meshgrid(often, often, indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    good = (a >= b) & (b >= c) & (c > 0)
    a, b, c = a[good], b[good], c[good]
    filled = histogram[c] > 0
    triples = np.stack([a[filled], b[filled], c[filled]], axis=1)
    return np.concatenate([pairs, triples])


def solve(histogram: np.ndarray, combos: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares of repeat counts against the histogram, by cyclic coordinate descent on sparse columns."""
    columns = []
    for combo in combos.tolist():
        index, count = np.unique([x for x in combo if x], return_counts=True)
        columns.append((index.tolist(), count.tolist(), float((count**2).sum())))
    rest = histogram.astype(float).tolist()
    x = [0.0] * len(columns)
    for _ in range(sweeps):
        moved = 0.0
        for i, (index, count, norm) in enumerate(columns):
            step = sum(c * rest[j] for j, c in zip(index, count)) / norm
            new = max(0.0, x[i] + step)
            step = new - x[i]
            if step:
                x[i] = new
                for j, c in zip(index, count):
                    rest[j] -= c * step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return np.array(x)


class Plan:
    """Where the r-th remainder of each length goes.

    Ranks below a length's planned use fill combinations in order; the others lie
    end to end, longest first, from sequence ``greedy_sequence`` on.
    """

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window = window
        combos = combinations(histogram, window)
        repeats = np.floor(solve(histogram, combos) + 1e-9).astype(np.int64)
        left = histogram.astype(np.int64).copy()
        self.begin: list[list[int]] = [[] for _ in range(window)]
        self.target: list[list[tuple[int, int]]] = [[] for _ in range(window)]
        used = np.zeros(window, np.int64)
        sequence = 0
        for combo, times in zip(combos.tolist(), repeats.tolist()):
            parts = [x for x in combo if x]
            need = np.bincount(parts, minlength=window)
            fits = int(min(times, (left[need > 0] // need[need > 0]).min()))
            if fits <= 0:
                continue
            at = 0
            for length in parts:
                self.begin[length].append(int(used[length]))
                self.target[length].append((sequence, at))
                used[length] += fits
                at += length
            left -= fits * need
            sequence += fits
        self.used = used
        self.combined = sequence
        order = np.arange(window - 1, 0, -1)
        tokens = left[order] * order
        first = np.zeros(window, np.int64)
        first[order] = np.cumsum(tokens) - tokens
        self.first = first
        self.greedy_tokens = int(tokens.sum())

    @property
    def sequences(self) -> int:
        """Sequences of remainders, those of the cut last window included."""
        whole, rest = divmod(self.greedy_tokens, self.window)
        return self.combined + whole + rest.bit_count()

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, piece length) of a remainder's pieces, in order."""
        if rank < self.used[length]:
            at = int(np.searchsorted(self.begin[length], rank, side="right")) - 1
            sequence, offset = self.target[length][at]
            return [(sequence + rank - self.begin[length][at], offset, length)]
        start = int(self.first[length]) + (rank - int(self.used[length])) * length
        out = []
        while length:
            sequence, offset, room = self._greedy(start)
            piece = min(room, length)
            out.append((sequence, offset, piece))
            start += piece
            length -= piece
        return out

    def _greedy(self, at: int) -> tuple[int, int, int]:
        """Sequence, offset and room of a position of the greedy line; its last window falls into powers of two."""
        whole, rest = divmod(self.greedy_tokens, self.window)
        index, offset = divmod(at, self.window)
        if index < whole:
            return self.combined + index, offset, self.window - offset
        sequence = self.combined + whole
        for bit in range(rest.bit_length() - 1, -1, -1):
            size = rest & (1 << bit)
            if not size:
                continue
            if offset < size:
                return sequence, offset, size - offset
            offset -= size
            sequence += 1
        raise ValueError("position beyond the residual tokens")


def shifted(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ranks that count over all tasks."""
    cells = tokens.groupBy("part", "rest").agg(F.count("*").alias("n"))
    shifts = keep(cells.selectExpr("part", "rest", "sum(n) over (partition by rest order by part) - n as shift"))
    if shifts.count() <= BROADCAST_SHIFTS:
        shifts = F.broadcast(shifts)
    return tokens.join(shifts, ["part", "rest"]).withColumn("rank", F.col("rank") + F.col("shift"))


def pack(tokens: DataFrame, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of ``tokens`` (as ``tokenised`` gives them, in a written table)."""
    histogram = np.zeros(window, np.int64)
    for row in tokens.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect():
        histogram[row.rest] = row.n
    plan = Plan(histogram, window)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    sent = tokens.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            ids_out: list[bytes] = []
            rows = zip(*(c.to_pylist() for c in batch.columns[1:7]), batch.column(7))
            for at, (n, part, rest, rank, full_before, width, packed_ids) in enumerate(rows):
                ids = np.frombuffer(packed_ids.as_buffer(), f"<u{width}").astype("<u4")
                first = ((part + 1) << TASK_BITS) + full_before
                pieces = [(first + i, 0, window) for i in range(n // window)]
                if rest:
                    pieces += own.place(rest, rank)
                start = 0
                for sequence, offset, length in pieces:
                    piece = ids[start : start + length].tobytes()
                    for column, value in zip(out, (at, start, length, zlib.crc32(piece), n, sequence, offset)):
                        column.append(value)
                    if with_ids:
                        ids_out.append(piece)
                    start += length
            arrays = [batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = shifted(tokens).select("doc_id", "n", "part", "rest", "rank", "full_before", "width", "ids")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def packed(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs(doc_id, text, ...)``.

    Every row, also a repeated one, gives its ids exactly once; a null or empty
    text is the end id alone. Other columns are ignored; an empty table gives an
    empty result.
    """
    return pack(keep(tokenised(docs, path, window=window)), window, with_ids)
