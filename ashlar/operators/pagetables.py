"""Tables of pages from geometry: cells between ruled lines, or columns between gaps of words.

A page is a row: its words and ruled lines meet in one task, where numpy finds
grids and each is judged; which finding counts for a page is a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import small_batches

#: Lines closer than this are one; ends of lines reach so far.
TOLERANCE = 2.0
#: Characters of white space that divide two cells of a line.
CELL_GAP = 2.0
#: Usual line distances that a table may leave between its lines.
LINE_GAP = 2.0
MIN_ACCURACY = 50.0
CORNERS = ("x0", "y0", "x1", "y1")
GRID = "page long, flavor string, accuracy double, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>"


@dataclass
class Grid:
    flavor: str
    accuracy: float
    box: tuple[float, float, float, float]
    cells: list[list[str]]


@dataclass
class Words:
    """Words of a page, with the line of each (from the top)."""

    box: np.ndarray
    text: np.ndarray
    line: np.ndarray

    @classmethod
    def of(cls, box: np.ndarray, text: list[str] | np.ndarray) -> Words:
        height = _median(box[:, 3] - box[:, 1]) if len(box) else 1.0
        return cls(box, np.array(text, object), snapped((box[:, 1] + box[:, 3]) / 2, height / 2)[1])

    def joined(self, cell: np.ndarray) -> dict[int, str]:
        """Text of every cell number (below 0: none): words of a line divided by a space, lines by a break."""
        at = np.flatnonzero(cell >= 0)
        at = at[np.lexsort((self.box[at, 0], self.line[at], cell[at]))]
        out: dict[int, str] = {}
        number, held, last = -1, "", -1
        for c, line, word in zip(cell[at].tolist(), self.line[at].tolist(), self.text[at].tolist()):
            if c != number:
                out[number] = held
                number, held = c, word
            else:
                held += ("\n" if line != last else " ") + word
            last = line
        out[number] = held
        out.pop(-1)
        return out


def _median(values: np.ndarray) -> float:
    """numpy's median without its checks, which cost more than the figure on lists as short as a page's."""
    low, high = (len(values) - 1) // 2, len(values) // 2
    part = np.partition(values, (low, high))
    return (part[low] + part[high]) / 2


def _among(size: int, places: np.ndarray) -> np.ndarray:
    """Of ``size`` numbers those that occur, as a mask."""
    out = np.zeros(size, bool)
    out[places] = True
    return out


def snapped(values: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Means of groups of values whose neighbours are at most ``tolerance`` apart, and each value's group."""
    order = np.argsort(values, kind="stable")
    group = np.empty(len(values), np.int64)
    group[order] = np.cumsum(np.append(0, np.diff(values[order]) > tolerance))[: len(values)]
    return np.bincount(group, weights=values) / np.maximum(np.bincount(group), 1), group


def spans(line: np.ndarray, low: np.ndarray, high: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, begin and end of the longest stretches that pieces of lines cover."""
    if not len(line):
        return line, low, high
    order = np.lexsort((low, line))
    line, low, high = line[order], low[order], high[order]
    far = (max(high.max(), 0) - min(low.min(), 0)) + 2 * tolerance + 1
    reach = np.maximum.accumulate(high + line * far)
    new = np.append(True, low[1:] + line[1:] * far > reach[:-1] + tolerance)
    first = np.flatnonzero(new)
    return line[first], low[first], reach[np.append(first[1:], len(line)) - 1] - line[first] * far


def _connected(touch: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of the connected parts of a matrix of crossings."""
    left, out = touch.any(axis=1), []
    while left.any():
        rows = np.zeros(len(touch), bool)
        rows[int(left.argmax())] = True
        while True:
            columns = touch[rows].any(axis=0)
            more = touch[:, columns].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        out.append((np.flatnonzero(rows), np.flatnonzero(columns)))
        left &= ~rows
    return out


def lattice(words: Words, rules: np.ndarray, tolerance: float = TOLERANCE) -> list[Grid]:
    """Grids of ruled lines (x0, y0, x1, y1), by their crossings; cells without a line between them are one, its text stands in the first."""
    low, high = np.minimum(rules[:, :2], rules[:, 2:]), np.maximum(rules[:, :2], rules[:, 2:])
    flat = (high[:, 1] - low[:, 1] <= tolerance) & (high[:, 0] - low[:, 0] > tolerance)
    tall = (high[:, 0] - low[:, 0] <= tolerance) & (high[:, 1] - low[:, 1] > tolerance)
    y, y_of = snapped(low[flat, 1], tolerance)
    x, x_of = snapped(low[tall, 0], tolerance)
    h_line, h_low, h_high = spans(y_of, low[flat, 0], high[flat, 0], tolerance)
    v_line, v_low, v_high = spans(x_of, low[tall, 1], high[tall, 1], tolerance)
    if not len(h_line) or not len(v_line):
        return []
    hy, vx = y[h_line], x[v_line]
    touch = (vx >= h_low[:, None] - tolerance) & (vx <= h_high[:, None] + tolerance) & (hy[:, None] >= v_low - tolerance) & (hy[:, None] <= v_high + tolerance)
    out = []
    for h, v in _connected(touch):
        ys, xs = np.unique(hy[h]), np.unique(vx[v])
        if len(ys) < 3 or len(xs) < 3:
            continue
        rows, columns = len(ys) - 1, len(xs) - 1
        middle_y, middle_x = (ys[1:] + ys[:-1]) / 2, (xs[1:] + xs[:-1]) / 2
        above, beside = np.zeros((rows, columns), bool), np.zeros((rows, columns), bool)
        above[0], beside[:, 0] = True, True
        place = np.searchsorted(ys, hy[h])
        own = h[place < rows]
        np.logical_or.at(above, place[place < rows], (middle_x >= h_low[own, None]) & (middle_x <= h_high[own, None]))
        for i in v:
            place = int(np.searchsorted(xs, vx[i]))
            if place < columns:
                beside[(middle_y >= v_low[i]) & (middle_y <= v_high[i]), place] = True
        top = np.maximum.accumulate(np.where(above, np.arange(rows)[:, None], 0), axis=0)
        left = np.maximum.accumulate(np.where(beside, np.arange(columns), 0), axis=1)
        home = top * columns + left
        # a merged cell ends where its last part does
        bottom, right = np.zeros(rows * columns), np.zeros(rows * columns)
        np.maximum.at(bottom, home.ravel(), np.repeat(ys[1:], columns))
        np.maximum.at(right, home.ravel(), np.tile(xs[1:], rows))
        centre = (words.box[:, :2] + words.box[:, 2:]) / 2
        row, column = np.searchsorted(ys, centre[:, 1]) - 1, np.searchsorted(xs, centre[:, 0]) - 1
        inside = (row >= 0) & (row < rows) & (column >= 0) & (column < columns)
        cell = np.full(len(centre), -1)
        cell[inside] = home[row[inside], column[inside]]
        held = words.box[inside]
        own = cell[inside]
        wide = np.minimum(held[:, 2], right[own]) - np.maximum(held[:, 0], xs[own % columns])
        high_ = np.minimum(held[:, 3], bottom[own]) - np.maximum(held[:, 1], ys[own // columns])
        area = np.maximum((held[:, 2] - held[:, 0]) * (held[:, 3] - held[:, 1]), 1e-9)
        accuracy = 100 * float(np.mean(np.clip(wide, 0, None) * np.clip(high_, 0, None) / area)) if len(held) else 0.0
        text = words.joined(cell)
        out.append(Grid("lattice", accuracy, (xs[0], ys[0], xs[-1], ys[-1]), [[text.get(r * columns + c, "") for c in range(columns)] for r in range(rows)]))
    return sorted(out, key=lambda g: (g.box[1], g.box[0]))


def stream(words: Words) -> list[Grid]:
    """Grids of words alone: lines cut at wide gaps, in columns that the lines of the usual number of pieces leave free between them.

    A piece that reaches over several columns ends a table, and so does a wide step down.
    """
    if not len(words.text):
        return []
    box, line = words.box, words.line
    char = _median((box[:, 2] - box[:, 0]) / np.maximum([len(t) for t in words.text], 1))
    order = np.lexsort((box[:, 0], line))
    new = np.append(True, (line[order][1:] != line[order][:-1]) | (box[order][1:, 0] - box[order][:-1, 2] > CELL_GAP * char))
    piece = np.empty(len(order), np.int64)
    piece[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    n = len(first)
    p_line = line[order][first]
    p_low, p_high = box[order][first, 0], np.maximum.reduceat(box[order][:, 2], first)
    lines = int(line.max()) + 1
    centre = np.bincount(line, weights=(box[:, 1] + box[:, 3]) / 2, minlength=lines) / np.bincount(line, minlength=lines)
    step = np.diff(centre)
    block = np.append(0, np.cumsum(step > LINE_GAP * _median(step))) if len(step) else np.zeros(1, np.int64)
    pieces = np.bincount(p_line, minlength=lines)
    column = np.full(n, -1)
    table = np.full(lines, -1)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    for b in range(int(block[-1]) + 1):
        own = np.flatnonzero(block == b)
        several = pieces[own][pieces[own] > 1]
        if len(several) < 2:
            continue
        times = np.bincount(several)
        usual = own[pieces[own] == np.flatnonzero(times == times.max())[-1]]
        held = _among(lines, usual)[p_line]
        _, low, high = spans(np.zeros(held.sum(), np.int64), p_low[held], p_high[held], 0.0)
        mine = np.flatnonzero(block[p_line] == b)
        begin, end = np.searchsorted(high, p_low[mine], side="right"), np.searchsorted(low, p_high[mine]) - 1
        after, before = np.minimum(begin, len(low) - 1), np.maximum(begin - 1, 0)
        nearer = (end < begin) & ((begin == len(low)) | (p_low[mine] - high[before] < low[after] - p_high[mine]) & (begin > 0))
        column[mine] = np.where(nearer, before, after)
        fits = end <= begin
        bad = _among(lines, p_line[mine[~fits]])[own]
        part, kept = np.cumsum(bad)[~bad], own[~bad]
        counts = np.bincount(part, pieces[kept] > 1) >= 2
        table[kept] = np.where(counts[part], len(edges) + np.cumsum(counts)[part] - 1, -1)
        edges += [(low, high)] * int(counts.sum())
    out = []
    for number, (low, high) in enumerate(edges):
        own = np.flatnonzero(table == number)
        mine = np.flatnonzero(table[p_line] == number)
        columns = len(low)
        cell = np.full(n, -1)
        cell[mine] = np.searchsorted(own, p_line[mine]) * columns + column[mine]
        overlap = np.minimum(p_high[mine], high[column[mine]]) - np.maximum(p_low[mine], low[column[mine]])
        accuracy = 100 * float(np.mean(np.clip(overlap, 0, None) / np.maximum(p_high[mine] - p_low[mine], 1e-9)))
        text = words.joined(cell[piece])
        inside = box[table[line] == number]
        out.append(Grid("stream", accuracy, (*inside[:, :2].min(axis=0), *inside[:, 2:].max(axis=0)), [[text.get(r * columns + c, "") for c in range(columns)] for r in range(len(own))]))
    return out


def _page_grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both kinds of grids of the pages of each batch, from their words and rules."""
    kinds = [pa.int64(), pa.string(), *[pa.float64()] * 5]
    for batch in batches:
        words, w = _rows(batch.column(1))
        rules, r = _rows(batch.column(2))
        box, lines = _corners(words), _corners(rules)
        text = words.field("text").to_numpy(zero_copy_only=False)
        pages, grids = [], []
        for i, page in enumerate(batch.column(0).to_pylist()):
            held = Words.of(box[w[i] : w[i + 1]], text[w[i] : w[i + 1]])
            found = [g for g in lattice(held, lines[r[i] : r[i + 1]]) + stream(held) if len(g.cells) >= 2 and len(g.cells[0]) >= 2]
            pages += [page] * len(found)
            grids += found
        columns = [pages, [g.flavor for g in grids], [g.accuracy for g in grids], *([g.box[i] for g in grids] for i in range(4))]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), _lists([g.cells for g in grids], 2)], names=["page", "flavor", "accuracy", *CORNERS, "cells"])


def _rows(lists: pa.ListArray) -> tuple[pa.StructArray, list[int]]:
    """All structs of a column of arrays, and where each row's begin and end."""
    first = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    return lists.flatten(), first.tolist()


def _corners(boxes: pa.StructArray) -> np.ndarray:
    return np.column_stack([boxes.field(c).to_numpy(zero_copy_only=False) for c in CORNERS]).astype(float).reshape(-1, 4)


def _lists(values: list[list], depth: int = 1) -> pa.ListArray:
    """Lists of strings (of lists of them) as an array, made from all strings at once."""
    inner = list(chain(*values))
    ends = pa.array(np.append(0, np.cumsum([len(x) for x in values], dtype=np.int64)), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(inner, pa.string()) if depth == 1 else _lists(inner, depth - 1))


def grids_of(pages: DataFrame) -> DataFrame:
    """Every grid of two rows and columns or more of ``pages(page, words, rules)``: a row is a page, whole.

    words: array of structs x0, y0, x1, y1, text; rules: of x0, y0, x1, y1; without
    nulls inside (a null array is an empty one). page, flavor, accuracy (share of the words that lies in its cells, in
    percent), box and cells. Pages without words have empty cells, pages without rules only stream grids.
    """
    small_batches(pages.sparkSession)
    box = ", ".join(f"{c}:double" for c in CORNERS)
    rows = pages.where("page is not null").select(F.col("page").cast("long"), F.col("words").cast(f"array<struct<{box}, text:string>>"), F.col("rules").cast(f"array<struct<{box}>>"))
    return rows.mapInArrow(_page_grids, GRID)


def grids(words: DataFrame, rules: DataFrame) -> DataFrame:
    """``grids_of`` the pages that ``words(page, x0, y0, x1, y1, text)`` and ``rules(page, x0, y0, x1, y1)`` make up.

    Rows with a null page, corner or text take no part.
    """
    clean = lambda t, *more: t.select(*(F.col(c).cast("double" if c != "page" else "long").alias(c) for c in ("page", *CORNERS)), *more).dropna()
    own = clean(words, "text").select("page", F.struct(*CORNERS, "text").alias("word"), F.lit(None).alias("rule"))
    lines = clean(rules).select("page", F.lit(None).alias("word"), F.struct(*CORNERS).alias("rule"))
    return grids_of(own.unionByName(lines).groupBy("page").agg(F.collect_list("word").alias("words"), F.collect_list("rule").alias("rules")))


#: White space of ASCII, and a cell that ends in a short lower-case tail (as ``structure.has_word_splits`` sees it).
SPACE = " \t\n\x0b\f\r"
MARKS = r"[.,;:!?'\"()\[\]]*"
TAIL = re.compile(rf"(?:.*[{SPACE}])?{MARKS}[a-z]{{1,4}}{MARKS}[\x85\u2028\u2029]?\Z", re.S)


def as_table(cells: list[list[str | None]]) -> tuple[list[str | None], list[list[str]]]:
    """Headers (the first row) and rows (the others, one a line, short cells padded, without blank ones)."""
    headers = [c if c is None else c.replace("\n", " ").strip(SPACE) for c in cells[0]]
    rows = []
    for row in cells[1:]:
        lines = [(c or "").split("\n") for c in row]
        for i in range(max(map(len, lines), default=0)):
            one = [x[i].strip(SPACE) if i < len(x) else "" for x in lines]
            if any(one):
                rows.append(one)
    return headers, rows


def _looks_real(headers: list[str | None], rows: list[list[str]]) -> bool:
    """``tables.looks_real`` of what ``as_table`` returns: a verdict on columns takes a pattern for every cell and step."""
    named = [h for h in headers if h]
    words = re.findall("[a-z']+", " ".join(named).lower())
    if len(words) >= 4 and sum(w in T.FUNCTION_WORDS for w in words) >= 2:
        return False
    if sum(len(h) <= 50 and not "0" <= h[0] <= "9" for h in named) < 2 and sum(map(bool, chain(*rows))) < 2 * len(rows):
        return False
    if len(rows) < 3:
        return True
    cut = 0
    for row in rows:
        held = [c for c in row if c]
        cut += any("a" <= y[0] <= "z" and TAIL.match(x) for x, y in pairwise(held))
        if cut == 2:
            return False
    return True


def _judge(min_accuracy: float):
    """Tables of grids, with the order in which they count: sure ruled ones 0, sure others 1, ruled ones with enough cells 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, at = batch.column(5), []
            rows, r = _rows(cells)
            flat, c = _rows(rows)
            text = flat.to_numpy(zero_copy_only=False)
            own = [text[i:j].tolist() for i, j in pairwise(c)]
            order, headers, held = [], [], []
            for i, (flavor, accuracy) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if r[i] == r[i + 1]:
                    continue
                names, lines = as_table(own[r[i] : r[i + 1]])
                if not lines:
                    continue
                if accuracy is not None and accuracy >= min_accuracy and _looks_real(names, lines):
                    order.append(int(flavor != "lattice"))
                elif flavor == "lattice" and len(lines[0]) >= 2 and sum(map(bool, chain(names, *lines))) >= 3:
                    order.append(2)
                else:
                    continue
                at.append(i)
                headers.append(names)
                held.append(lines)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(5)), pa.array(order, pa.int32()), _lists(headers), _lists(held, 2)], ["page", "flavor", "accuracy", "x0", "y0", "_order", "headers", "rows"])

    return run


def accepted(found: DataFrame, min_accuracy: float = MIN_ACCURACY) -> DataFrame:
    """The tables that count for each page: ruled ones, else those of gaps, else ruled ones of any accuracy that hold enough cells.

    page, place (from 1, by position), flavor, accuracy (to a tenth), headers, rows and row_count.
    """
    small_batches(found.sparkSession)
    rows = found.select("page", "flavor", F.bround("accuracy", 1).alias("accuracy"), "x0", "y0", "cells")
    judged = rows.mapInArrow(_judge(min_accuracy), "page long, flavor string, accuracy double, x0 double, y0 double, _order int, headers array<string>, rows array<array<string>>")
    ranked = judged.withColumn("_first", F.min("_order").over(W.partitionBy("page"))).where("_order = _first")
    flavor = F.when(F.col("_order") == 2, F.lit("plain")).otherwise(F.col("flavor")).alias("flavor")
    place = F.row_number().over(W.partitionBy("page").orderBy("y0", "x0")).alias("place")
    return ranked.select("page", place, flavor, "accuracy", "headers", "rows", F.size("rows").alias("row_count"))
