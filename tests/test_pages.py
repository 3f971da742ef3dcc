"""Tables, rotation and drawings of pages against planted ones and plain forms."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.operators import layout, raster
from ashlar.operators import pagetables as P
from ashlar.operators import structure as S
from ashlar.operators import tables as B
from ashlar.queries import pages

DATA = Path("/root/testdata/sf0.001")


def words_of(cells, x, y, columns, row_height=20, letter=5):
    """Words of a grid of texts (lines by breaks, words by spaces) from its column edges."""
    box, text = [], []
    for r, row in enumerate(cells):
        for c, cell in enumerate(row):
            for i, line in enumerate(cell.split("\n")):
                at = x + columns[c] + 3
                for w in line.split():
                    box.append((at, y + r * row_height + 2 + 9 * i, at + letter * len(w), y + r * row_height + 9 + 9 * i))
                    text.append(w)
                    at += letter * (len(w) + 1)
    return box, text


def ruled(x, y, columns, rows, row_height=20, without=()):
    """Cell by cell; ``without``: ('v', row, column) or ('h', row, column), the line left of or above a cell."""
    out = []
    for r in range(rows):
        for c in range(len(columns)):
            if ("v", r, c) not in without:
                out.append((x + columns[c], y + r * row_height, x + columns[c], y + (r + 1) * row_height))
    for r in range(rows + 1):
        for c in range(len(columns) - 1):
            if ("h", r, c) not in without:
                out.append((x + columns[c], y + r * row_height + 0.4, x + columns[c + 1], y + r * row_height))
    return out


def found(kind, box, text, lines=()):
    words = P.Words.of(np.array(box, float).reshape(-1, 4), text)
    return P.lattice(words, np.array(lines, float).reshape(-1, 4)) if kind == "lattice" else P.stream(words)


CELLS = [["Part", "Torque", "Note here"], ["A12", "25 Nm", ""], ["B7\nB8", "30 Nm\n31 Nm", "dry"], ["C1", "", "oiled well"]]


def test_ruled_grids_come_back():
    columns = [0, 60, 130, 220]
    box, text = words_of(CELLS, 50, 100, columns)
    order = random.Random(1).sample(range(len(text)), len(text))
    got = found("lattice", [box[i] for i in order], [text[i] for i in order], ruled(50, 100, columns, 4))
    assert [g.cells for g in got] == [CELLS] and got[0].accuracy == pytest.approx(100) and got[0].box[0] == 50
    long = [(50, 100 + 20 * r, 270, 100 + 20 * r) for r in range(5)] + [(50 + c, 180, 50 + c, 100) for c in columns]  # whole lines, drawn upwards
    assert found("lattice", box, text, long)[0].cells == CELLS


def test_merged_cells_hold_their_text_once():
    columns = [0, 60, 130, 220]
    cells = [["Head", "", ""], ["a", "b", "c"], ["", "d", "e"], ["f", "g", ""]]
    gone = [("v", 0, 1), ("v", 0, 2), ("h", 2, 0), ("v", 3, 2)]
    box, text = words_of(cells, 0, 0, columns)
    got = found("lattice", box, text, ruled(0, 0, columns, 4, without=gone))
    assert [g.cells for g in got] == [cells]
    # a word in the merged part counts for the cell's beginning
    box, text = words_of([["", "", "Far"], ["a", "b", "c"], ["under", "d", "e"], ["f", "g", "h"]], 0, 0, columns)
    got = found("lattice", box, text, ruled(0, 0, columns, 4, without=gone))
    assert got[0].cells == [["Far", "", ""], ["a\nunder", "b", "c"], ["", "d", "e"], ["f", "g h", ""]]


def test_tables_of_a_page_are_apart_and_lone_lines_none():
    columns = [0, 60, 130]
    first, second = [["a", "b"], ["c", "d"]], [["e", "f"], ["g", "h"], ["i", "j"]]
    box, text = words_of(first, 0, 0, columns)
    more = words_of(second, 10, 300, columns)
    lines = ruled(0, 0, columns, 2) + ruled(10, 300, columns, 3) + [(0, 200, 400, 200), (300, 210, 300, 260)]
    assert [g.cells for g in found("lattice", box + more[0], text + more[1], lines)] == [first, second]
    assert not found("lattice", box, text) and not found("lattice", box, text, [(0, 200, 400, 200)])
    assert found("lattice", [], [], lines)[0].cells == [["", ""], ["", ""]]


def test_columns_of_white_space_come_back():
    columns = [0, 80, 160, 240]
    cells = [["Part", "Torque", "Note"], ["A12 x", "25 Nm", "a b"], ["B7", "", "dry"], ["C1", "30", "oil"]]
    box, text = words_of(cells, 0, 40, columns)
    got = found("stream", box, text)
    assert [g.cells for g in got] == [cells] and got[0].accuracy == pytest.approx(100)
    # prose above and below is no part of it, and alone it is none
    prose = words_of([["these words run over the whole width of the page as prose does"]] * 2, 0, 0, [0, 400])
    under = words_of([["and these too run over the whole width of the page as prose"]], 0, 120, [0, 400])
    assert [g.cells for g in found("stream", box + prose[0] + under[0], text + prose[1] + under[1])] == [cells]
    assert not found("stream", *prose) and not found("stream", [], []) and not found("stream", [(0, 0, 5, 5)], ["x"])
    # a wide step divides two tables
    other = words_of([["u", "v"], ["w", "x"]], 0, 300, [0, 100, 200])
    assert len(found("stream", box + other[0], text + other[1])) == 2


def plain_spans(line, low, high, tolerance):
    out = []
    for k in sorted(set(line)):
        for a, b in sorted((a, b) for x, a, b in zip(line, low, high) if x == k):
            if out and out[-1][0] == k and a <= out[-1][2] + tolerance:
                out[-1][2] = max(out[-1][2], b)
            else:
                out.append([k, a, b])
    return [tuple(x) for x in out]


def test_spans_of_pieces_match_a_plain_form():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randrange(0, 40)
        line = [rng.randrange(4) for _ in range(n)]
        low = [rng.uniform(-50, 50) for _ in range(n)]
        high = [a + rng.uniform(0, 12) for a in low]
        got = P.spans(np.array(line, int), np.array(low, float), np.array(high, float), 1.0)
        assert np.allclose(np.array(plain_spans(line, low, high, 1.0), float).reshape(-1, 3), np.column_stack(got))


def test_what_counts_for_a_page(spark):
    columns = [0, 60, 130, 220]

    def rows(page, cells, height=20):
        box, text = words_of(cells, 50, 100, columns, height)
        return [(page, *map(float, b), t) for b, t in zip(box, text)]

    words = rows(1, CELLS) + rows(2, [r for r in CELLS if "\n" not in r[0]]) + rows(3, [["one word"]]) + [(None, 0.0, 0.0, 1.0, 1.0, "x"), (4, 0.0, None, 1.0, 1.0, "y")]
    words += [(5, b[1] + 30, *b[2:]) for b in rows(5, CELLS)]  # beside its cells
    lines = [(page, *map(float, r)) for page in (1, 5, 6) for r in ruled(50, 100, columns, 4)]
    grids = P.grids(spark.createDataFrame(words, "page long, x0 double, y0 double, x1 double, y1 double, text string"), spark.createDataFrame(lines, "page long, x0 double, y0 double, x1 double, y1 double"))
    got = {r.page: r for r in P.accepted(grids).collect()}
    assert {p: r.flavor for p, r in got.items()} == {1: "lattice", 2: "stream", 5: got[5].flavor}
    assert got[1].headers == CELLS[0] and got[1].rows == [["A12", "25 Nm", ""], ["B7", "30 Nm", "dry"], ["B8", "31 Nm", ""], ["C1", "", "oiled well"]] and got[1].row_count == 4
    assert got[2].rows == [["A12", "25 Nm", ""], ["C1", "", "oiled well"]]
    strict = {r.page: r.flavor for r in P.accepted(grids, min_accuracy=100.5).collect()}
    assert strict[1] == "plain" and 2 not in strict
    none = spark.createDataFrame([], "page long, x0 double, y0 double, x1 double, y1 double, text string")
    assert P.grids(none, none.drop("text")).count() == 0


def test_rotation_of_planted_pages():
    rng = np.random.default_rng(1)
    page = np.full((400, 300), 255, np.uint8)
    for top in range(20, 380, 16):
        for left in range(20, int(rng.integers(180, 280)), 6):
            page[top + 4 : top + 8, left : left + 4] = 0
            kind = rng.random()
            if kind < 0.35:
                page[top : top + 4, left : left + 2] = 0
            elif kind < 0.45:
                page[top + 8 : top + 11, left : left + 2] = 0
    for quarter in range(4):
        assert raster.rotation(np.rot90(page, quarter)) == 90 * quarter  # rot90 turns against the clock
    assert raster.rotation(np.full((50, 60), 255, np.uint8)) == 0 == raster.rotation(np.zeros((0, 0), np.uint8))


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_printed_documents_are_set_upright(spark):
    turns = {r.page: (r.turn, r.n) for r in pages.printed_pages(spark, str(DATA)).selectExpr("page", "turn", "octet_length(pixels) as n").collect()}
    got = {r.page: r.rotation for r in pages.page_rotation(spark, str(DATA)).collect()}
    assert set(got) == set(turns)
    several = [p for p, (_, n) in turns.items() if n >= 4 * pages.PRINTED * 10]  # four lines or more
    right = sum(got[p] == (360 - 90 * turns[p][0]) % 360 for p in several)
    assert len(several) > 100 and right >= 0.98 * len(several) and len({got[p] for p in several}) == 4


BOXES = "page long, x0 double, y0 double, x1 double, y1 double"


def plain_clusters(boxes, pad):
    held = [[*b, 1] for b in boxes]

    def near(a, b):
        return a[0] - pad < b[2] and b[0] - pad < a[2] and a[1] - pad < b[3] and b[1] - pad < a[3]

    while pair := next(((i, j) for i in range(len(held)) for j in range(i) if near(held[i], held[j])), None):
        a, b = held.pop(pair[0]), held.pop(pair[1])
        held.append([min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]])
    return sorted(map(tuple, held))


@pytest.mark.parametrize("bin_boxes", [256, 3])
def test_clusters_are_the_fixpoint_of_merging_pairs(spark, monkeypatch, bin_boxes):
    monkeypatch.setattr(layout, "BIN_BOXES", bin_boxes)
    rng = random.Random(6)
    boxes = [(1 + i % 3, x, y, x + rng.uniform(0, 9), y + rng.uniform(0, 9)) for i in range(120) for x, y in [(rng.uniform(0, 90), rng.uniform(0, 90))]]
    boxes += [(4, float(10 * i), float(i % 2), 10.0 * i + 9, 5.0) for i in range(60)]  # a chain over all bins
    boxes += [(5, 0.0, 0.0, 100.0, 1.0), (5, 0.0, 50.0, 1.0, 51.0), (5, 0.5, 1.5, 0.6, 50.0), (6, 5.0, 5.0, 5.0, 5.0), (6, 5.0, 5.0, 5.0, 5.0), (None, 0.0, 0.0, 1.0, 1.0), (7, None, 0.0, 1.0, 1.0)]
    got = layout.clusters(spark.createDataFrame(boxes, BOXES).repartition(4), pad=1.5).collect()
    by = {}
    for r in got:
        by.setdefault(r.page, []).append((r.x0, r.y0, r.x1, r.y1, r.boxes))
    assert set(by) == {1, 2, 3, 4, 5, 6}
    for page, found in by.items():
        assert sorted(found) == plain_clusters([b[1:] for b in boxes if b[0] == page], 1.5)
    assert len(by[4]) == 1 and len(by[5]) == 1
    assert layout.clusters(spark.createDataFrame([], BOXES)).count() == 0


def test_a_page_of_a_hundred_thousand_boxes(spark):
    near = spark.range(100_000).selectExpr("1L as page", "double(id % 400 * 20) as x0", "double(id div 400 * 20) as y0").selectExpr("*", "x0 + 5 + (x0 + y0) % 3 as x1", "y0 + 5 as y1")
    began = __import__("time").perf_counter()
    assert layout.clusters(near, pad=3.0).count() == 100_000  # none joins
    rows = layout.clusters(near, pad=16.0).collect()  # all do
    assert [(r.x0, r.y0, r.boxes) for r in rows] == [(0.0, 0.0, 100_000)]
    assert __import__("time").perf_counter() - began < 120


def test_figures_are_told_from_other_clusters(spark):
    def cluster(page, x, y, n=9, side=40):
        return [(page, x + side * (i % 3), y + side * (i // 3), x + side * (i % 3) + side, y + side * (i // 3) + side, False) for i in range(n)]

    drawings = cluster(1, 50.0, 50.0)  # a figure
    drawings += cluster(2, 50.0, 50.0, n=4)  # too few drawings
    drawings += cluster(3, 50.0, 50.0, side=8)  # too small
    drawings += [(4, 50.0 + 30 * i, 50.0, 80.0 + 30 * i, 79.0, False) for i in range(14)]  # a ruling
    drawings += cluster(5, 50.0, 50.0) + cluster(6, 50.0, 50.0)  # text; table
    drawings += [(*r[:5], True) for r in cluster(7, 50.0, 50.0)] + [(8, 0.0, 0.0, 600.0, 800.0, False)] * 6 + [(9, 10.0 * i, 5.0, 10.0 * i + 9, 7.0, False) for i in range(9)]  # invisible; background; slivers
    drawings += cluster(10, 50.0, 50.0)  # a grid of pictures, hardly any text: no table
    texts = [(5, 50.0, 50.0, 170.0, 120.0), (6, 50.0, 50.0, 170.0, 85.0), (10, 50.0, 50.0, 60.0, 60.0), (1, 50.0, 50.0, 170.0, 115.9)]
    tables = [(6, 45.0, 45.0, 160.0, 175.0), (10, 45.0, 45.0, 175.0, 175.0), (1, 50.0, 50.0, 120.0, 170.0)]
    pages_ = spark.createDataFrame([(i, 600.0, 800.0) for i in range(1, 11)], "page long, width double, height double")
    boxes = lambda rows: spark.createDataFrame(rows, BOXES)
    drawn = spark.createDataFrame(drawings, BOXES + ", invisible boolean")
    got = layout.drawing_regions(drawn, pages_, boxes(texts), boxes(tables)).collect()
    assert sorted((r.page, r.boxes) for r in got) == [(1, 9), (10, 9)]
    assert sorted(r.page for r in layout.drawing_regions(drawn, pages_, boxes(texts)).collect()) == [1, 6, 10]


def test_a_ruled_page_whose_rows_are_all_merged_keeps_its_columns(spark, tmp_path):
    words = "SHOU.!! THE.!! SHOU.!! THE.!! SHOU.!! THE.!! SHOU.!! THE.!! x y"
    spark.createDataFrame([(1, words), (2, "SHOU.!! a b c d e f g")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.page: r.value for r in pages.page_grids(spark, str(tmp_path)).collect()}
    assert got == {1: "SHOU.!! THE.!!|SHOU.!! THE.!! SHOU.!! THE.!!|\nSHOU.!! THE.!!|x y|", 2: "SHOU.!! a|b c d e|\nf g||"}


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_words_are_joined_to_columns_before_they_are_shuffled(spark):
    words = pages.page_words(spark, str(DATA))
    some = layout.collapsed(words).collect()
    assert sum(r.boxes for r in some) == words.count() and 10 * len(some) < words.count()
    assert len(some) <= 1.2 * pages.drawing_clusters(spark, str(DATA)).count()


def test_pages_are_turned_clockwise(spark):
    page = np.arange(6, dtype=np.uint8).reshape(2, 3)
    rows = [(i, i, page.tobytes(), 3) for i in range(4)] + [(4, 1, b"", 3)]
    got = {r.page: (bytes(r.pixels), r.width) for r in raster.turned(spark.createDataFrame(rows, "page long, turn int, pixels binary, width int")).collect()}
    assert got == {**{i: (np.rot90(page, -i).tobytes(), 3 - i % 2) for i in range(4)}, 4: (b"", 0)}


def test_text_masks_of_several_heights_share_their_components(monkeypatch):
    dark = np.random.default_rng(2).random((120, 160)) < 0.2
    dark[10:60, 20:40] = True
    calls, components = [], raster.components
    monkeypatch.setattr(raster, "components", lambda mask: calls.append(1) or components(mask))
    both = raster.text_masks(dark, raster.TALL_FOR_VERDICTS, raster.TALL_FOR_CROPS)
    assert len(calls) == 1 and (both[0] != both[1]).any()
    for mask, tallest in zip(both, (raster.TALL_FOR_VERDICTS, raster.TALL_FOR_CROPS)):
        assert (mask == raster.text_mask(dark, tallest)).all()


def test_a_page_is_a_row_with_the_boxes_of_its_words(spark):
    laid = pages.laid_pages(spark, str(DATA))
    got = laid.selectExpr("page", "posexplode(words) as (k, w)").selectExpr("page", "k", "w.x0", "w.y0", "w.x1", "w.y1", "w.text")
    want = pages.page_words(spark, str(DATA)).select(got.columns)
    assert got.count() == want.count() > 0 and not got.exceptAll(want).count()
    # no word is a row of a shuffle, and the tables of a page are split and judged once each
    for found in (P.grids_of(laid), P.accepted(P.grids_of(laid))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "CoGroup" not in plan and "lambda" not in plan


def test_verdicts_on_tables_are_those_of_the_columns(spark):
    rng = random.Random(11)
    cells = ["", "a", "the", "is to be", "Part no", "12 x", "abc", "over,", "lap (ed)", "Tail\u2028", "x\ny", " torque\t", "Nm.\n\n", "w" * 51, "engine's oil of the", "\xa0"]
    found = []
    for i in range(600):
        columns = rng.choice((2, 3, 4))
        picked = rng.sample(cells, rng.randrange(1, 6))
        found.append((i, rng.choice(("lattice", "stream")), rng.choice((49.94, 49.96, 90.0)), 0.0, 0.0, [[rng.choice(picked) for _ in range(columns)] for _ in range(rng.randrange(2, 7))]))
    frame = spark.createDataFrame(found, "page long, flavor string, accuracy double, x0 double, y0 double, cells array<array<string>>")
    got = {r.page: (r.flavor, r.headers, r.rows) for r in P.accepted(frame).collect()}
    split = {i: P.as_table(c) for i, *_, c in found}
    tables = spark.createDataFrame([(i, h, r) for i, (h, r) in split.items() if r], "page long, headers array<string>, rows array<array<string>>")
    verdict = {r.page: r for r in tables.select("page", B.looks_real(F.col("headers"), F.col("rows")).alias("real"), S.is_real_table(F.concat(F.array("headers"), F.col("rows"))).alias("filled")).collect()}
    want = {}
    for i, flavor, accuracy, _, _, _ in found:
        if i in verdict and accuracy > 49.95 and verdict[i].real:
            want[i] = (flavor, *split[i])
        elif i in verdict and flavor == "lattice" and verdict[i].filled:
            want[i] = ("plain", *split[i])
    assert got == want and {f for f, *_ in got.values()} == {"lattice", "stream", "plain"} and len(got) < len(found)
    assert P.as_table([["a\nb", " c "], ["x\n\ny ", "1"], ["", " "]]) == (["a b", "c"], [["x", "1"], ["y", ""]])
