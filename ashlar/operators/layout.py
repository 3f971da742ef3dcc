"""Page geometry: reading order of blocks and merging of boxes; groups are single pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def reading_order(blocks: DataFrame) -> DataFrame:
    """Place of every block of ``blocks(id, page, x0, y0, x1, y1, width)`` in its page.

    A page has two columns if four blocks or more are at most 0.55 of its width,
    two of them or more on each side. Blocks wider than 0.7 of it divide the flow
    into bands; inside a band the left column comes first. Else blocks go by top
    (to a tenth) and left edge.
    """
    page = W.partitionBy("page")
    wide = F.col("x1") - F.col("x0")
    middle = (F.col("x0") + F.col("x1")) / 2
    narrow = wide <= 0.55 * F.col("width")
    left, right = F.count_if(narrow & (middle < F.col("width") / 2)).over(page), F.count_if(narrow & (middle >= F.col("width") / 2)).over(page)
    two = (F.count_if(narrow).over(page) >= 4) & (left >= 2) & (right >= 2)
    banner = wide > 0.70 * F.col("width")
    rows = blocks.select("*", two.alias("_two"), banner.alias("_banner"), (middle >= F.col("width") / 2).cast("int").alias("_side"))
    passed = F.count_if("_banner").over(page.orderBy("y0", "x0", "id").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_band", 2 * F.coalesce(passed, F.lit(0)) + F.when(F.col("_banner"), 1).otherwise(0))
    key = [F.when(F.col("_two"), F.col("_band")).otherwise(0), F.when(F.col("_two") & ~F.col("_banner"), F.col("_side")).otherwise(0), F.round("y0", 1), "x0", "id"]
    return rows.select("page", "id", F.col("_two").alias("two_columns"), F.row_number().over(page.orderBy(*key)).alias("place"))


# What makes a cluster of drawings a figure (lengths in points, areas as shares of the page's or the cluster's).
LEAST_SIDE, LEAST_FIGURE_SIDE = 3, 28
LEAST_AREA, MOST_AREA = 0.02, 0.88
MOST_ASPECT = 12
LEAST_DRAWINGS = 5
MOST_TEXT, TABLE_TEXT, MOST_TABLE = 0.55, 0.20, 0.60
PAD = 10.0
#: Boxes of a bin on average, and bins along each side of a page at most.
BIN_BOXES, BINS = 256, 32
#: Rows of bins that go to one task together, on average.
DEAL_ROWS = 16_384
#: A batch is passed again if fewer than its rows by this factor are left.
COLLAPSE = 1.25
#: Page numbers that are broadcast at most; more meet their boxes in a shuffle.
BROADCAST_PAGES = 1 << 18
CORNERS = ("x0", "y0", "x1", "y1")


def merged_boxes(box: np.ndarray, pad: float) -> np.ndarray:
    """The number of each box's cluster, when boxes less than ``pad`` apart join and what they span joins likewise, until nothing does."""
    span, alive = np.empty_like(box), np.zeros(len(box), bool)
    parent = np.arange(len(box))
    used = 0
    for i in range(len(box)):
        now = box[i].copy()
        mine = used
        used += 1
        while True:
            held = span[:mine]
            touch = alive[:mine] & (held[:, 0] - pad < now[2]) & (held[:, 2] + pad > now[0]) & (held[:, 1] - pad < now[3]) & (held[:, 3] + pad > now[1])
            which = np.flatnonzero(touch)
            if not len(which):
                break
            now[:2] = np.minimum(now[:2], held[which, :2].min(axis=0))
            now[2:] = np.maximum(now[2:], held[which, 2:].max(axis=0))
            alive[which] = False
            parent[which] = mine
        span[mine], alive[mine] = now, True
    for i in range(len(box) - 1, -1, -1):  # a cluster is swallowed by a later one
        parent[i] = parent[parent[i]]
    return parent


def _neighbours_joined(page: np.ndarray, box: np.ndarray, boxes: np.ndarray, largest: np.ndarray, pad: float) -> tuple[np.ndarray, ...]:
    """The rows with every stretch of rows of a page joined whose neighbours are less than ``pad`` apart."""
    apart = (page[1:] != page[:-1]) | (box[:-1, :2] - pad >= box[1:, 2:]).any(axis=1) | (box[:-1, 2:] + pad <= box[1:, :2]).any(axis=1)
    first = np.flatnonzero(np.append(True, apart))
    span = np.column_stack([np.minimum.reduceat(box[:, :2], first), np.maximum.reduceat(box[:, 2:], first)])
    return page[first], span, np.add.reduceat(boxes, first), np.maximum.reduceat(largest, first)


def _collapse_batches(pad: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            box = np.column_stack([batch.column(i).to_numpy() for i in range(1, 5)])
            rows = (batch.column(0).to_numpy(), box, np.ones(len(box), np.int64), (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]))
            rows = _neighbours_joined(*rows, pad)  # as they come, then by lines, then by columns
            while True:
                before = len(rows[0])
                for order in ((0, 1), (1, 0)):
                    at = np.lexsort((rows[1][:, order[0]], rows[1][:, order[1]], rows[0]))
                    rows = _neighbours_joined(*(x[at] for x in rows), pad)
                if COLLAPSE * len(rows[0]) > before:
                    break
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), *(pa.array(np.ascontiguousarray(c)) for c in rows[1].T), pa.array(rows[2]), pa.array(rows[3])], ["page", *CORNERS, "boxes", "largest"])

    return run


def collapsed(boxes: DataFrame, pad: float = PAD) -> DataFrame:
    """page, box, number and largest area of the boxes that join with others of their Arrow batch.

    Boxes that are joined here are of one cluster, whatever else its page holds, so that
    clusters of the result are those of ``boxes``. Nothing is shuffled: what comes in
    the order of a page leaves its task as a few rows. Rows with a null take no part.
    """
    own = boxes.select(F.col("page").cast("long").alias("page"), *(F.col(c).cast("double").alias(c) for c in CORNERS)).dropna()
    return own.mapInArrow(_collapse_batches(pad), "page long, x0 double, y0 double, x1 double, y1 double, boxes long, largest double")


def _bin_links(pad: float):
    """Links to the least id of each cluster of a bin; rows of many bins come together."""

    def run(rows: pa.Table) -> pa.Table:
        place = [rows[c].to_numpy() for c in ("by", "bx", "page")]
        order = np.lexsort(place)
        box = np.column_stack([rows[c].to_numpy() for c in CORNERS])[order]
        ids = rows["id"].to_numpy()[order]
        edge = np.flatnonzero(np.append(True, np.any([x[order][1:] != x[order][:-1] for x in place], axis=0)))
        ends = np.append(edge[1:], len(ids))
        cluster = np.arange(len(ids))
        for lo, hi in zip(edge[ends - edge > 1], ends[ends - edge > 1]):
            cluster[lo:hi] = lo + merged_boxes(box[lo:hi], pad)
        led = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(led, cluster, ids)
        root = led[cluster]
        joined = root != ids
        return pa.table({"page": pa.array(rows["page"].to_numpy()[order][joined]), "id": pa.array(ids[joined]), "root": pa.array(root[joined])})

    return run


def clusters(boxes: DataFrame, pad: float = PAD) -> DataFrame:
    """page, box and number of boxes of every cluster of ``boxes(page, x0, y0, x1, y1)``, joined while less than ``pad`` apart.

    What a batch of rows can join is joined before anything is shuffled. The rest meets
    in the bins of its page that it reaches; a bin's boxes are joined in
    one task, and clusters of several bins by the smallest number they share. What
    is joined spans more and may reach others, so rounds go on, each over a written
    table of fewer boxes, until no bin joins any. A page of few boxes is one bin.
    Rows with a null take no part.
    """
    return _merged(collapsed(boxes, pad), pad)


def _merged(some: DataFrame, pad: float) -> DataFrame:
    """The clusters of ``collapsed`` boxes."""
    held = cut(some.select("page", F.monotonically_increasing_id().alias("id"), *CORNERS, "boxes"))
    while True:
        deals = max(1, -(-held.count() // DEAL_ROWS))
        extent = held.groupBy("page").agg(F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("x1").alias("right"), F.max("y1").alias("bottom"), F.count("*").alias("n"))
        extent = extent.where("n > 1").withColumn("bins", F.least(F.lit(BINS), F.ceil(F.sqrt(F.col("n") / BIN_BOXES))).cast("int"))
        placed = held.join(extent, "page")

        def reach(low: str, high: str, begin: str, end: str) -> Column:
            side = F.greatest((F.col(end) - F.col(begin)) / F.col("bins"), F.lit(1e-9))
            at = lambda v: F.least(F.greatest(F.floor((v - F.col(begin)) / side), F.lit(0)), F.col("bins") - 1).cast("int")
            return F.sequence(at(F.col(low) - pad), at(F.col(high) + pad))

        binned = placed.select("page", "id", *CORNERS, F.explode(reach("x0", "x1", "left", "right")).alias("bx"), reach("y0", "y1", "top", "bottom").alias("ys")).select("page", "id", *CORNERS, "bx", F.explode("ys").alias("by"))
        dealt = binned.withColumn("deal", F.pmod(F.xxhash64("page", "bx", "by"), F.lit(deals)))  # many small bins a group
        links = dealt.groupBy("deal").applyInArrow(_bin_links(pad), "page long, id long, root long").groupBy("page", "id").agg(F.min("root").alias("root"))
        links = cut(links)
        if links.isEmpty():
            return held.select("page", *CORNERS, "boxes")
        further = links.select("page", F.col("id").alias("root"), F.col("root").alias("beyond"))
        led = links.join(further, ["page", "root"], "left").select("page", "id", F.coalesce("beyond", "root").alias("root"))
        grown = held.join(led, ["page", "id"], "left").groupBy("page", F.coalesce("root", "id").alias("id"))
        held = cut(grown.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("boxes").alias("boxes")).select("page", "id", *CORNERS, "boxes"))


def _area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x1") - F.col(f"{prefix}x0")) * (F.col(f"{prefix}y1") - F.col(f"{prefix}y0"))


def shared_areas(boxes: DataFrame, others: DataFrame) -> DataFrame:
    """box_id and the area it shares with each box of ``others`` that it meets on its page."""
    named = others.select("page", *(F.col(c).alias(f"o_{c}") for c in CORNERS))
    side = lambda low, high: F.greatest(F.least(F.col(high), F.col(f"o_{high}")) - F.greatest(F.col(low), F.col(f"o_{low}")), F.lit(0.0))
    return boxes.join(named, "page").select("box_id", (side("x0", "x1") * side("y0", "y1")).alias("shared")).where("shared > 0")


def covered(boxes: DataFrame, others: DataFrame, how: Callable[[Column], Column]) -> DataFrame:
    """``boxes`` with ``share``: the sum (or another summary) of the areas shared with ``others``, of its own area."""
    shares = shared_areas(boxes, others).groupBy("box_id").agg(how(F.col("shared")).alias("shared"))
    return boxes.join(shares, "box_id", "left").withColumn("share", F.coalesce(F.try_divide("shared", _area()), F.lit(0.0))).drop("shared")


def drawing_regions(drawings: DataFrame, pages: DataFrame, texts: DataFrame, tables: DataFrame | None = None, pad: float = PAD) -> DataFrame:
    """page, box and number of drawings of the clusters that look like figures.

    ``drawings(page, x0, y0, x1, y1[, invisible])``, ``pages(page, width, height)``;
    ``texts`` and ``tables`` are boxes by page. Invisible, tiny and page-sized drawings
    take no part. A cluster is no figure if it is small, narrow, a ruling, of few
    drawings, mostly text, or mostly within a table; a table is a box of ``tables``
    that texts cover by more than a fifth.
    """
    size = pages.select("page", F.greatest(F.col("width") * F.col("height"), F.lit(1.0)).alias("_page"))
    seen = drawings.where(~F.coalesce(F.col("invisible"), F.lit(False))) if "invisible" in drawings.columns else drawings
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    drawn = seen.where((wide >= LEAST_SIDE) & (high >= LEAST_SIDE))
    # only pages that hold a page-sized drawing are joined with their size drawing by drawing
    parts = cut(collapsed(drawn, pad))
    full = cut(parts.groupBy("page").agg(F.max("largest").alias("largest")).join(size, "page").where(F.col("largest") > MOST_AREA * F.col("_page")).select("page", "_page"))
    pages_full = full.count()
    if pages_full:
        few = F.broadcast(full) if pages_full <= BROADCAST_PAGES else full
        parts = parts.join(few, "page", "left_anti").unionByName(collapsed(drawn.join(few, "page").where(_area() <= MOST_AREA * F.col("_page")), pad))
    found = _merged(parts, pad).join(size, "page")
    shape = (_area() >= LEAST_AREA * F.col("_page")) & (F.least(wide, high) >= LEAST_FIGURE_SIDE) & (F.greatest(wide, high) <= MOST_ASPECT * F.least(wide, high)) & (F.col("boxes") >= LEAST_DRAWINGS)
    figures = cut(found.where(shape).select(F.monotonically_increasing_id().alias("box_id"), "page", *CORNERS, "boxes"))
    kept = covered(figures, texts, F.sum).where(F.col("share") <= MOST_TEXT).drop("share")
    if tables is not None:
        boxed = cut(tables.select(F.monotonically_increasing_id().alias("box_id"), "page", *CORNERS))
        real = covered(boxed, texts, F.sum).where(F.col("share") > TABLE_TEXT)
        kept = covered(kept, real, F.max).where(F.col("share") <= MOST_TABLE).drop("share")
    return kept.select("page", *CORNERS, "boxes")
