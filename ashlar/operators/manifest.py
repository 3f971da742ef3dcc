"""The manifest of a document's pictures: placed rasters and drawn figures, with titles, without decorations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import image_title
from .ingest import nearest_captions
from .layout import CORNERS, covered

# Least pixels and points of a side, pixels of a point in a rendered figure, the share of a figure that a raster may cover.
LEAST_PIXELS = 24
LEAST_POINTS = 24.0
RENDERED = 2.0
MOST_COVERED = 0.7
# A decoration recurs on more pages than these and is shorter than these points everywhere; pixels of a point of a raster without a place.
RECURRING_PAGES = 3
DECORATION_SIDE = 80.0
PIXELS_A_POINT = 1.33

PICTURE = ["source", "page", "kind", "pos", "width", "height", "ext", "hash", *CORNERS]


def placed(rasters: DataFrame) -> DataFrame:
    """One row for each raster of a page, at its largest placement (ties: the first; a place before none), large enough in pixels and points."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    known = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    seen = rasters.where((F.col("width") >= LEAST_PIXELS) & (F.col("height") >= LEAST_PIXELS)).withColumns({c: F.when(known, F.col(c)) for c in CORNERS})
    best = F.max_by(F.struct("width", "height", "ext", "hash", *CORNERS), F.struct(area.alias("area"), (-F.col("pos")).alias("pos")))
    one = seen.groupBy("source", "page", "xref").agg(F.min("pos").alias("pos"), best.alias("r")).select("source", "page", F.lit("embedded").alias("kind"), "pos", "r.*")
    least = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return one.where(F.coalesce(least >= LEAST_POINTS, F.lit(True))).select(PICTURE)


def rendered(regions: DataFrame, rasters: DataFrame) -> DataFrame:
    """The figures of ``regions`` that no raster covers, from top to bottom, at the size they are rendered in."""
    key = F.struct("source", "page").alias("page")
    named = regions.withColumn("box_id", F.struct("source", "page", *CORNERS, "hash")).distinct()
    free = covered(named.select("box_id", key, *CORNERS, "hash"), rasters.select(key, *CORNERS).dropna(), F.max).where(F.col("share") <= MOST_COVERED)
    pixels = [F.round((F.col(b) - F.col(a)) * RENDERED).cast("long").alias(name) for a, b, name in (("x0", "x1", "width"), ("y0", "y1", "height"))]
    drawn = free.select("page.*", *pixels, "hash", *CORNERS).where((F.col("width") >= LEAST_PIXELS) & (F.col("height") >= LEAST_PIXELS))
    pos = F.row_number().over(W.partitionBy("source", "page").orderBy("y0", "x0", "y1", "x1", "hash")).cast("long")
    return drawn.select("*", F.lit("rendered").alias("kind"), pos.alias("pos"), F.lit("png").alias("ext")).select(PICTURE)


def decorations(pictures: DataFrame) -> DataFrame:
    """source and hash of small pictures that recur on many pages of a document."""
    side = F.coalesce(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.greatest("width", "height") / PIXELS_A_POINT)
    by_page = pictures.where("hash is not null").groupBy("source", "hash", "page").agg(F.max(side).alias("side"))
    return by_page.groupBy("source", "hash").agg(F.count("*").alias("pages"), F.max("side").alias("side")).where((F.col("pages") > RECURRING_PAGES) & (F.col("side") < DECORATION_SIDE)).select("source", "hash")


def manifest(rasters: DataFrame, regions: DataFrame, texts: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """source, page, number, file, title, kind, width, height, hash and box of every picture.

    ``rasters(source, page, xref, pos, width, height, ext, hash, x0, y0, x1, y1)`` are the
    placements of a page's rasters in order (a null corner: none is known), ``regions(source,
    page, x0, y0, x1, y1, hash)`` its drawn figures, ``texts(source, page, id, x0, y0, x1, y1,
    text)`` its lines. Rasters are numbered before figures, and before decorations go, so that
    numbers of a page may have gaps, as its files have. A title is the nearest caption, else
    what ``read(hash, title)`` says was read in the picture, else empty. Rows without
    source or page take no part; a picture without a hash is no decoration. All joins
    but that of ``read`` are by page, decorations by document and hash, counted by page first.
    """
    own = [x.dropna(subset=["source", "page"]) for x in (rasters, regions, texts)]
    embedded = placed(own[0])
    every = embedded.unionByName(rendered(own[1].dropna(subset=CORNERS), embedded))
    number = F.row_number().over(W.partitionBy("source", "page").orderBy("kind", "pos", "hash")).cast("long")
    numbered = every.withColumn("number", number)
    kept = numbered.join(decorations(numbered), ["source", "hash"], "left_anti")
    key = F.struct("source", "page").alias("page")
    lines = own[2].dropna(subset=CORNERS)
    near = nearest_captions(kept.select(F.struct("source", "page", "number").alias("id"), key, *CORNERS).dropna(), lines.select(F.struct("source", "page", "id").alias("id"), key, *CORNERS))
    said = near.join(lines.select(F.struct("source", "page", "id").alias("text_id"), "text"), "text_id").select("id.*", image_title(F.col("text")).alias("caption"))
    titled = kept.join(said, ["source", "page", "number"], "left").withColumn("title", F.col("caption"))
    if read is not None:
        titled = titled.join(read.groupBy("hash").agg(F.min("title").alias("_read")), "hash", "left").withColumn("title", F.when(F.coalesce("title", F.lit("")) == "", image_title(F.col("_read"))).otherwise(F.col("title")))
    file = F.concat(F.lit("page_"), "page", F.lit("_img_"), "number", F.lit("."), F.coalesce("ext", F.lit("png")))
    return titled.select("source", "page", "number", file.alias("file"), F.coalesce("title", F.lit("")).alias("title"), "kind", "width", "height", "hash", *CORNERS)


def envelopes(pictures: DataFrame) -> DataFrame:
    """source, page and the pictures of every page that has any, in order; an array is bounded by what a page holds."""
    one = F.struct("number", "title", "file", F.concat(F.lit("images/"), "file").alias("path"), *CORNERS)
    return pictures.groupBy("source", "page").agg(F.array_sort(F.collect_list(one)).alias("images"))


def summary(pictures: DataFrame) -> DataFrame:
    """Counts of pictures of every document, by page first: in all, pages, with titles, a page, of each kind."""
    by_page = pictures.groupBy("source", "page").agg(F.count("*").alias("n"), F.count_if(F.col("title") != "").alias("t"), F.count_if(F.col("kind") == "embedded").alias("e"))
    whole = by_page.groupBy("source").agg(F.sum("n").alias("total"), F.count("*").alias("pages"), F.sum("t").alias("titled"), F.sum("e").alias("embedded"))
    return whole.select("source", "total", "pages", "titled", F.bround(F.col("total") / F.col("pages"), 2).alias("per_page"), "embedded", (F.col("total") - F.col("embedded")).alias("rendered"))
