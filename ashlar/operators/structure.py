"""Ordered structure: running headers, folios, headings, carried sections, breadcrumbs, tables, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Pages of a running header, and pages for which a heading stays fresh.
MIN_RUN = 3
FRESH_PAGES = 30


def running_header(first_lines: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Per document, the line that heads the longest run of consecutive pages (the first of equal runs)."""
    nth = F.row_number().over(W.partitionBy("doc_id", "line").orderBy("page"))
    runs = first_lines.where("line <> ''").withColumn("island", F.col("page") - nth).groupBy("doc_id", "line", "island").agg(F.count("*").alias("n"), F.min("page").alias("start")).where(F.col("n") >= min_run)
    best = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "start"))
    return runs.withColumn("place", best).where("place = 1").select("doc_id", "line", "n", "start")


def strip_header(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines without a page's first non-blank line where that is the document's header."""
    first = F.min(F.when(T.strip(F.col("line")) != "", F.col("pos"))).over(W.partitionBy("doc_id", "page"))
    marked = lines.withColumn("_first", first).join(headers.select("doc_id", F.col("line").alias("_header")), "doc_id", "left")
    drop = (F.col("pos") == F.col("_first")) & (T.strip(F.col("line")) == F.col("_header"))
    return marked.where(~F.coalesce(drop, F.lit(False))).drop("_first", "_header")


def folio_strip(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines between the first and the last that is no folio; a blank line stops the search, so a folio under it stays."""
    inner = F.when(~T.is_folio(F.col("line")) | (T.strip(F.col("line")) == ""), F.col("pos"))
    w = W.partitionBy(*keys)
    return lines.withColumn("_lo", F.min(inner).over(w)).withColumn("_hi", F.max(inner).over(w)).where("pos between _lo and _hi").drop("_lo", "_hi")


def numbered_heading(line: Column) -> Column:
    """Struct of number and title of a numbered heading, null for other lines."""
    s = T.strip(line)
    pattern = r"^([0-9]+(?:\.[0-9]+){0,3})\s+([A-Z][A-Za-z &/\-+',]{3,80})\s*[:\-]?\s*$"
    title = T.strip(F.regexp_replace(F.regexp_extract(s, pattern, 2), r"[:\-\s]+$", ""))
    good = s.rlike(pattern) & (F.length(s) <= 120) & ~s.rlike("[.;,]$") & ~T.is_unit_body(title) & ~T.is_body_sentence(title)
    return F.when(good, F.struct(F.regexp_extract(s, pattern, 1).alias("number"), T.heading_case(title).alias("title")))


def capital_heading(line: Column) -> Column:
    """Title of an isolated all-capitals heading of six letters or more, null for other lines."""
    s = T.strip(line)
    body = T.strip(F.regexp_replace(s, r"[:\-\s]+$", ""))
    letters = F.length(F.regexp_replace(body, "[^A-Za-z]", ""))
    digits = F.length(F.regexp_replace(body, "[^0-9]", ""))
    callout = F.lower(body).isin(*"note notes caution warning warnings important tip tips danger attention remarks remark hint".split())
    good = (
        # fixed values: patterns of headings, and of what looks like one
        s.rlike(r"^[A-Z][A-Z0-9 &/\-+()',]{3,80}\s*[:\-]?\s*$") & ~s.rlike("[.;,]$") & (letters >= 6) & (digits * 5 <= F.length(body)) & ~callout
        & ~body.rlike(r"\(.*\)$") & ~body.rlike(r"(?i)[0-9].*[x×*].*[0-9]|[0-9]\s*(?:mm|cm|kg|nm|rpm|hp|kw|ah|v|w|l|ml)\b") & ~T.is_body_sentence(body)
    )
    return F.when(good, T.heading_case(body))


def carried_sections(lines: DataFrame) -> DataFrame:
    """``main > sub`` of every line: the last main heading, and the last sub heading since it.

    ``lines(doc_id, pos, main, sub)`` with null where a line is no heading.
    """
    w = W.partitionBy("doc_id").orderBy("pos")
    rows = lines.withColumn("_m", F.last("main", ignorenulls=True).over(w)).withColumn("_g", F.count("main").over(w))
    rows = rows.withColumn("_s", F.last("sub", ignorenulls=True).over(W.partitionBy("doc_id", "_g").orderBy("pos")))
    return rows.withColumn("section", F.concat_ws(" > ", "_m", "_s")).drop("_m", "_g", "_s")


def breadcrumbs(headings: DataFrame, fresh: int = FRESH_PAGES) -> DataFrame:
    """Path of every numbered heading: for each prefix of its number the latest registration up to it, if fresh.

    ``headings(doc_id, seq, page, number, title)``. Prefixes and registrations of a
    document and number lie in one order, where each prefix takes the last
    registration before it: the cost grows with the headings, not with their pairs.
    """
    parts = F.split("number", r"\.")
    own = F.struct(F.col("page").alias("at_page"), F.col("title").alias("at_title"))
    known = headings.select("doc_id", F.col("number").alias("prefix"), "seq", F.lit(0).alias("level"), "page", own.alias("own"))
    asked = headings.select("doc_id", "seq", "page", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("level", "prefix"))
    asked = asked.select("doc_id", "prefix", "seq", F.col("level") + 1, "page", F.lit(None).cast(known.schema["own"].dataType))
    order = W.partitionBy("doc_id", "prefix").orderBy("seq", "level").rowsBetween(W.unboundedPreceding, W.currentRow)
    latest = known.union(asked).withColumn("x", F.last("own", ignorenulls=True).over(order)).where("level > 0 and x is not null")
    fresh_ones = latest.where((F.col("page") == 0) | (F.col("x.at_page") == 0) | (F.col("page") - F.col("x.at_page") <= fresh))
    crumbs = fresh_ones.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(F.struct("level", F.col("x.at_title").alias("t")))).alias("c"))
    titles = F.transform("c", lambda x: x.t)
    once = F.filter(titles, lambda t, i: (i == 0) | (t != F.try_element_at(titles, i.cast("int"))))
    return crumbs.select("doc_id", "seq", F.array_join(once, " > ").alias("path"))


def merge_rows(cells: DataFrame) -> DataFrame:
    """Continuation rows folded into the keyed row before them.

    ``cells(table_id, row, col, value)``. The key column is the leftmost with two
    distinct values or more; rows before the first key stay single; a table
    without a key column stays as it is.
    """
    whole = cells.repartition("table_id")  # the only exchange: all that follows keeps tables together
    value = F.when(F.col("value") != "", F.col("value"))
    column = W.partitionBy("table_id", "col")
    varied = whole.withColumn("_v", F.min(value).over(column) != F.max(value).over(column))
    marked = varied.withColumn("key_col", F.min(F.when(F.col("_v"), F.col("col"))).over(W.partitionBy("table_id")))
    has_key = F.max(F.when((F.col("col") == F.col("key_col")) & (F.col("value") != ""), 1).otherwise(0)).over(W.partitionBy("table_id", "row"))
    rows = marked.withColumn("_k", has_key).withColumn("_g", F.max(F.when(F.col("_k") == 1, F.col("row"))).over(W.partitionBy("table_id").orderBy("row")))
    group = F.when(F.col("key_col").isNull() | F.col("_g").isNull(), F.col("row")).otherwise(F.col("_g"))
    kept = rows.where("value <> ''").select("table_id", group.alias("_to"), "col", "row", "value")
    joined = kept.groupBy("table_id", "_to", "col").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("v"))
    return joined.select("table_id", F.col("_to").alias("row"), "col", F.array_join(F.transform("v", lambda x: x.value), "\n").alias("value"))


def table_prose(intro: Column, rows: Column) -> Column:
    """``intro: a (b, c); d.`` of an array of rows; a row of one cell stays bare, empty cells are left out."""
    filled = F.filter(F.transform(rows, lambda r: F.filter(F.transform(r, T.strip), lambda c: c != "")), lambda r: F.size(r) > 0)
    shown = F.transform(filled, lambda r: F.when(F.size(r) == 1, r[0]).otherwise(F.concat(r[0], F.lit(" ("), F.array_join(F.slice(r, F.lit(2), F.size(r) - 1), ", "), F.lit(")"))))
    return F.when(F.size(filled) == 0, F.lit("")).otherwise(F.concat(intro, F.lit(": "), F.array_join(shown, "; "), F.lit(".")))


def table_intro(headers: Column) -> Column:
    """The first header that reads like a label, else ``Items``."""
    good = F.filter(F.transform(headers, T.strip), lambda h: (h != "") & ~h.rlike("^col[0-9]+$") & ~h.rlike("[0-9]") & (F.length(h) <= 30) & (F.size(F.split(h, r"\s+")) <= 3))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit("Items"))


def is_junk_table(headers: Column, rows: Column) -> Column:
    """No cells, or without headers: under 30 % filled, or no letter in any cell."""
    cells = F.transform(F.flatten(rows), T.strip)
    filled = F.size(F.filter(cells, lambda c: c != ""))
    labelled = F.exists(headers, lambda h: T.strip(T.nz(h)) != "")
    lettered = F.exists(cells, lambda c: c.rlike("[A-Za-z]"))
    return F.when(F.size(cells) == 0, F.lit(True)).when(labelled, F.lit(False)).otherwise((filled * 10 < F.size(cells) * 3) | ~lettered)


def is_real_table(rows: Column) -> Column:
    """Two rows, two columns and three filled cells at least."""
    width = F.array_max(F.transform(rows, F.size))
    filled = F.size(F.filter(F.flatten(rows), lambda c: T.strip(T.nz(c)) != ""))
    return F.coalesce((F.size(rows) >= 2) & (width >= 2) & (filled >= 3), F.lit(False))


def has_word_splits(rows: Column) -> Column:
    """Two rows or more, of three at least, whose cells cut a word: a short lower-case tail before a lower-case start."""

    def cut(row: Column) -> Column:
        cells = F.filter(F.transform(row, lambda c: T.strip(T.nz(c))), lambda c: c != "")
        pairs = F.zip_with(cells, F.slice(cells, F.lit(2), F.size(cells)), lambda a, b: F.regexp_extract(a, r"(\S+)$", 1).rlike("^[.,;:!?'\"()\\[\\]]*[a-z]{1,4}[.,;:!?'\"()\\[\\]]*$") & b.rlike("^[a-z]"))
        return F.exists(pairs, lambda p: F.coalesce(p, F.lit(False)))

    return (F.size(rows) >= 3) & (F.size(F.filter(rows, cut)) >= 2)


def merge_tiny(chunks: DataFrame, tiny: int = 200, stub: int = 100) -> DataFrame:
    """Small neighbouring chunks of one page and section joined, in document order.

    A fold over each run of (doc_id, page, section): a chunk under ``tiny``
    characters joins the one before; a stub before a full chunk joins it too.
    A run is bounded by its page, so the folded array is small.
    """
    runs = chunks.groupBy("doc_id", "page", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "text"))).alias("run"))
    empty = F.array().cast("array<struct<chunk_id:string,text:string>>")

    def step(out: Column, chunk: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = (F.size(out) > 0) & ((F.length(chunk.text) < tiny) | (F.length(last.text) < stub))
        joined = F.struct(last.chunk_id.alias("chunk_id"), F.concat(last.text, F.lit("\n"), chunk.text).alias("text"))
        own = F.struct(chunk.chunk_id.alias("chunk_id"), chunk.text.alias("text"))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(out, F.array(own)))

    folded = runs.select("doc_id", "page", "section", F.explode(F.aggregate("run", empty, step)).alias("c"))
    return folded.select("doc_id", "page", "section", "c.chunk_id", "c.text", F.length("c.text").cast("long").alias("chars"))


def table_duplicates(tables: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Pairs of tables of a page of which one contains the other at a length ratio of 0.8 or more, and the one to keep.

    ``tables(doc_id, page, idx, flavor, text)``: lattice before stream, then the
    longer, then the first. The pairs of a page number at most the square of its
    few tables.
    """
    a, b = tables.alias("a"), tables.alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.idx") < F.col("b.idx"))
    la, lb = F.length("a.text"), F.length("b.text")
    held = F.when(la >= lb, F.contains("a.text", F.col("b.text"))).otherwise(F.contains("b.text", F.col("a.text")))
    pairs = a.join(b, same).where((F.least(la, lb) >= ratio * F.greatest(la, lb)) & held & (F.least(la, lb) > 0))
    lattice_a, lattice_b = F.col("a.flavor") == "lattice", F.col("b.flavor") == "lattice"
    keep = F.when(lattice_a & ~lattice_b, F.col("a.idx")).when(lattice_b & ~lattice_a, F.col("b.idx")).when(lb > la, F.col("b.idx")).otherwise(F.col("a.idx"))
    return pairs.select("a.doc_id", "a.page", F.col("a.idx").alias("first_idx"), F.col("b.idx").alias("second_idx"), keep.alias("keep_idx"))
