"""Extracted tables as arrays of headers and rows: judging, header promotion, cleaning, plain-text rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .structure import has_word_splits


def _label(cell: Column, chars: int, words: int) -> Column:
    """A short cell without sentence punctuation (a period may end a single word)."""
    n = F.size(F.split(cell, r"\s+"))
    return (F.length(cell) <= chars) & ~cell.rlike("[.;:] ") & ~cell.rlike("[;,]$") & ~(cell.rlike(r"\.$") & (n > 1)) & (n <= words)


def _filled(row: Column) -> Column:
    return F.filter(F.transform(row, lambda c: T.strip(T.nz(c))), lambda c: c != "")


def is_header_row(row: Column) -> Column:
    cells = _filled(row)
    return (F.size(cells) >= 2) & F.forall(cells, lambda c: _label(c, 40, 5))


def is_header_continuation(row: Column) -> Column:
    cells = _filled(row)
    return (F.size(cells) >= 1) & F.forall(cells, lambda c: _label(c, 30, 3))


def promoted(headers: Column, rows: Column) -> Column:
    """Struct of headers and rows: where too few headers are filled, a header-like first row takes their place.

    A second row that continues it is glued on, cell by cell, if no glued cell exceeds 40 characters.
    """
    good = F.size(F.filter(headers, lambda h: h != "")) >= F.greatest(F.lit(2), F.floor(F.size(headers) / 2))
    first, second = F.try_element_at(rows, F.lit(1)), F.try_element_at(rows, F.lit(2))
    trimmed = F.transform(first, T.strip)
    glued = F.zip_with(trimmed, F.transform(second, T.strip), lambda a, b: T.strip(F.concat_ws(" ", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))))
    glue = F.coalesce(second.isNotNull() & is_header_continuation(second) & F.forall(glued, lambda c: F.length(c) <= 40), F.lit(False))
    take = ~good & first.isNotNull() & F.coalesce(is_header_row(first), F.lit(False))
    tail = lambda n: F.slice(rows, F.lit(n + 1), F.greatest(F.size(rows) - n, F.lit(0)))
    return F.struct(F.when(take & glue, glued).when(take, trimmed).otherwise(headers).alias("headers"), F.when(take & glue, tail(2)).when(take, tail(1)).otherwise(rows).alias("rows"))


def repaired(headers: Column, rows: Column) -> Column:
    """Struct of headers (blank over 80 characters) and rows with repaired cells, blank rows left out."""
    labels = F.transform(headers, lambda h: F.when(F.length(T.strip(T.nz(h))) > 80, F.lit("")).otherwise(T.glyphs(T.strip(T.nz(h)))))
    cell = lambda c: T.part_number_fix(T.phrase_fix(T.glyphs(T.strip(T.nz(c))), T.LIGATURE_DROPS))
    kept = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    return F.struct(labels.alias("headers"), kept.alias("rows"))


def cleaned(headers: Column, rows: Column) -> Column:
    """The repaired table, header promoted."""
    table = repaired(headers, rows)
    return promoted(table.headers, table.rows)


def looks_real(headers: Column, rows: Column) -> Column:
    """No sentence as header, no cut words, and two plausible headers or two filled cells a row on average."""
    plausible = F.size(F.filter(headers, lambda h: (T.nz(h) != "") & (F.length(T.strip(h)) <= 50) & ~T.strip(h).rlike("^[0-9]")))
    cells = F.size(F.filter(F.flatten(rows), lambda c: T.strip(T.nz(c)) != ""))
    return (F.size(rows) > 0) & ~T.is_sentence_header(headers) & ~has_word_splits(rows) & ((plausible >= 2) | (cells >= 2 * F.size(rows)))


def as_pipes(headers: Column, rows: Column, cap: int = 40) -> Column:
    """Aligned lines divided by `` | `` under a rule; columns are as wide as their longest cell, 40 characters at most."""
    at = F.transform(headers, lambda h, i: i)
    width = F.transform(at, lambda i: F.greatest(F.lit(1), F.length(headers[i]), F.array_max(F.transform(rows, lambda r: F.least(F.lit(cap), F.length(T.nz(F.get(r, i))))))))
    line = lambda r: T.rstrip(F.array_join(F.transform(at, lambda i: F.rpad(F.left(T.nz(F.get(r, i)), F.get(width, i)), F.get(width, i), F.lit(" "))), " | "))
    rule = F.array_join(F.transform(width, lambda w: F.repeat(F.lit("-"), w)), "-+-")
    return F.when((F.size(headers) == 0) & (F.size(rows) == 0), F.lit("")).otherwise(F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n"))
