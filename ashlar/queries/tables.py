"""Table operators and the whole preparation chain over all documents, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import structure as S
from ..operators import tables as B
from ..registry import query
from ..sources import base
from .structure import grids, page_chunks
from .text import o_in, o_strip, o_words, on_lines

_FIRST = f"regexp_replace(lower({o_words('line')}[1]), '^[.,:;]+|[.,:;]+$', '', 'g')"
on_lines("subtopic", T.is_subtopic_body, f"""(length(line) BETWEEN 5 AND 120 AND len({o_words('line')}) >= 2 AND regexp_matches(line, '^[A-Z]') AND NOT coalesce({_FIRST} IN {o_in(T.IMPERATIVES)}, false)
    AND (NOT contains(left(line, greatest(length(line) - 1, 0)), '.') OR regexp_matches(line, '[A-Z]\\.[A-Z]')))""")

_SHORT = "length({c}) <= {n} AND NOT regexp_matches({c}, '[.;:] ') AND NOT regexp_matches({c}, '[;,]$') AND NOT (regexp_matches({c}, '\\.$') AND len(regexp_split_to_array({c}, '\\s+')) > 1) AND len(regexp_split_to_array({c}, '\\s+')) <= {w}"
_BLANKLESS = "list_filter({r}, lambda c: c <> '')"


def _all(row: str, n: int, w: int, least: int) -> str:
    cells = _BLANKLESS.format(r=row)
    return f"(len({cells}) >= {least} AND len(list_filter({cells}, lambda c: NOT ({_SHORT.format(c='c', n=n, w=w)}))) = 0)"


_GLUED = "list_transform(range(1, len(rows[1]) + 1), lambda i: concat_ws(' ', nullif(rows[1][i], ''), nullif(rows[2][i], '')))"


@query("promote_header", f"""WITH p AS (SELECT *, len(list_filter(headers, lambda h: h <> '')) < greatest(2, len(headers) // 2) AND {_all('rows[1]', 40, 5, 2)} AS take,
        {_all('rows[2]', 30, 3, 1)} AND len(list_filter({_GLUED}, lambda c: length(c) > 40)) = 0 AS glue FROM grids2)
    SELECT doc_id, array_to_string(CASE WHEN take AND glue THEN {_GLUED} WHEN take THEN rows[1] ELSE headers END, '|') AS headers, CASE WHEN take AND glue THEN len(rows) - 2 WHEN take THEN len(rows) - 1 ELSE len(rows) END AS n FROM p""".replace("grids2", "(SELECT doc_id, headers, [[source, lang], ['', CASE WHEN doc_id % 7 = 0 THEN 'x' WHEN doc_id % 7 = 1 THEN 'NO.' ELSE '' END], ['1', '2']] AS rows FROM grids JOIN documents USING (doc_id))"))
def promote_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").selectExpr("doc_id", "array(array(source, lang), array('', case doc_id % 7 when 0 then 'x' when 1 then 'NO.' else '' end), array('1', '2')) as rows")
    t = grids(spark, sf_dir).select("doc_id", "headers").join(docs, "doc_id").select("doc_id", B.promoted(F.col("headers"), F.col("rows")).alias("t"))
    return t.select("doc_id", F.array_join("t.headers", "|").alias("headers"), F.size("t.rows").cast("long").alias("n"))


@query("structure_table", "SELECT doc_id, array_to_string(headers, '|') AS headers, array_to_string(list_transform(list_filter(rows, lambda r: len(list_filter(r, lambda c: coalesce(c, '') <> '')) > 0), lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), '|')), chr(10)) AS rows FROM grids")
def structure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with repaired cells, without blank rows; their headers stay (``promote_header`` promotes)."""
    t = grids(spark, sf_dir).select("doc_id", B.repaired(F.col("headers"), F.col("rows")).alias("t"))
    return t.select("doc_id", F.array_join("t.headers", "|").alias("headers"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


_HEADER_WORDS = "regexp_extract_all(lower(array_to_string(list_filter(headers, lambda h: h <> ''), ' ')), '[a-z'']+')"


@query("table_quality", f"""SELECT doc_id, CASE WHEN len({_HEADER_WORDS}) >= 4 AND len(list_filter({_HEADER_WORDS}, lambda w: w IN {o_in(T.FUNCTION_WORDS)})) >= 2 THEN false WHEN len(list_filter(headers, lambda h: h <> '' AND length(h) <= 50)) >= 2 THEN true ELSE len(list_filter(flatten(rows), lambda c: c <> '')) >= 2 * len(rows) END AS value FROM grids""")
def table_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("doc_id", B.looks_real(F.col("headers"), F.col("rows")).alias("value"))


@query("table_pipes", """WITH w AS (SELECT doc_id, headers, rows, list_transform(range(1, len(headers) + 1), lambda i: greatest(1, length(headers[i]), list_max(list_transform(rows, lambda r: least(40, length(coalesce(r[i], ''))))))) AS w FROM grids)
    SELECT doc_id, array_to_string(list_transform([headers] || rows, lambda r: regexp_replace(array_to_string(list_transform(range(1, len(headers) + 1), lambda i: rpad(left(coalesce(r[i], ''), w[i]), w[i]::INTEGER, ' ')), ' | '), '\\s+$', '')), chr(10)) AS value FROM w""")
def table_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as aligned text; the rule line is left out here, as its width says nothing new."""
    text = B.as_pipes(F.col("headers"), F.col("rows"))
    return grids(spark, sf_dir).select("doc_id", F.regexp_replace(text, r"(?m)^-[-+]*\n", "").alias("value"))


@query("isolated_lines", f"SELECT doc_id, pos, coalesce(lag({o_strip('line')}) OVER (PARTITION BY doc_id ORDER BY pos), '') = '' AS isolated, first_value(CASE WHEN {o_strip('line')} <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS next_line FROM doc_lines")
def isolated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after a blank one or a start, and the next filled line among the four that follow."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = base.lines(spark, sf_dir).withColumn("bare", T.strip(F.col("line")))
    following = F.first(F.when(F.col("bare") != "", F.col("line")), ignorenulls=True).over(w.rowsBetween(1, 4))
    return rows.select("doc_id", "pos", (F.coalesce(F.lag("bare").over(w), F.lit("")) == "").alias("isolated"), following.alias("next_line"))


@query("prepare_index")
def prepare_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index records of all documents: cleaned, small chunks merged, empty ones dropped, section prefixed, ids built."""
    chunks = page_chunks(spark, sf_dir).withColumn("text", T.light_clean(F.col("text")))
    merged = S.merge_tiny(chunks.select("doc_id", "page", "section", "chunk_id", "text", "pos")).where(T.has_content(F.col("text")))
    body = F.concat_ws("\n", F.concat(F.lit("[Section: "), T.sanitize_section(F.col("section")), F.lit("]")), T.strip_section(F.col("text")))
    return merged.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("::"), "chunk_id").alias("id"), "page", "section", body.alias("text"), F.length(body).cast("long").alias("char_count"))


@query("image_filter_stats", "SELECT doc_id % 4 AS kind, count(*) AS images, count(*) FILTER (doc_id % 3 = 0) AS skipped, count(*) FILTER (doc_id % 3 = 1 AND doc_id % 2 = 0) AS cropped FROM documents GROUP BY 1")
def image_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of an image filter run by kind."""
    rows = base.table(spark, sf_dir, "documents").selectExpr("doc_id % 4 as kind", "case when doc_id % 3 = 0 then 'skipped' when doc_id % 3 = 1 and doc_id % 2 = 0 then 'cropped' else 'kept' end as outcome")
    return rows.groupBy("kind").agg(F.count("*").alias("images"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "cropped").alias("cropped"))


@query("relevance_judge", "SELECT d.doc_id, coalesce(l.quality, 1) >= 0.5 AS relevant FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id")
def relevance_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored judgements, fail-open where there is none."""
    from ..functions.scorers import fail_open

    known = base.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    return base.table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", (fail_open(F.col("quality")) >= 0.5).alias("relevant"))
