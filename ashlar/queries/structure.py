"""Line, section and table operators over all documents and pages, with their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import structure as S
from ..registry import oracle_view, query
from ..sources import base
from .text import o_body_sentence, o_heading_case, o_in, o_strip, o_unit_body, q

PAGE_LINES = 5
# a document's lines as pages of five; every page of every third document starts with its source as header
oracle_view("page_lines", f"""SELECT doc_id, page, CASE WHEN n = 0 THEN -1 ELSE pos END AS pos, line FROM (
    SELECT doc_id, pos // {PAGE_LINES} AS page, pos, 1 AS n, line FROM split_lines
    UNION ALL SELECT s.doc_id, s.pos // {PAGE_LINES}, -1, 0, 'MANUAL ' || d.source FROM split_lines s JOIN documents d ON d.doc_id = s.doc_id WHERE s.doc_id % 3 = 0 AND s.pos % {PAGE_LINES} = 0)""")
oracle_view("first_lines", f"SELECT doc_id, page, {o_strip('arg_min(line, pos)')} AS line FROM page_lines WHERE {o_strip('line')} <> '' GROUP BY doc_id, page")
oracle_view("running", """SELECT doc_id, line, n, start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, start) AS place FROM (
    SELECT doc_id, line, count(*) AS n, min(page) AS start FROM (SELECT *, page - row_number() OVER (PARTITION BY doc_id, line ORDER BY page) AS island FROM first_lines) GROUP BY doc_id, line, island HAVING count(*) >= 3)) WHERE place = 1""")
oracle_view("headings", "SELECT doc_id, pos AS seq, pos // 5 AS page, (1 + pos % 3) || CASE WHEN pos % 2 = 0 THEN '' ELSE '.' || (1 + pos % 4) END || CASE WHEN pos % 4 = 3 THEN '.2' ELSE '' END AS number, 'T' || pos % 7 AS title FROM split_lines")
oracle_view("cells", "SELECT doc_id AS table_id, pos // 3 AS row, pos % 3 AS col, CASE WHEN pos % 3 = 0 AND pos % 2 = 1 THEN '' ELSE regexp_replace(line, '[^A-Za-z0-9]', '', 'g') END AS value FROM split_lines")
oracle_view("grids", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ['', ''] WHEN doc_id % 4 = 1 THEN ['Part', 'Qty'] ELSE ['col1', 'Long label that never ends at all here', 'Name'] END AS headers, [[CASE WHEN doc_id % 11 = 10 THEN '' ELSE source END, ''], [CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END, CASE WHEN doc_id % 3 = 0 THEN '12' ELSE '' END], ['', CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END]] AS rows FROM documents")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = base.lines(spark, sf_dir).where("doc_id >= 0").selectExpr("doc_id", f"pos div {PAGE_LINES} as page", "pos", "line")
    docs = base.table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('MANUAL ', source) as line")
    heads = lines.where(f"doc_id % 3 = 0 and pos % {PAGE_LINES} = 0").select("doc_id", "page").join(docs, "doc_id").selectExpr("doc_id", "page", "-1L as pos", "line")
    return lines.unionByName(heads)


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = page_lines(spark, sf_dir).where(T.strip(F.col("line")) != "")
    return filled.groupBy("doc_id", "page").agg(T.strip(F.min_by("line", "pos")).alias("line"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = "concat(1 + pos % 3, if(pos % 2 = 0, '', concat('.', 1 + pos % 4)), if(pos % 4 = 3, '.2', ''))"
    return base.lines(spark, sf_dir).where("doc_id >= 0").selectExpr("doc_id", "pos as seq", "pos div 5 as page", f"{number} as number", "concat('T', pos % 7) as title")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.lines(spark, sf_dir).where("doc_id >= 0").selectExpr("doc_id as table_id", "pos div 3 as row", "pos % 3 as col", "if(pos % 3 = 0 and pos % 2 = 1, '', regexp_replace(line, '[^A-Za-z0-9]', '')) as value")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "case when doc_id % 4 = 0 then array('', '') when doc_id % 4 = 1 then array('Part', 'Qty') else array('col1', 'Long label that never ends at all here', 'Name') end as headers",
        "array(array(if(doc_id % 11 = 10, '', source), ''), array(if(doc_id % 5 = 0, '', lang), if(doc_id % 3 = 0, '12', '')), array('', if(doc_id % 7 = 0, 'x', ''))) as rows",
    )


@query("running_header", "SELECT doc_id, line, n, start FROM running")
def running_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running_header(first_lines(spark, sf_dir))


@query("strip_header", f"""SELECT p.doc_id, p.page, p.pos, p.line FROM (SELECT *, min(CASE WHEN {o_strip('line')} <> '' THEN pos END) OVER (PARTITION BY doc_id, page) AS f FROM page_lines) p LEFT JOIN running r ON r.doc_id = p.doc_id
    WHERE NOT coalesce(p.pos = p.f AND {o_strip('p.line')} = r.line, false)""")
def strip_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.strip_header(page_lines(spark, sf_dir), running_header(spark, sf_dir)).select("doc_id", "page", "pos", "line")


_FOLIO = f"regexp_matches(line, {q('(?i)' + T.FOLIO)})"
oracle_view("folio_lines_in", "SELECT doc_id, pos // 5 AS page, pos, CASE WHEN (doc_id + pos) % 5 = 0 THEN 'Page ' || pos WHEN (doc_id + pos) % 11 = 1 THEN '' ELSE line END AS line FROM split_lines")


@query("folio_strip", f"SELECT doc_id, page, pos, line FROM (SELECT *, min(CASE WHEN NOT {_FOLIO} OR {o_strip('line')} = '' THEN pos END) OVER w AS lo, max(CASE WHEN NOT {_FOLIO} OR {o_strip('line')} = '' THEN pos END) OVER w AS hi FROM folio_lines_in WINDOW w AS (PARTITION BY doc_id, page)) WHERE pos BETWEEN lo AND hi")
def folio_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = base.lines(spark, sf_dir).where("doc_id >= 0").selectExpr("doc_id", "pos div 5 as page", "pos", "case when (doc_id + pos) % 5 = 0 then concat('Page ', pos) when (doc_id + pos) % 11 = 1 then '' else line end as line")
    return S.folio_strip(shaped, ["doc_id", "page"])


# every third line numbered, every third in capitals: headings with the words of the documents
_TITLE = "regexp_replace(line, '[^A-Za-z ]', '', 'g')"
oracle_view("titled_lines", f"""SELECT doc_id, pos, line FROM doc_lines WHERE doc_id < 0 UNION ALL
    SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN (1 + pos % 9) || '.' || (1 + pos % 4) || ' ' || upper({_TITLE}[1]) || {_TITLE}[2:] WHEN pos % 3 = 1 THEN upper({_TITLE}) ELSE line END FROM doc_lines WHERE doc_id >= 0""")


def _on(expr: str, name: str) -> str:
    """A twin's expression on another column than ``line``."""
    return re.sub(r"\bline\b", name, expr)


@query("headings", f"""WITH l AS (SELECT doc_id, pos, {o_strip('line')} AS s, coalesce(lag({o_strip('line')}) OVER (PARTITION BY doc_id ORDER BY pos), '') = '' AS isolated FROM titled_lines),
    p AS (SELECT *, regexp_extract(s, '^([0-9]+(?:\\.[0-9]+){{0,3}})\\s+([A-Z][A-Za-z &/\\-+'',]{{3,80}})\\s*[:\\-]?\\s*$', ['number', 'title']) AS n, regexp_matches(s, '^([0-9]+(?:\\.[0-9]+){{0,3}})\\s+([A-Z][A-Za-z &/\\-+'',]{{3,80}})\\s*[:\\-]?\\s*$') AND length(s) <= 120 AND NOT regexp_matches(s, '[.;,]$') AS numbered,
        {o_strip("regexp_replace(s, '[:\\-\\s]+$', '')")} AS body FROM l),
    t AS (SELECT *, {o_strip("regexp_replace(n.title, '[:\\-\\s]+$', '')")} AS title FROM p),
    h AS (SELECT doc_id, pos, CASE WHEN numbered AND NOT ({_on(o_unit_body, 'title')}) AND NOT {_on(o_body_sentence, 'title')} THEN n.number END AS number, {_on(o_heading_case, 'title')} AS numbered_title,
        CASE WHEN isolated AND regexp_matches(s, '^[A-Z][A-Z0-9 &/\\-+()'',]{{3,80}}\\s*[:\\-]?\\s*$') AND NOT regexp_matches(s, '[.;,]$') AND length(regexp_replace(body, '[^A-Za-z]', '', 'g')) >= 6 AND length(regexp_replace(body, '[^0-9]', '', 'g')) * 5 <= length(body)
            AND lower(body) NOT IN ('note', 'notes', 'caution', 'warning', 'warnings', 'important', 'tip', 'tips', 'danger', 'attention', 'remarks', 'remark', 'hint') AND NOT regexp_matches(body, '\\(.*\\)$')
            AND NOT regexp_matches(body, '(?i)[0-9].*[x×*].*[0-9]|[0-9]\\s*(?:mm|cm|kg|nm|rpm|hp|kw|ah|v|w|l|ml)\\b') AND NOT {_on(o_body_sentence, 'body')} THEN {_on(o_heading_case, 'body')} END AS capital FROM t)
    SELECT doc_id, pos, number, CASE WHEN number IS NOT NULL THEN numbered_title ELSE capital END AS title FROM h WHERE number IS NOT NULL OR capital IS NOT NULL""")
def headings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered and capital headings of all lines; a line is isolated if the one before is blank or missing."""
    title = "regexp_replace(line, '[^A-Za-z ]', '')"
    shaped = f"case when doc_id < 0 then line when pos % 3 = 0 then concat(1 + pos % 9, '.', 1 + pos % 4, ' ', upper(left({title}, 1)), substr({title}, 2)) when pos % 3 = 1 then upper({title}) else line end"
    lines = base.lines(spark, sf_dir).selectExpr("doc_id", "pos", f"{shaped} as line")
    before = F.lag(T.strip(F.col("line"))).over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = lines.withColumn("isolated", F.coalesce(before, F.lit("")) == "")
    numbered = S.numbered_heading(F.col("line"))
    return rows.select("doc_id", "pos", numbered.alias("numbered"), F.when(F.col("isolated"), S.capital_heading(F.col("line"))).alias("capital")).where("numbered is not null or capital is not null").select("doc_id", "pos", "numbered.number", F.coalesce("numbered.title", "capital").alias("title"))


@query("section_carry", """WITH h AS (SELECT doc_id, pos, CASE WHEN pos % 9 = 2 THEN 'M' || pos END AS main, CASE WHEN pos % 4 = 3 THEN 'S' || pos END AS sub FROM split_lines),
    g AS (SELECT *, last_value(main IGNORE NULLS) OVER w AS m, count(main) OVER w AS grp FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, pos, concat_ws(' > ', m, last_value(sub IGNORE NULLS) OVER (PARTITION BY doc_id, grp ORDER BY pos)) AS section FROM g""")
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.lines(spark, sf_dir).where("doc_id >= 0").selectExpr("doc_id", "pos", "if(pos % 9 = 2, concat('M', pos), null) as main", "if(pos % 4 = 3, concat('S', pos), null) as sub")
    return S.carried_sections(rows).select("doc_id", "pos", "section")


@query("breadcrumbs", """WITH p AS (SELECT doc_id, seq, page, unnest(range(1, len(string_split(number, '.')) + 1)) AS level, string_split(number, '.') AS parts FROM headings),
    x AS (SELECT doc_id, seq, page, level, array_to_string(parts[1:level], '.') AS prefix FROM p),
    m AS (SELECT x.doc_id, x.seq, x.page, x.level, h.page AS at_page, h.title AS t FROM x ASOF JOIN headings h ON h.doc_id = x.doc_id AND h.number = x.prefix AND x.seq >= h.seq),
    f AS (SELECT doc_id, seq, level, t, lag(t) OVER (PARTITION BY doc_id, seq ORDER BY level) AS before FROM m WHERE page = 0 OR at_page = 0 OR page - at_page <= 30)
    SELECT doc_id, seq, string_agg(t, ' > ' ORDER BY level) AS path FROM f WHERE before IS NULL OR before <> t GROUP BY doc_id, seq""")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.breadcrumbs(headings(spark, sf_dir))


@query("header_tokens", "SELECT source, count(DISTINCT w) AS tokens FROM (SELECT source, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s,;:()/\\\\\\-]+'), lambda x: regexp_matches(x, '^[a-z]{3,8}$'))) AS w FROM documents) GROUP BY source")
def header_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each source's set of label-shaped tokens."""
    tokens = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\s,;:()/\\\-]+"), lambda x: x.rlike("^[a-z]{3,8}$"))
    return base.table(spark, sf_dir, "documents").select("source", F.explode(tokens).alias("w")).groupBy("source").agg(F.count_distinct("w").alias("tokens"))


_HEADER_WORDS = ("the", "of", "de", "la", "der", "oil", "filter", "front", "wheel", "10", "20", "30")
_LINE_TOKENS = "list_filter(list_transform(regexp_split_to_array(lower(line), '[\\s,;:()/\\\\\\-]+'), lambda x: regexp_replace(x, '^[.''\"]+|[.''\"]+$', '', 'g')), lambda x: x <> '')"


@query("header_fragments", f"""SELECT doc_id, pos, CASE WHEN len(t) = 0 THEN false WHEN len(list_filter(t, lambda w: NOT regexp_matches(w, '^[0-9]+$'))) = 0 THEN a WHEN length({o_strip('line')}) <= 6 AND a THEN true
    WHEN length({o_strip('line')}) > 30 OR len(t) > 4 THEN false ELSE len(list_filter(t, lambda w: length(w) >= 3)) > 0 AND len(list_filter(t, lambda w: length(w) >= 3 AND w NOT IN {o_in(_HEADER_WORDS)})) = 0 END AS value
    FROM (SELECT *, {_LINE_TOKENS} AS t, len(list_filter({_LINE_TOKENS}, lambda w: w NOT IN {o_in(_HEADER_WORDS)})) = 0 AS a FROM doc_lines)""")
def header_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that only repeat words of table headers."""
    t = T.match_tokens(F.col("line"))
    n = F.length(T.strip(F.col("line")))
    known = lambda w: w.isin(*_HEADER_WORDS)
    long = F.filter(t, lambda w: F.length(w) >= 3)
    value = F.when(F.size(t) == 0, F.lit(False)).when(F.forall(t, lambda w: w.rlike("^[0-9]+$")), F.forall(t, known)).when((n <= 6) & F.forall(t, known), F.lit(True)).when((n > 30) | (F.size(t) > 4), F.lit(False)).otherwise((F.size(long) > 0) & F.forall(long, known))
    return base.lines(spark, sf_dir).select("doc_id", "pos", value.alias("value"))


@query("subtract_cells", f"SELECT l.doc_id, l.pos, l.line FROM doc_lines l WHERE {o_strip('l.line')} = '' OR NOT EXISTS (SELECT 1 FROM doc_lines c WHERE c.pos % 5 = 0 AND c.doc_id = l.doc_id AND {o_strip('c.line')} = {o_strip('l.line')})")
def subtract_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that equal no cell of their document's tables (here every fifth line); blank lines stay."""
    lines = base.lines(spark, sf_dir).withColumn("bare", T.strip(F.col("line")))
    held = lines.where("pos % 5 = 0 and bare <> ''").select("doc_id", "bare").distinct()
    return lines.join(held, ["doc_id", "bare"], "left_anti").select("doc_id", "pos", "line")


@query("ocr_new_lines", """WITH l AS (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9_\\s\\x{80}-\\x{10FFFF}]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM doc_lines),
    e AS (SELECT DISTINCT doc_id, n FROM l WHERE pos % 2 = 0), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY pos) AS nth FROM l WHERE pos % 2 = 1 AND length(n) >= 5)
    SELECT x.doc_id, x.pos FROM x WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = x.doc_id AND e.n = x.n)""")
def ocr_new_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines (the odd ones) that the text (the even ones) does not have, each once."""
    lines = base.lines(spark, sf_dir).select("doc_id", "pos", T.norm_line(F.col("line")).alias("n"))
    fresh = lines.where("pos % 2 = 1 and length(n) >= 5").selectExpr("*", "row_number() over (partition by doc_id, n order by pos) as nth").where("nth = 1")
    return fresh.join(lines.where("pos % 2 = 0").select("doc_id", "n").distinct(), ["doc_id", "n"], "left_anti").select("doc_id", "pos")


@query("merge_rows", """WITH k AS (SELECT table_id, min(col) AS kc FROM (SELECT table_id, col FROM cells WHERE value <> '' GROUP BY ALL HAVING count(DISTINCT value) >= 2) GROUP BY table_id),
    m AS (SELECT c.*, kc, max(CASE WHEN c.col = kc AND value <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY c.table_id, row) AS hk FROM cells c LEFT JOIN k ON k.table_id = c.table_id),
    g AS (SELECT *, max(CASE WHEN hk = 1 THEN row END) OVER (PARTITION BY table_id ORDER BY row) AS grp FROM m)
    SELECT table_id, CASE WHEN kc IS NULL OR grp IS NULL THEN row ELSE grp END AS row, col, string_agg(value, chr(10) ORDER BY row) AS value FROM g WHERE value <> '' GROUP BY table_id, CASE WHEN kc IS NULL OR grp IS NULL THEN row ELSE grp END, col""")
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_rows(cells(spark, sf_dir))


@query("table_prose", """WITH f AS (SELECT doc_id, headers, list_filter(list_transform(rows, lambda r: list_filter(r, lambda c: c <> '')), lambda r: len(r) > 0) AS x FROM grids),
    i AS (SELECT *, coalesce(list_filter(headers, lambda h: h <> '' AND NOT regexp_matches(h, '[0-9]') AND length(h) <= 30 AND len(string_split(h, ' ')) <= 3)[1], 'Items') AS intro FROM f)
    SELECT doc_id, intro, CASE WHEN len(x) = 0 THEN '' ELSE intro || ': ' || array_to_string(list_transform(x, lambda r: CASE WHEN len(r) = 1 THEN r[1] ELSE r[1] || ' (' || array_to_string(r[2:], ', ') || ')' END), '; ') || '.' END AS value FROM i""")
def table_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    intro = S.table_intro(F.col("headers"))
    return grids(spark, sf_dir).select("doc_id", intro.alias("intro"), S.table_prose(intro, F.col("rows")).alias("value"))


@query("table_intro", "SELECT doc_id, coalesce(list_filter(headers, lambda h: h <> '' AND NOT regexp_matches(h, '[0-9]') AND length(h) <= 30 AND len(string_split(h, ' ')) <= 3)[1], 'Items') AS value FROM grids")
def table_intro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("doc_id", S.table_intro(F.col("headers")).alias("value"))


_CELLS = "flatten(rows)"


@query("junk_table", f"SELECT doc_id, CASE WHEN len({_CELLS}) = 0 THEN true WHEN len(list_filter(headers, lambda h: h <> '')) > 0 THEN false ELSE len(list_filter({_CELLS}, lambda c: c <> '')) * 10 < len({_CELLS}) * 3 OR len(list_filter({_CELLS}, lambda c: regexp_matches(c, '[A-Za-z]'))) = 0 END AS value FROM grids")
def junk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("doc_id", S.is_junk_table(F.col("headers"), F.col("rows")).alias("value"))


@query("useful_table", f"SELECT doc_id, len(list_filter({_CELLS}, lambda c: c <> '')) > 0 AS value FROM grids")
def useful_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("doc_id", F.exists(F.flatten("rows"), lambda c: T.strip(T.nz(c)) != "").alias("value"))


@query("real_table", f"SELECT doc_id, len(rows) >= 2 AND len(list_filter({_CELLS}, lambda c: c <> '')) >= 3 AS value FROM grids")
def real_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("doc_id", S.is_real_table(F.col("rows")).alias("value"))


_CUT = "regexp_matches(regexp_extract(x[1], '(\\S+)$', 1), '^[.,;:!?''\"()\\[\\]]*[a-z]{1,4}[.,;:!?''\"()\\[\\]]*$') AND regexp_matches(x[2], '^[a-z]')"


@query("word_splits", f"""WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents),
    r AS (SELECT doc_id, n, list_filter(list_transform(w[n + 1:n + 4], lambda x: {o_strip('x')}), lambda x: x <> '') AS c FROM (SELECT doc_id, w, unnest(range(0, len(w), 4)) AS n FROM w))
    SELECT doc_id, count(*) >= 3 AND count(*) FILTER (len(c) > 1 AND len(list_filter(list_zip(c[:-2], c[2:]), lambda x: {_CUT})) > 0) >= 2 AS value FROM r GROUP BY doc_id""")
def word_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of four words a row made of each document's whole text, judged for cut words."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    # the pattern may also find an empty row behind the last word
    rows = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^ ]*(?: [^ ]*){0,3})(?: |$)"), F.lit(1)), lambda r: F.split(r, " "))
    docs = base.table(spark, sf_dir, "documents").select("doc_id", F.slice(rows, F.lit(1), F.ceil(F.size(words) / 4).cast("int")).alias("rows"))
    return docs.select("doc_id", S.has_word_splits(F.col("rows")).alias("value"))


@query("table_line_split", "SELECT doc_id, i - 1 AS line_no, coalesce(a[i], '') || '|' || coalesce(b[i], '') AS row FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a, string_split(source || chr(10) || lang, chr(10)) AS b FROM documents), LATERAL (SELECT unnest(range(1, greatest(len(a), len(b)) + 1)) AS i) WHERE coalesce(a[i], '') <> '' OR coalesce(b[i], '') <> ''")
def table_line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of several lines become several rows, padded with empty cells; blank rows go."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("a"), F.split(F.concat("source", F.lit("\n"), "lang"), "\n").alias("b"))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip("a", "b")).alias("line_no", "x")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.coalesce("x.a", F.lit("")).alias("a"), F.coalesce("x.b", F.lit("")).alias("b"))
    return rows.where("a <> '' or b <> ''").select("doc_id", "line_no", F.concat("a", F.lit("|"), "b").alias("row"))


@query("flatten_table", "SELECT doc_id, array_to_string(list_concat([array_to_string(headers, ' | ')], list_transform(list_filter(rows, lambda r: len(list_filter(r, lambda c: c <> '')) > 0), lambda r: array_to_string(r, ' | '))), chr(10)) AS value FROM grids")
def flatten_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.filter("rows", lambda r: F.exists(r, lambda c: c != ""))
    return grids(spark, sf_dir).select("doc_id", F.array_join(F.concat(F.array(F.array_join("headers", " | ")), F.transform(filled, lambda r: F.array_join(r, " | "))), "\n").alias("value"))


@query("embed_text", "SELECT doc_id, concat_ws(chr(10), CASE WHEN section <> 'General' THEN '[Section: ' || section || ']' END, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '')) AS value FROM matches")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("section") != "General", F.concat(F.lit("[Section: "), "section", F.lit("]")))
    return base.matches(spark, sf_dir).select("doc_id", F.concat_ws("\n", section, F.nullif(T.strip(F.col("text")), F.lit(""))).alias("value"))


@query("table_dedupe", """WITH t AS (SELECT doc_id // 4 AS page, doc_id, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS idx, CASE WHEN doc_id % 2 = 0 THEN 'stream' ELSE 'lattice' END AS flavor, repeat('ab', CAST(20 + doc_id % 4 AS INTEGER)) AS text FROM documents)
    SELECT 0::BIGINT AS doc_id, a.page, a.idx AS first_idx, b.idx AS second_idx, CASE WHEN a.flavor = 'lattice' AND b.flavor <> 'lattice' THEN a.idx WHEN b.flavor = 'lattice' AND a.flavor <> 'lattice' THEN b.idx WHEN length(b.text) > length(a.text) THEN b.idx ELSE a.idx END AS keep_idx
    FROM t a JOIN t b ON a.page = b.page AND a.idx < b.idx WHERE least(length(a.text), length(b.text)) >= 0.8 * greatest(length(a.text), length(b.text)) AND (contains(a.text, b.text) OR contains(b.text, a.text))""")
def table_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = base.table(spark, sf_dir, "documents").selectExpr("0L as doc_id", "doc_id div 4 as page", "cast(row_number() over (partition by doc_id div 4 order by doc_id) as bigint) as idx", "if(doc_id % 2 = 0, 'stream', 'lattice') as flavor", "repeat('ab', cast(20 + doc_id % 4 as int)) as text")
    return S.table_duplicates(tables)


@query("table_fallback", "WITH l AS (SELECT doc_id AS page, 'lattice' AS flavor FROM documents WHERE doc_id % 3 = 0), s AS (SELECT doc_id AS page, 'stream' AS flavor FROM documents WHERE doc_id % 2 = 0) SELECT * FROM l UNION ALL SELECT * FROM s WHERE page NOT IN (SELECT page FROM l)")
def table_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice tables, and stream tables of the pages without any."""
    docs = base.table(spark, sf_dir, "documents")
    lattice = docs.where("doc_id % 3 = 0").selectExpr("doc_id as page", "'lattice' as flavor")
    stream = docs.where("doc_id % 2 = 0").selectExpr("doc_id as page", "'stream' as flavor")
    return lattice.unionByName(stream.join(lattice, "page", "left_anti"))


@query("page_method", "SELECT doc_id, CASE WHEN n = 0 AND o = 0 THEN 'blank' WHEN n < 30 THEN 'ocr_full' WHEN n < 1500 AND o > 1.2 * n AND o > n + 100 THEN 'ocr_swap' WHEN n < 1500 THEN 'ocr_augment' ELSE 'text' END AS method FROM (SELECT doc_id, length(coalesce(text, '')) AS n, (doc_id * 37) % 3000 AS o FROM documents)")
def page_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text or recognition, by the lengths of both (the recognised length is made from the id)."""
    n, o = F.length(F.coalesce("text", F.lit(""))), F.expr("(doc_id * 37) % 3000")
    method = F.when((n == 0) & (o == 0), "blank").when(n < 30, "ocr_full").when((n < 1500) & (o > 1.2 * n) & (o > n + 100), "ocr_swap").when(n < 1500, "ocr_augment").otherwise("text")
    return base.table(spark, sf_dir, "documents").select("doc_id", method.alias("method"))


@query("method_counts", "WITH m AS (SELECT source, CASE WHEN length(coalesce(text, '')) < 30 THEN 'ocr_full' WHEN length(text) < 1500 THEN 'ocr_augment' ELSE 'text' END AS method, length(coalesce(text, '')) AS n FROM documents) SELECT source, method, count(*) AS pages, CAST(sum(n) AS BIGINT) AS chars FROM m GROUP BY ALL")
def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    method = F.when(n < 30, "ocr_full").when(n < 1500, "ocr_augment").otherwise("text")
    return base.table(spark, sf_dir, "documents").groupBy("source", method.alias("method")).agg(F.count("*").alias("pages"), F.sum(n).cast("long").alias("chars"))


@query("method_label", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'text_clean' WHEN 3 THEN 'blank' ELSE 'ocr_clean' END AS value FROM documents")
def method_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.element_at(F.array(*map(F.lit, ("text", "ocr_full", "ocr_swap", "blank"))), F.expr("cast(doc_id % 4 + 1 as int)"))
    return base.table(spark, sf_dir, "documents").select("doc_id", F.when(m == "text", "text_clean").when(F.startswith(m, F.lit("ocr_")), "ocr_clean").otherwise(m).alias("value"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the pages' cleaned lines, with a carried section."""
    rows = base.lines(spark, sf_dir).where("doc_id >= 0").selectExpr("doc_id", "pos", "pos div 5 as page", "concat('S', pos div 10) as section", "line as text")
    return rows.withColumn("chunk_id", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_s1_c"), F.col("pos").cast("string")))


@query("merge_tiny", """WITH c AS (SELECT doc_id, pos // 5 AS page, 'S' || pos // 10 AS section, pos, {'chunk_id': 'p' || pos // 5 || '_s1_c' || pos, 'text': line} AS c FROM split_lines),
    r AS (SELECT doc_id, page, section, list_reduce(list([c] ORDER BY pos), lambda a, x: CASE WHEN length(x[1].text) < 200 OR length(a[-1].text) < 100 THEN a[:-2] || [{'chunk_id': a[-1].chunk_id, 'text': a[-1].text || chr(10) || x[1].text}] ELSE a || x END) AS l FROM c GROUP BY doc_id, page, section)
    SELECT doc_id, page, section, x.chunk_id AS chunk_id, x.text AS text, length(x.text) AS chars FROM (SELECT doc_id, page, section, unnest(l) AS x FROM r)""")
def merge_tiny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_tiny(page_chunks(spark, sf_dir).select("doc_id", "page", "section", "chunk_id", "text", "pos"))


@query("chunk_records", f"SELECT doc_id, pos // 5 AS page, 'Section: S' || pos // 10 || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS text FROM split_lines WHERE {o_strip('line')} <> '' GROUP BY doc_id, pos // 5, pos // 10")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each page and section, its lines in order under the section prefix."""
    rows = page_chunks(spark, sf_dir).where(T.strip(F.col("text")) != "").groupBy("doc_id", "page", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    return rows.select("doc_id", "page", F.concat(F.lit("Section: "), "section", F.lit("\n"), F.array_join(F.transform("l", lambda x: x.text), "\n")).alias("text"))


@query("prep_report", f"SELECT source, count(*) AS records, count(*) FILTER (length({o_strip('text')}) < 30) AS empty, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) - count(DISTINCT md5(text)) AS deduped FROM (SELECT source, coalesce(text, '') AS text FROM documents) GROUP BY source")
def prep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a preparation run by source."""
    docs = base.table(spark, sf_dir, "documents").select("source", F.coalesce("text", F.lit("")).alias("text"))
    return docs.groupBy("source").agg(F.count("*").alias("records"), F.count_if(F.length(T.strip(F.col("text"))) < 30).alias("empty"), F.sum(F.length("text")).cast("long").alias("chars"), (F.count("*") - F.count_distinct(F.md5(F.col("text").cast("binary")))).alias("deduped"))
