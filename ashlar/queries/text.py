"""Text operators over all documents and lines, with their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources import base


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def o_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def o_rstrip(x: str) -> str:
    return f"regexp_replace({x}, '\\s+$', '')"


def o_replace(x: str, table: dict[str, str]) -> str:
    for k, v in table.items():
        x = f"replace({x}, {q(k)}, {q(v)})"
    return x


def o_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def o_in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def on_texts(name: str, f: Callable[[Column], Column], oracle: str) -> None:
    @query(name, f"SELECT doc_id, {oracle} AS value FROM texts")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return base.texts(spark, sf_dir).select("doc_id", f(F.col("text")).alias("value"))


def on_lines(name: str, f: Callable[[Column], Column], oracle: str) -> None:
    @query(name, f"SELECT doc_id, pos, {oracle} AS value FROM doc_lines")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return base.lines(spark, sf_dir).select("doc_id", "pos", f(F.col("line")).alias("value"))


def _blank(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '\\n([^\\S\\n]*\\n)+', chr(10) || chr(10), 'g'), '^([^\\S\\n]*\\n)+', ''), '(^|\\n)\\s*$', '')"


def _cut_ocr(x: str) -> str:
    return f"(CASE WHEN contains({x}, '[OCR augment]') THEN {o_rstrip(f'split_part({x}, {q('[OCR augment]')}, 1)')} ELSE {x} END)"


_MARK = r"(?:^|\n)[^\S\n]*\[Table\s+[0-9]+\][^\S\n]*(?:\n|$)"


def _cut_table(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, {q(_MARK)}) THEN {o_rstrip(f'string_split_regex({x}, {q(_MARK)})[1]')} ELSE {x} END)"


_DEHYPHEN = "regexp_replace({}, '([A-Za-z0-9_])-\\n([a-z])', '\\1\\2', 'g')"

on_texts("clean_text", T.clean_text, _blank(_DEHYPHEN.format(o_replace(f"regexp_replace({_cut_table(_cut_ocr('text'))}, '[\\x{{E000}}-\\x{{F8FF}}]', ' ', 'g')", T.GLYPHS))))
on_texts("clean_basic", T.clean_basic, o_strip(f"regexp_replace(regexp_replace({o_replace('text', T.BASIC_GLYPHS)}, '[^\\S\\n]+\\n', chr(10), 'g'), '\\n\\n\\n+', chr(10) || chr(10), 'g')"))
on_texts("cut_ocr", T.cut_ocr, _cut_ocr("text"))
on_texts("cut_table", T.cut_table, _cut_table("text"))
on_texts("strip_pua", T.strip_pua, "regexp_replace(text, '[\\x{E000}-\\x{F8FF}]', ' ', 'g')")
on_texts("glyphs", T.glyphs, o_replace("text", T.GLYPHS))
on_texts("dehyphenate", T.dehyphenate, _DEHYPHEN.format("text"))
on_texts("blank_collapse", T.blank_collapse, _blank("text"))
on_texts("light_clean", T.light_clean, o_strip("regexp_replace(regexp_replace(replace(text, chr(65533), '±'), '\\.{8,}', '', 'g'), '\\n{4,}', chr(10) || chr(10), 'g')"))
_SECTION = "regexp_replace(text, '(?im)^Section:[^\\n]*\\n+', '', 'g')"
on_texts("strip_section", T.strip_section, o_strip(_SECTION))
on_texts("sanitize_section", T.sanitize_section, f"CASE WHEN length({o_strip('text')}) > 100 THEN '' ELSE {o_strip('text')} END")
_STRIPPED = o_strip(_SECTION)
on_texts("has_content", T.has_content, f"length({o_strip(f'regexp_replace({_STRIPPED}, {q("(?m)^[^\\S\\n]*[0-9]{1,4}[^\\S\\n]*$")}, {q("")}, {q("g")})')}) >= 30")
_O_DEPIPE = """
    CASE WHEN length(text) - length(replace(text, '|', '')) >= 3 * len(string_split(text, chr(10))) THEN
        regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x:
            CASE WHEN length(x) - length(replace(x, '|', '')) >= 2 THEN nullif(array_to_string(list_filter(list_transform(string_split(x, '|'), lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), lambda c: c <> ''), '; '), '') ELSE x END),
            lambda x: x IS NOT NULL), chr(10)), '[ \\t]{2,}', ' ', 'g')
    ELSE text END"""
on_texts("depipe", T.depipe, _O_DEPIPE)


def o_depipe(x: str) -> str:
    return "(" + re.sub(r"\btext\b", x, _O_DEPIPE) + ")"


on_texts("ground_norm", T.ground_norm, "regexp_replace(lower(text), '[\\s.\\-_/]+', '', 'g')")
on_texts("query_cache_key", T.query_key, o_strip("regexp_replace(lower(text), '\\s+', ' ', 'g')"))
on_texts("no_answer_ilike", T.no_answer_sql, "(" + " OR ".join(f"text ILIKE {q(p)}" for p in T.SQL_NO_ANSWER) + ")")
on_texts("no_answer_regex", T.no_answer_regex, f"regexp_matches(text, {q('(?i)(?:' + T.REGEX_NO_ANSWER + ')')})")
on_texts("ligature_fix", lambda c: T.phrase_fix(c, T.LIGATURE_DROPS), reduce(
    lambda x, k: f"regexp_replace(regexp_replace({x}, {q(rf'\b{k[0]}(?i:{k[1:]})\b')}, {q(T.LIGATURE_DROPS[k])}, 'g'), {q(rf'\b{k[0].upper()}(?i:{k[1:]})\b')}, {q(T.LIGATURE_DROPS[k].capitalize())}, 'g')",
    sorted(T.LIGATURE_DROPS, key=len, reverse=True), "text"))

on_lines("noise_lines", T.is_noise, f"({o_strip('line')} <> '' AND regexp_matches({o_strip('line')}, '^[^A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+$'))".replace("{{", "{").replace("}}", "}"))
on_lines("chrome_lines", T.is_chrome, f"regexp_matches(line, {q('(?i)' + T.CHROME)})")
on_lines("folio_lines", T.is_folio, f"regexp_matches(line, {q('(?i)' + T.FOLIO)})")
on_lines("descriptive", T.is_descriptive, f"length({o_strip('line')}) >= 25 AND regexp_matches(line, '[a-z]') AND len({o_words('line')}) >= 4")
_LOW = f"(' ' || lower({o_strip('line')}) || ' ')"
o_body_sentence = f"""({o_strip('line')} <> '' AND (len({o_words('line')}) > 8 OR (length({o_strip('line')}) > 55 AND len({o_words('line')}) > 6)
    OR {" OR ".join(f"contains({_LOW}, {q(m)})" for m in T.BODY_MARKERS)} OR coalesce(regexp_replace(lower({o_words('line')}[-1]), '^[,;:.]+|[,;:.]+$', '', 'g') IN {o_in(T.CONNECTORS)}, false)))"""
on_lines("body_sentence", T.is_body_sentence, o_body_sentence)
_UNIT_WORDS = f"list_transform({o_words('line')}, lambda w: regexp_replace(lower(w), '^[.:,;]+|[.:,;]+$', '', 'g'))"
o_unit_body = f"len({_UNIT_WORDS}) = 0 OR (len({_UNIT_WORDS}) <= 2 AND len(list_filter({_UNIT_WORDS}, lambda w: w NOT IN {o_in(T.UNITS)})) = 0)"
on_lines("unit_body", T.is_unit_body, o_unit_body)
on_lines("match_tokens", lambda c: F.array_join(T.match_tokens(c), "\x1f"), "array_to_string(list_filter(list_transform(regexp_split_to_array(lower(line), '[\\s,;:()/\\\\\\-]+'), lambda x: regexp_replace(x, '^[.''\"]+|[.''\"]+$', '', 'g')), lambda x: x <> ''), chr(31))")
_S = o_strip("line")
on_lines("ocr_quality", T.is_quality_ocr, f"""(length({_S}) >= 5
    AND length(regexp_replace({_S}, '[A-Za-z0-9\\x{{C0}}-\\x{{24F}}\\s.,:;\\-/&()''\\[\\]+%°×*#]', '', 'g')) * 5 <= length({_S})
    AND length(regexp_replace({_S}, '[^A-Za-z\\x{{C0}}-\\x{{24F}}]', '', 'g')) * 100 >= length({_S}) * 45
    AND (len(regexp_extract_all({_S}, '[A-Za-z]{{3,}}')) = 0 OR len(list_filter(regexp_extract_all({_S}, '[A-Za-z]{{3,}}'), lambda w: regexp_matches(w, '[aeiouyAEIOUY]'))) * 100 >= len(regexp_extract_all({_S}, '[A-Za-z]{{3,}}')) * 65)
    AND NOT regexp_matches({_S}, '(?i)[bcdfghjklmnpqrstvwxz]{{5,}}')
    AND len(list_filter(regexp_extract_all(lower({_S}), '[a-z]+'), lambda w: w IN {o_in(T.OCR_WORDS)})) > 0)""")
on_lines("norm_title", T.norm_title, "trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'))")
on_lines("norm_line", T.norm_line, "trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9_\\s\\x{80}-\\x{10FFFF}]', ' ', 'g'), '\\s+', ' ', 'g'))")
on_lines("clean_title", T.clean_title, "regexp_replace(line, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')")
_TITLE = "regexp_replace(line, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')"
on_lines("garbage_title", T.is_garbage_title, f"(length({_TITLE}) < 2 OR length(regexp_replace({_TITLE}, '[^A-Za-z0-9\\x{{C0}}-\\x{{24F}}]', '', 'g')) * 10 < length({_TITLE}) * 4)")
on_lines("image_title", T.image_title, "regexp_replace(regexp_replace(line, '\\s+', ' ', 'g'), '^[ .:;,\\-_|]+|[ .:;,\\-_|]+$', '', 'g')")
on_lines("alias_norm", T.alias_norm, f"replace(replace(replace(lower({_S}), '_', ''), '-', ''), ' ', '')")
on_lines("safe_user", T.safe_user, f"coalesce(nullif(regexp_replace({_S}, '[^A-Za-z0-9_.-]+', '_', 'g'), ''), 'default')")
o_heading_case = o_strip("array_to_string(list_transform(regexp_extract_all(line, '[^\\s/&\\-]+|[\\s/&\\-]'), lambda t: CASE WHEN length(t) <= 4 AND regexp_matches(t, '[A-Z]') AND upper(t) = t THEN t ELSE replace(upper(t[1]), 'ẞ', 'SS') || lower(t[2:]) END), '')")
on_lines("heading_case", T.heading_case, o_heading_case)
on_lines("sentence_header", lambda c: T.is_sentence_header(F.split(c, " ")), f"len(regexp_extract_all(lower(line), '[a-z'']+')) >= 4 AND len(list_filter(regexp_extract_all(lower(line), '[a-z'']+'), lambda w: w IN {o_in(T.FUNCTION_WORDS)})) >= 2")


@query("part_numbers", """SELECT doc_id, list_reduce(list_concat([text], regexp_extract_all(text, '\\b[A-Z]{1,3}[0-9][0-9A-Z\\s]{5,19}[0-9A-Z]')), lambda held, raw: CASE WHEN length(regexp_replace(raw, '\\s+', '', 'g')) BETWEEN 9 AND 18
    AND regexp_matches(regexp_replace(raw, '\\s+', '', 'g'), '^[A-Z]{1,3}[0-9]{3,}[0-9A-Z]*$') THEN replace(held, raw, replace(regexp_replace(raw, '\\s+', '', 'g'), 'O', '0')) ELSE held END) AS value FROM texts""")
def part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.texts(spark, sf_dir).select("doc_id", T.part_number_fix(F.col("text")).alias("value"))


@query("short_doc", """
    SELECT doc_id, left(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(f, '(?i)\\.pdf$', ''), '(?i)[_\\s-]*REV[-\\s]?[0-9]+', '', 'g'), '[_\\s-]*[0-9]{1,2}[-_.][0-9]{1,2}[-_.][0-9]{2,4}$', ''), '_', ' '), '^\\s+|\\s+$', '', 'g'), 36) AS value
    FROM (SELECT doc_id, 'Workshop_' || source || '_manual_REV-' || doc_id % 4 || '_01-02-202' || doc_id % 10 || '.pdf' AS f FROM documents)""")
def short_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("concat('Workshop_', source, '_manual_REV-', doc_id % 4, '_01-02-202', doc_id % 10, '.pdf')")
    return base.table(spark, sf_dir, "documents").select("doc_id", T.short_doc(name).alias("value"))


@query("s3_key_norm", "SELECT doc_id, array_to_string(list_filter(string_split(k, '/'), lambda s: s NOT IN ('', 'Data')), '/') AS value FROM (SELECT doc_id, '/Data/' || source || '//' || doc_id || '/Data.png' AS k FROM documents)")
def s3_key_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", T.s3_key_norm(F.expr("concat('/Data/', source, '//', doc_id, '/Data.png')")).alias("value"))


@query("s3_key", "SELECT doc_id, 'media/' || regexp_replace(source || '\\images\\' || doc_id || '.png', '\\\\', '/', 'g') AS value FROM documents")
def s3_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(r"concat('Data/', source, '\\images\\', doc_id, '.png')")
    relative = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^Data/", "")
    return base.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.lit("media"), relative).alias("value"))


@query("s3_url_parse", """
    SELECT page_id, regexp_extract(u, '^https://([^./]+)\\.s3', 1) AS bucket, regexp_extract(u, '^https://[^/]+/(.*)$', 1) AS key
    FROM (SELECT page_id, 'https://bkt' || page_id % 7 || '.s3.amazonaws.com/img/' || page_id || '.png' AS u FROM pages)""")
def s3_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and key of virtual-hosted and of path-style object addresses; null for other addresses."""
    u = base.table(spark, sf_dir, "pages").selectExpr("page_id", "concat('https://bkt', page_id % 7, '.s3.amazonaws.com/img/', page_id, '.png') as u")
    host, path = F.parse_url("u", F.lit("HOST")), F.regexp_replace(F.try_url_decode(F.parse_url("u", F.lit("PATH"))), "^/", "")
    hosted = host.rlike(r"^[^.]+\.s3[.-]")
    by_path = host.rlike(r"^s3[.-]")
    return u.select(
        "page_id",
        F.when(hosted, F.substring_index(host, ".", 1)).when(by_path, F.substring_index(path, "/", 1)).alias("bucket"),
        F.when(hosted, path).when(by_path, F.regexp_replace(path, "^[^/]*/", "")).alias("key"),
    )


@query("image_remap", "SELECT doc_id, '/api/images/' || source || '/pic%20' || doc_id || '.png' AS value FROM documents")
def image_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web addresses stay; other paths become percent-encoded segments under the image route."""
    path = F.expr(r"concat(source, '\\pic ', doc_id, '.png')")
    segments = F.transform(F.split(path, r"[/\\]"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")))
    mapped = F.concat(F.lit("/api/images/"), F.array_join(F.filter(segments, lambda s: s != ""), "/"))
    return base.table(spark, sf_dir, "documents").select("doc_id", F.when(path.rlike("(?i)^https?://"), path).otherwise(mapped).alias("value"))


@query("embed_input", "SELECT doc_id, left('[Doc: ' || source || ']' || chr(10) || coalesce(text, ''), 30000) AS value FROM documents")
def embed_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", T.embed_input(F.concat(F.lit("[Doc: "), F.col("source"), F.lit("]")), T.nz(F.col("text"))).alias("value"))


@query("context_header", "SELECT doc_id, '[' || concat_ws(' | ', 'Doc: ' || source, 'Vehicle: ' || vehicle, 'Type: ' || doc_type, 'Section: ' || nullif(section, 'General'), 'Page ' || page) || ']' AS value FROM matches")
def context_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of the fields that are present."""
    fields = [F.concat(F.lit("Doc: "), "source"), F.concat(F.lit("Vehicle: "), "vehicle"), F.concat(F.lit("Type: "), "doc_type"), F.concat(F.lit("Section: "), F.nullif(F.col("section"), F.lit("General"))), F.concat(F.lit("Page "), F.col("page").cast("string"))]
    return base.matches(spark, sf_dir).select("doc_id", F.concat(F.lit("["), F.concat_ws(" | ", *fields), F.lit("]")).alias("value"))


@query("exact_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM texts GROUP BY md5(regexp_replace(lower(text), '\\s+', ' ', 'g'))")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document and size of each group of equal normalised texts; only digests are shuffled."""
    key = F.md5(T.squash(F.lower("text")).cast("binary"))
    return base.texts(spark, sf_dir).groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("embed_cost", "SELECT count(*) AS records, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, round(sum(length(text) // 4) / 1000000.0 * 0.13, 6) AS cost FROM texts")
def embed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.sum(F.expr("length(text) div 4"))
    return base.texts(spark, sf_dir).agg(F.count("*").alias("records"), tokens.alias("tokens"), F.round(tokens / F.lit(1e6) * F.lit(0.13), 6).alias("cost"))
