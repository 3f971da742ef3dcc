"""Runs of the ingest: attempts of calls, uploads, traces of requests and stages, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attempts, uploads
from ..registry import oracle_view, query
from ..sources import base

# calls: orders; their attempts: lines in order, of which those still open succeed
CALL = "CASE WHEN l_returnflag = 'R' THEN 'Error code: 429, please try again in ' || CAST(l_quantity / 4 AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN 'ms' ELSE 's' END WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'Rate_Limit_Exceeded' WHEN l_returnflag = 'A' OR l_suppkey % 2 = 0 THEN 'connection reset' END"
oracle_view("call_attempts", f"SELECT l_orderkey AS call_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS attempt, l_partkey AS took_ms, {CALL} AS error FROM lineitem")
oracle_view("retries", """SELECT call_id, attempt, outcome, took_ms, wait_ms, CASE WHEN outcome <> 'unused' THEN CAST(coalesce(sum(took_ms + wait_ms) OVER (PARTITION BY call_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS begins_ms FROM (
    SELECT *, CASE WHEN outcome <> 'waits' THEN 0 WHEN contains(error, '429') THEN CAST(round(CAST(regexp_extract(error, 'in ([0-9.]+)', 1) AS DOUBLE) * CASE WHEN error LIKE '%ms' THEN 1 ELSE 1000 END + 1000) AS BIGINT) WHEN contains(lower(error), 'rate_limit') THEN 3000 * attempt ELSE 3000 END AS wait_ms FROM (
    SELECT *, CASE WHEN attempt > min(attempt) FILTER (error IS NULL) OVER (PARTITION BY call_id) THEN 'unused' WHEN error IS NULL THEN 'done' WHEN attempt = 5 THEN 'raised' ELSE 'waits' END AS outcome FROM call_attempts WHERE attempt <= 5))""")


def call_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, attempt, took_ms and error of every line of every order."""
    return base.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as call_id", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as attempt", "l_partkey as took_ms", f"{CALL.replace('VARCHAR', 'STRING')} as error"
    )


@query("retry_waits", "SELECT call_id, CAST(attempt AS INTEGER) AS attempt, outcome, took_ms, CAST(wait_ms AS BIGINT) AS wait_ms, begins_ms FROM retries")
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each attempt of a call begins and how long it waits: as a rate limit says, else by the attempt's number."""
    return attempts.schedule(call_attempts(spark, sf_dir))


@query("retry_calls", "SELECT call_id, count(*) AS attempts, arg_max(outcome, attempt) AS outcome, CAST(sum(wait_ms) AS BIGINT) AS waited_ms, CAST(sum(took_ms + wait_ms) AS BIGINT) AS total_ms FROM retries WHERE outcome <> 'unused' GROUP BY call_id")
def retry_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.calls(attempts.schedule(call_attempts(spark, sf_dir)))


# uploads: documents named by their first word, four a second; there already: the names of the Spanish ones
oracle_view("uploads", """SELECT doc_id AS upload_id, lang || '/' || regexp_extract(text, '[A-Za-z]+') || CASE lang WHEN 'fr' THEN '.PDF' WHEN 'de' THEN '.txt' ELSE '.pdf' END AS name,
    CAST(strlen(text) AS BIGINT) * 65536 AS bytes, make_timestamp(1704067200000000 + doc_id // 4 * 1000000) AS moment FROM documents""")


def upload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").selectExpr(
        "doc_id as upload_id", "lang || '/' || regexp_extract(text, '[A-Za-z]+', 0) || case lang when 'fr' then '.PDF' when 'de' then '.txt' else '.pdf' end as name",
        "cast(octet_length(text) as bigint) * 65536 as bytes", "timestamp_seconds(1704067200 + doc_id div 4) as at",
    )


@query("upload_guard", """WITH j AS (SELECT upload_id, regexp_replace(name, '^.*/', '') AS plain, moment, CASE WHEN name IS NULL OR NOT lower(name) LIKE '%.pdf' THEN 'not a pdf' WHEN coalesce(bytes, 0) <= 0 THEN 'empty' WHEN bytes > 209715200 THEN 'too large' ELSE 'accepted' END AS verdict FROM uploads),
    held AS (SELECT DISTINCT regexp_replace(name, '^.*/', '') AS plain FROM uploads WHERE name LIKE 'es/%'),
    k AS (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY moment, upload_id) AS n, row_number() OVER (PARTITION BY regexp_replace(plain, '(.)[.][^.]*$', '\\1'), moment ORDER BY upload_id) AS m, regexp_replace(plain, '(.)[.][^.]*$', '\\1') || strftime(moment, '_%Y%m%d_%H%M%S') AS stamp FROM j WHERE verdict = 'accepted')
    SELECT upload_id, verdict, CASE WHEN n = 1 AND plain NOT IN (FROM held) THEN plain WHEN m = 1 THEN stamp || '.pdf' ELSE stamp || '_' || upload_id || '.pdf' END AS file FROM k UNION ALL SELECT upload_id, verdict, NULL FROM j WHERE verdict <> 'accepted'""")
def upload_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that are taken, with the names they get beside those that are there."""
    rows = upload_rows(spark, sf_dir)
    there = rows.where("name like 'es/%'").select(F.substring_index("name", "/", -1).alias("name"))
    return uploads.admitted(rows, there)


# pictures: each document is a page of its source, each of its lines a caption with a raster below it, and in part a drawn figure
SPOT = "CAST(40 + n % 7 * 20 AS DOUBLE)"
oracle_view("picture_lines", "SELECT d.source, l.doc_id AS page, l.pos, l.line, length(l.line) AS n, length(regexp_extract(l.line, '[A-Za-z]+')) AS w, md5(regexp_extract(l.line, '[A-Za-z]+')) AS hash FROM split_lines l JOIN documents d USING (doc_id)")
oracle_view("page_rasters", """SELECT source, page, w AS xref, pos, 10 + 4 * w AS width, 12 + n AS height, 'png' AS ext, hash, CASE WHEN n % 11 <> 0 THEN 40.0::DOUBLE END AS x0, CASE WHEN n % 11 <> 0 THEN 100.0::DOUBLE * pos + 30 END AS y0, CASE WHEN n % 11 <> 0 THEN CAST(40 + 4 * w + n % 31 AS DOUBLE) END AS x1, CASE WHEN n % 11 <> 0 THEN CAST(100 * pos + 36 + 5 * w AS DOUBLE) END AS y1 FROM picture_lines""")
oracle_view("page_regions", f"SELECT source, page, {SPOT} AS x0, 100.0::DOUBLE * pos + 40 AS y0, {SPOT} + 30 AS x1, 100.0::DOUBLE * pos + 60 AS y1, md5('drawn' || n) AS hash FROM picture_lines WHERE n % 3 = 0")
oracle_view("pictures", """WITH best AS (SELECT *, min(pos) OVER (PARTITION BY page, xref) AS first, row_number() OVER (PARTITION BY page, xref ORDER BY (x1 - x0) * (y1 - y0) DESC NULLS LAST, pos) AS k FROM page_rasters WHERE width >= 24 AND height >= 24),
    e AS (SELECT source, page, 'embedded' AS kind, first AS pos, width, height, hash, x0, y0, x1, y1 FROM best WHERE k = 1 AND coalesce(x1 - x0 >= 24 AND y1 - y0 >= 24, true)),
    r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, y1, x1, hash) AS pos FROM page_regions g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page = g.page AND e.x0 IS NOT NULL AND greatest(least(e.x1, g.x1) - greatest(e.x0, g.x0), 0) * greatest(least(e.y1, g.y1) - greatest(e.y0, g.y0), 0) / ((g.x1 - g.x0) * (g.y1 - g.y0)) > 0.7::DOUBLE)),
    a AS (SELECT * FROM e UNION ALL SELECT source, page, 'rendered', pos, CAST(round(2 * (x1 - x0)) AS BIGINT), CAST(round(2 * (y1 - y0)) AS BIGINT), hash, x0, y0, x1, y1 FROM r),
    m AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY kind, pos, hash) AS number FROM a),
    k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM (SELECT source, hash FROM m GROUP BY source, hash HAVING count(DISTINCT page) > 3 AND max(coalesce(greatest(x1 - x0, y1 - y0), greatest(width, height) / 1.33)) < 80) d WHERE d.source = m.source AND d.hash = m.hash)),
    c AS (SELECT k.page, k.number, arg_min(l.line, (side, gap, l.pos)) AS line FROM k JOIN (SELECT page, pos, line, 100.0 * pos AS t0, 100.0 * pos + 12 AS t1, 40.0 + 2 * n AS x FROM picture_lines) l ON l.page = k.page,
        LATERAL (SELECT CASE WHEN k.y0 - t1 BETWEEN 0 AND 60 THEN 0 WHEN t0 - k.y1 BETWEEN 0 AND 60 THEN 1 END AS side, CASE WHEN k.y0 - t1 BETWEEN 0 AND 60 THEN k.y0 - t1 ELSE t0 - k.y1 END AS gap) WHERE side IS NOT NULL AND k.x0 IS NOT NULL AND least(k.x1, l.x) - greatest(k.x0, 40) >= 0.2 * least(k.x1 - k.x0, l.x - 40) GROUP BY ALL)
    SELECT source, page, number, 'page_' || page || '_img_' || number || '.png' AS file, coalesce(regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '^[ .:;,\\-_|]+|[ .:;,\\-_|]+$', '', 'g'), '') AS title, kind, width, height, hash, x0, y0, x1, y1 FROM k LEFT JOIN c USING (page, number)""")


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.manifest import manifest

    docs = base.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    word = F.regexp_extract("line", "[A-Za-z]+", 0)
    lines = docs.select("source", "page", F.col("pos").cast("long").alias("pos"), "line", F.length("line").cast("long").alias("n"), F.length(word).cast("long").alias("w"), F.md5(word.cast("binary")).alias("hash"))
    spot = SPOT.replace("CAST", "cast")
    rasters = lines.selectExpr("source", "page", "w as xref", "pos", "10 + 4 * w as width", "12 + n as height", "'png' as ext", "hash", "if(n % 11 <> 0, 40D, null) as x0", "100D * pos + 30 as y0", "double(40 + 4 * w + n % 31) as x1", "double(100 * pos + 36 + 5 * w) as y1")
    regions = lines.where("n % 3 = 0").selectExpr("source", "page", f"{spot} as x0", "100D * pos + 40 as y0", f"{spot} + 30 as x1", "100D * pos + 60 as y1", "md5(cast('drawn' || n as binary)) as hash")
    texts = lines.selectExpr("source", "page", "pos as id", "40D as x0", "100D * pos as y0", "40D + 2 * n as x1", "100D * pos + 12 as y1", "line as text")
    return manifest(rasters, regions, texts)


@query("image_manifest", "SELECT * FROM pictures")
def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters at their largest placements and figures that none covers, numbered, titled by captions, without recurring decorations."""
    return pictures(spark, sf_dir)


@query("manifest_pages", "SELECT source, page, count(*) AS n, string_agg(number || ':' || title, '|' ORDER BY number) AS listed FROM pictures GROUP BY source, page")
def manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' envelopes, as lists of numbers and titles."""
    from ..operators.manifest import envelopes

    pages = envelopes(pictures(spark, sf_dir))
    return pages.select("source", "page", F.size("images").cast("long").alias("n"), F.array_join(F.transform("images", lambda x: F.concat(x.number.cast("string"), F.lit(":"), x.title)), "|").alias("listed"))


@query("manifest_summary", "SELECT source, count(*) AS total, count(DISTINCT page) AS pages, count(*) FILTER (title <> '') AS titled, round_even(count(*) / CAST(count(DISTINCT page) AS DOUBLE), 2) AS per_page, count(*) FILTER (kind = 'embedded') AS embedded, count(*) FILTER (kind = 'rendered') AS rendered FROM pictures GROUP BY source")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.manifest import summary

    return summary(pictures(spark, sf_dir))


# traces: a request for each question of ranked matches, answered by its best one; stages as events a second apart
oracle_view("trace_rows", r"""SELECT query_id, arg_min(question, rank) AS question, arg_min(text, rank) AS answer, arg_min(source, rank) AS user, arg_min(page, rank) AS page, max(vehicle) FILTER (rank = 1) AS vehicle, max(rank) AS n,
    string_agg('  ' || rank || '. ' || printf('%.4f', score) || ' ' || source || ' p.' || page || ' ' || section || chr(10) || '     ' || CASE WHEN length(line) > 240 THEN left(line, 240) || '…' ELSE line END, chr(10) ORDER BY rank) AS chunks,
    string_agg('  IMG_' || rank || ' = ' || source || '/' || page || '.png', chr(10) ORDER BY rank) AS images FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM matches) GROUP BY query_id""")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of ``traces.REQUEST`` for every question of ``matches``."""
    found = F.struct("rank", "score", "source", "page", "section", "text", "question", "vehicle")
    asked = base.matches(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(found)).alias("m"))  # ten a question
    best = F.col("m")[0]
    images = F.map_from_entries(F.transform("m", lambda x: F.struct(F.concat(F.lit("IMG_"), x["rank"]), F.concat(x["source"], F.lit("/"), x["page"], F.lit(".png")))))
    unsupported = F.when(F.col("query_id") % 3 == 0, F.array().cast("array<struct<kind: string, value: string>>")).when(F.col("query_id") % 3 == 1, F.array(F.struct(F.lit("page").alias("kind"), best["page"].cast("string").alias("value"))))
    return asked.select(
        F.col("query_id").alias("request_id"), F.timestamp_seconds(F.lit(base.START_MS // 1000) + F.col("query_id") * 3600).alias("at"), best["source"].alias("user"), F.lit("standalone").alias("class"), best["question"].alias("question"),
        F.lower(best["question"]).alias("search"), best["vehicle"].alias("filter"), F.size("m").alias("top_k"), F.expr("map('retrieve', query_id * 7, 'answer', query_id)").alias("timings_ms"),
        F.array(F.lit("retrieve"), F.lit("rank")).alias("steps"), F.transform("m", lambda x: F.struct(*[x[c].alias(c) for c in ("score", "source", "page", "section", "text")])).alias("matches"), images.alias("images"), best["text"].alias("answer"), unsupported.alias("unsupported"),
    )


@query("request_traces", f"""SELECT CAST(query_id AS VARCHAR) AS id, CAST(moment AS DATE) AS day, '[' || strftime(moment, '%Y-%m-%dT%H:%M:%S') || '] user=' || user || ' class=standalone' || chr(10) || 'Q: ' || question || CASE WHEN trim(lower(question)) <> trim(question) THEN chr(10) || 'search: ' || lower(question) ELSE '' END
    || chr(10) || 'filter: ' || coalesce(vehicle, '-') || ' top_k: ' || n || chr(10) || 'times: answer=' || query_id || 'ms retrieve=' || query_id * 7 || 'ms' || chr(10) || 'steps:' || chr(10) || '  1. retrieve' || chr(10) || '  2. rank' || chr(10) || 'chunks: ' || n || chr(10) || chunks || chr(10) || 'images:' || chr(10) || images
    || chr(10) || 'answer:' || chr(10) || rtrim(answer) || CASE query_id % 3 WHEN 0 THEN chr(10) || 'grounding: OK' WHEN 1 THEN chr(10) || 'grounding: FLAGGED' || chr(10) || '  ! page: ' || page ELSE '' END AS block FROM (SELECT *, make_timestamp({base.START_MS}000 + query_id * 3600000000) AS moment FROM trace_rows)""")
def request_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's block of the trace log, with the day it is kept under."""
    from ..streaming.traces import request_log

    return request_log(requests(spark, sf_dir)).select("id", "day", "block")


@query("stage_traces", f"""SELECT job_id, pos, '[' || strftime(make_timestamp({base.START_MS}000 + started * 1000), '%Y-%m-%d %H:%M:%S') || '] ' || CASE status WHEN 'running' THEN 'START' WHEN 'done' THEN 'DONE' WHEN 'skipped' THEN 'SKIP' ELSE 'ERROR' END || ' stage ' || pos
    || CASE WHEN ended > started AND ended - started < 1000 THEN ' (' || (ended - started) || 'ms)' WHEN ended > started THEN ' (' || (ended - started) // 1000 || '.' || (ended - started) % 1000 // 100 || 's)' ELSE '' END || ' (job=' || job_id || ')' || CASE WHEN status = 'error' THEN chr(10) || '    failed' || chr(10) || '    at ' || pos ELSE '' END AS block FROM stages""")
def stage_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace log's line of every stage of every job."""
    from ..streaming.traces import stage_block
    from .ingest import stages

    made = stages(spark, sf_dir).selectExpr("job_id", "pos", f"timestamp_millis({base.START_MS} + started) as at", "'stage ' || pos as stage", "status", "if(ended > started, ended - started, 0) as elapsed_ms", "if(status = 'error', concat('failed\\nat ', pos), null) as detail")
    return made.select("job_id", "pos", stage_block().alias("block"))


# jobs: customers' users by their first event; commands: every event of a user, by its type
oracle_view("user_jobs", "SELECT user_id AS job_id, CASE WHEN first % 3 = 0 THEN 'done' WHEN first % 3 = 1 THEN 'running' ELSE 'queued' END AS status, 'f' || first AS file FROM (SELECT user_id, min(event_id) AS first FROM events WHERE event_type <> 'error' GROUP BY user_id)")
oracle_view("job_commands", "SELECT event_id AS command_id, user_id + event_id % 2 AS job_id, CASE event_type WHEN 'error' THEN 'cancel' WHEN 'purchase' THEN 'delete' WHEN 'signup' THEN 'retry' ELSE 'look' END AS action, epoch_us(ts) // 1000 AS at_ms FROM events")
oracle_view("obeyed_commands", """WITH m AS (SELECT c.*, j.status, status IN ('queued', 'running') AS active, min((at_ms, command_id)) FILTER (action = 'cancel') OVER (PARTITION BY c.job_id) AS c0 FROM job_commands c LEFT JOIN user_jobs j USING (job_id)),
    d AS (SELECT *, NOT active OR coalesce((at_ms, command_id) > c0, false) AS ended FROM m), g AS (SELECT *, min((at_ms, command_id)) FILTER (action = 'delete' AND ended) OVER (PARTITION BY job_id) AS d0 FROM d)
    SELECT command_id, job_id, action, CASE WHEN status IS NULL OR coalesce((at_ms, command_id) > d0, false) THEN 'unknown' WHEN action = 'cancel' THEN CASE WHEN active AND (at_ms, command_id) = c0 THEN 'cancelled' ELSE 'nothing to cancel' END WHEN action = 'delete' THEN CASE WHEN ended THEN 'deleted' ELSE 'refused' END WHEN action = 'retry' THEN 'queued' ELSE 'unknown' END AS outcome FROM g""")


def job_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Jobs and the commands to them."""
    events = base.table(spark, sf_dir, "events")
    first = events.where("event_type <> 'error'").groupBy(F.col("user_id").alias("job_id")).agg(F.min("event_id").alias("first"))
    jobs = first.selectExpr("job_id", "case when first % 3 = 0 then 'done' when first % 3 = 1 then 'running' else 'queued' end as status", "'f' || first as file")
    return jobs, events.selectExpr("event_id as command_id", "user_id + event_id % 2 as job_id", "case event_type when 'error' then 'cancel' when 'purchase' then 'delete' when 'signup' then 'retry' else 'look' end as action", "unix_millis(cast(ts as timestamp)) as at_ms")


@query("job_commands", "SELECT *, CASE WHEN outcome = 'queued' THEN job_id || '-r-' || command_id END AS new_id FROM obeyed_commands")
def job_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cancel, retry and delete of a job does."""
    from ..operators.jobs import obeyed

    return obeyed(*job_rows(spark, sf_dir))


@query("jobs_after", """SELECT CAST(job_id AS VARCHAR) AS job_id, CASE WHEN job_id IN (SELECT job_id FROM obeyed_commands WHERE outcome = 'cancelled') THEN 'cancelled' ELSE status END AS status, file FROM user_jobs WHERE job_id NOT IN (SELECT job_id FROM obeyed_commands WHERE outcome = 'deleted')
    UNION ALL SELECT o.job_id || '-r-' || o.command_id, 'queued', j.file FROM obeyed_commands o JOIN user_jobs j USING (job_id) WHERE outcome = 'queued'""")
def jobs_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs that are there when all commands were obeyed."""
    from ..operators.jobs import after, obeyed

    jobs, commands = job_rows(spark, sf_dir)
    return after(jobs, obeyed(jobs, commands))


@query("png_rasters", r"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 160 END AS width, (strlen(coalesce(text, '')) + 159) // 160 * 160 AS bytes, CAST(length(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g')) AS BIGINT) AS dark, coalesce(text, '') <> '' AS decoded FROM documents UNION ALL SELECT -1 - doc_id, 0, 0, 0, false FROM documents")
def png_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of all bytes of each document, 160 a row, written as PNG files and read back (dark: bytes below 128), and its text itself, which is no such file."""
    from ..operators import png

    docs = base.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    white = F.expr("unhex(repeat('FF', cast(pmod(-octet_length(text), 160) as int)))")
    files = png.written(docs.select("doc_id", F.concat(F.col("text").cast("binary"), white).alias("pixels"), F.lit(160).alias("width")), "doc_id")
    texts = docs.select((-1 - F.col("doc_id")).alias("doc_id"), F.col("text").cast("binary").alias("content"))
    read = png.rasters(files.unionByName(texts), "doc_id")
    dark = F.length(F.regexp_replace(F.decode("pixels", "ISO-8859-1"), r"[^\x00-\x7F]", ""))
    return read.select("doc_id", "width", F.coalesce(F.octet_length("pixels"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(dark, F.lit(0)).cast("long").alias("dark"), F.col("error").isNull().alias("decoded"))
