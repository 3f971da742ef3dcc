"""Ingest, image, job and event operators over whole tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..registry import oracle_view, query
from ..sources import base

# orders as jobs, their lines as stages; documents as images on pages
oracle_view("stages", """SELECT l_orderkey AS job_id, l_linenumber AS pos, CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_returnflag = 'A' THEN 'skipped' WHEN l_linestatus = 'O' THEN 'done' ELSE 'running' END AS status,
    l_linenumber % 2 = 1 AS critical, CAST(l_partkey * 10 AS BIGINT) AS started, CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_partkey * 10 + l_suppkey END AS BIGINT) AS ended FROM lineitem""")
oracle_view("images", "SELECT doc_id AS image_id, doc_id // 8 AS page, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'part a' WHEN 2 THEN 'section b' ELSE 'x' || doc_id % 9 END AS title, md5('h' || doc_id % 23) AS hash, 40.0::DOUBLE + doc_id % 23 * 3 AS width, 30.0::DOUBLE + doc_id % 23 AS height FROM documents")
oracle_view("page_chunks", "SELECT doc_id AS chunk_id, doc_id // 8 AS page, doc_id % 8 AS pos, CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'text' END AS kind, CASE WHEN doc_id % 4 = 2 THEN 'section b' ELSE 'other' END AS section, CASE WHEN doc_id % 6 = 3 THEN ['part a', 'qty'] ELSE ['no'] END AS labels FROM documents")
oracle_view("rects", "SELECT doc_id AS id, doc_id // 8 AS page, (doc_id * 37 % 100)::DOUBLE AS x0, (doc_id * 53 % 100)::DOUBLE AS y0, (doc_id * 37 % 100 + 10 + doc_id % 30)::DOUBLE AS x1, (doc_id * 53 % 100 + 10 + doc_id % 20)::DOUBLE AS y1 FROM documents")


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as job_id", "l_linenumber as pos", "case when l_returnflag = 'R' then 'error' when l_returnflag = 'A' then 'skipped' when l_linestatus = 'O' then 'done' else 'running' end as status",
        "l_linenumber % 2 = 1 as critical", "l_partkey * 10 as started", "if(l_linenumber = 7, 0, l_partkey * 10 + l_suppkey) as ended",
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").selectExpr(
        "doc_id as image_id", "doc_id div 8 as page", "case doc_id % 5 when 0 then '' when 1 then 'part a' when 2 then 'section b' else concat('x', doc_id % 9) end as title",
        "md5(concat('h', doc_id % 23)) as hash", "40D + doc_id % 23 * 3 as width", "30D + doc_id % 23 as height",
    )


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").selectExpr(
        "doc_id as chunk_id", "doc_id div 8 as page", "doc_id % 8 as pos", "if(doc_id % 3 = 0, 'table', 'text') as kind", "if(doc_id % 4 = 2, 'section b', 'other') as section", "if(doc_id % 6 = 3, array('part a', 'qty'), array('no')) as labels",
    )


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").selectExpr("doc_id as id", "doc_id div 8 as page", "double(doc_id * 37 % 100) as x0", "double(doc_id * 53 % 100) as y0", "double(doc_id * 37 % 100 + 10 + doc_id % 30) as x1", "double(doc_id * 53 % 100 + 10 + doc_id % 20) as y1")


@query("bad_json_lines", "SELECT event_type, count(*) AS lines, count(*) FILTER (event_id % 7 = 0) AS bad, CAST(sum(CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS BIGINT) AS total FROM events GROUP BY event_type")
def bad_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which every seventh is broken: bad lines are counted, not fatal."""
    lines = base.table(spark, sf_dir, "events").selectExpr("event_type", "if(event_id % 7 = 0, concat('{', props), props) as line")
    parsed = lines.select("event_type", F.from_json("line", "k long, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("x"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("lines"), F.count("x._corrupt_record").alias("bad"), F.sum("x.k").alias("total"))


@query("resume_antijoin", "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 6 <> 3)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to embed: all but those whose id and content hash are done (every third; half of them with an old hash)."""
    records = base.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    done = records.where("doc_id % 3 = 0").selectExpr("doc_id", "if(doc_id % 6 = 3, 'old', hash) as hash")
    return I.remaining(records, done, ["doc_id", "hash"])


@query("upload_plan", "WITH f AS (SELECT 'img/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.png' AS key, doc_id % 4 = 0 AS there FROM documents) SELECT key, CASE WHEN there THEN 'skipped' WHEN sum(CASE WHEN there THEN 0 ELSE 1 END) OVER (ORDER BY key) <= 100 THEN 'uploaded' ELSE 'left' END AS outcome FROM f")
def upload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = base.table(spark, sf_dir, "documents").selectExpr("concat('img/', lpad(doc_id, 9, '0'), '.png') as key", "doc_id")
    return I.upload_plan(files.select("key"), files.where("doc_id % 4 = 0").select("key"), 100)


@query("job_retention", "SELECT l_orderkey AS job_id, l_linenumber AS pos, CASE WHEN l_linestatus = 'O' THEN 'error' ELSE l_linestatus END AS status FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, CASE WHEN l_linestatus = 'O' THEN 'error' ELSE l_linestatus END) AS n FROM lineitem) WHERE n <= 3")
def job_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three events of each job; active states become errors on load."""
    rows = base.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as job_id", "l_linenumber as pos", "if(l_linestatus = 'O', 'error', l_linestatus) as status")
    return I.newest(rows, ["job_id"], [F.desc("pos"), F.col("status")], 3)


@query("job_summary", "SELECT job_id, CAST(sum(CASE WHEN started > 0 AND ended > 0 THEN ended - started ELSE 0 END) AS BIGINT) AS elapsed, CASE WHEN bool_or(status = 'error' AND critical) THEN 'error' ELSE 'done' END AS status FROM stages GROUP BY job_id")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.job_summary(stages(spark, sf_dir))


@query("stage_elapsed", "SELECT job_id, pos, CASE WHEN started > 0 AND ended > 0 THEN ended - started ELSE 0 END AS elapsed FROM stages")
def stage_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages(spark, sf_dir).selectExpr("job_id", "pos", "if(started > 0 and ended > 0, ended - started, 0) as elapsed")


@query("job_health", "SELECT count(DISTINCT job_id) AS total, count(DISTINCT job_id) FILTER (status = 'running') AS running FROM stages")
def job_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in all and jobs with a running stage: one row a job before the totals."""
    jobs = stages(spark, sf_dir).groupBy("job_id").agg(F.bool_or(F.col("status") == "running").alias("running"))
    return jobs.agg(F.count("*").alias("total"), F.count_if("running").alias("running"))


@query("stage_progress", "SELECT job_id, CAST(round(100.0 * count(*) FILTER (status IN ('done', 'skipped')) / count(*)) AS BIGINT) AS percent FROM stages GROUP BY job_id")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages(spark, sf_dir).groupBy("job_id").agg(F.round(100 * F.count_if(F.col("status").isin("done", "skipped")) / F.count("*")).cast("long").alias("percent"))


@query("retry_skip", "WITH e AS (SELECT *, min(pos) FILTER (status = 'error') OVER (PARTITION BY job_id) AS bad, max(pos) OVER (PARTITION BY job_id) AS last FROM stages) SELECT job_id, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (pos < coalesce(bad, last)), '') AS skip FROM e GROUP BY job_id")
def retry_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages before the first error; all but the last if none failed."""
    rows = stages(spark, sf_dir).groupBy("job_id").agg(F.min(F.when(F.col("status") == "error", F.col("pos"))).alias("bad"), F.max("pos").alias("last"), F.array_sort(F.collect_list("pos")).alias("all"))
    skip = F.filter("all", lambda p: p < F.coalesce("bad", "last"))
    return rows.select("job_id", F.array_join(F.transform(skip, lambda p: p.cast("string")), ",").alias("skip"))


@query("recent_jobs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty jobs (the listing page)."""
    return base.table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderdate")


@query("events_after", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > 5")
def events_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events behind each stream's cursor of five."""
    return base.table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "row_number() over (partition by user_id order by event_id) as n").where("n > 5").drop("n")


@query("duration_fmt", "SELECT job_id, pos, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN ms // 1000 || '.' || (ms % 1000) // 100 || 's' ELSE ms // 60000 || 'm ' || (ms // 1000) % 60 || 's' END AS value FROM (SELECT job_id, pos, started * 7 AS ms FROM stages)")
def duration_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages(spark, sf_dir).select("job_id", "pos", I.duration_text(F.col("started") * 7).alias("value"))


@query("image_join", "SELECT image_id, chunk_id, CAST(match_class AS INTEGER) AS match_class FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY match_class, pos) AS n FROM (SELECT i.image_id, c.chunk_id, c.pos, CASE WHEN i.title <> '' AND c.kind = 'table' AND list_contains(c.labels, i.title) THEN 1 WHEN i.title <> '' AND c.section = i.title THEN 2 ELSE 3 END AS match_class FROM images i JOIN page_chunks c USING (page))) WHERE n = 1")
def image_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.image_targets(images(spark, sf_dir), page_chunks(spark, sf_dir))


@query("image_attach", "SELECT c.chunk_id, c.page, coalesce(array_to_string(i.l, ','), '') AS images FROM page_chunks c LEFT JOIN (SELECT chunk_id, list(image_id ORDER BY image_id) AS l FROM (SELECT image_id, image_id // 2 * 2 AS chunk_id FROM images) GROUP BY chunk_id) i ON i.chunk_id = c.chunk_id")
def image_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = images(spark, sf_dir).selectExpr("image_id div 2 * 2 as chunk_id", "image_id as pos", "image_id")
    rows = I.attached(page_chunks(spark, sf_dir).select("chunk_id", "page"), held)
    return rows.select("chunk_id", "page", F.array_join(F.transform("images", lambda x: x.cast("string")), ",").alias("images"))


@query("decorations", "SELECT image_id FROM images WHERE hash NOT IN (SELECT hash FROM images GROUP BY hash HAVING count(DISTINCT page) > 3 AND max(greatest(width, height)) < 80)")
def decorations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without the small ones that recur on many pages."""
    all_images = images(spark, sf_dir)
    return all_images.join(I.recurring_decorations(all_images), "hash", "left_anti").select("image_id")


@query("image_summary", "SELECT count(*) AS total, count(*) FILTER (title <> '') AS titled, round_even(count(*) / CAST(count(DISTINCT page) AS DOUBLE), 2) AS per_page FROM images")
def image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = images(spark, sf_dir).groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.col("title") != "").alias("t"))
    return pages.agg(F.sum("n").alias("total"), F.sum("t").alias("titled"), F.bround(F.avg("n"), 2).alias("per_page"))


@query("rect_overlap", "SELECT a.id, b.id AS other_id, round(share, 6) AS share FROM (SELECT a, b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS share FROM rects a JOIN rects b ON a.page = b.page AND a.id <> b.id) WHERE share > 0.2")
def rect_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rects(spark, sf_dir)
    return I.rect_overlaps(r, r, 0.2).where("id <> other_id")


@query("nearest_caption", """SELECT id, text_id, side, gap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, gap, text_id) AS n FROM (SELECT i.id, t.id AS text_id, CASE WHEN i.y0 - t.y1 BETWEEN 0 AND 60 THEN 0 WHEN t.y0 - i.y1 BETWEEN 0 AND 60 THEN 1 END AS side,
    CASE WHEN i.y0 - t.y1 BETWEEN 0 AND 60 THEN i.y0 - t.y1 ELSE t.y0 - i.y1 END AS gap FROM rects i JOIN rects t ON i.page = t.page WHERE i.id % 2 = 0 AND t.id % 2 = 1 AND least(i.x1, t.x1) - greatest(i.x0, t.x0) >= 0.2 * least(i.x1 - i.x0, t.x1 - t.x0)) WHERE side IS NOT NULL) WHERE n = 1""")
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rects(spark, sf_dir)
    return I.nearest_captions(r.where("id % 2 = 0"), r.where("id % 2 = 1"))


@query("pick_caption", "SELECT doc_id // 8 AS page, arg_max(c, (s, c)) AS caption FROM (SELECT doc_id, c, CAST(2.0 * length(regexp_replace(c, '[^A-Z]', '', 'g')) / greatest(length(regexp_replace(c, '[^A-Za-z]', '', 'g')), 1) AS DOUBLE) + CASE WHEN length(c) <= 60 THEN 1 ELSE 0 END AS s FROM (SELECT doc_id, coalesce(text, '') AS c FROM documents)) GROUP BY doc_id // 8")
def pick_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a page's candidate lines, the one with most capitals and a caption's length; ties to the larger text."""
    lines = base.table(spark, sf_dir, "documents").selectExpr("doc_id div 8 as page", "coalesce(text, '') as c")
    letters = F.length(F.regexp_replace("c", "[^A-Za-z]", ""))
    score = 2.0 * F.length(F.regexp_replace("c", "[^A-Z]", "")) / F.greatest(letters, F.lit(1)) + F.when(F.length("c") <= 60, 1).otherwise(0)
    return lines.groupBy("page").agg(F.max_by("c", F.struct(score.alias("s"), "c")).alias("caption"))


@query("ocr_title", "SELECT page, arg_min(id, (yc, -n, id)) AS id FROM (SELECT id, page, (y0 + y1) / 2 AS yc, id % 80 AS n FROM rects WHERE id % 10 >= 4 AND id % 80 BETWEEN 3 AND 80) GROUP BY page")
def ocr_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topmost confident line of a caption's length, the longer of equal ones."""
    lines = rects(spark, sf_dir).selectExpr("id", "page", "(y0 + y1) / 2 as yc", "id % 80 as n").where("id % 10 >= 4 and n between 3 and 80")
    return lines.groupBy("page").agg(F.min_by("id", F.struct("yc", -F.col("n"), "id")).alias("id"))


@query("image_tags", "SELECT query_id, string_agg(path, ',' ORDER BY id) AS urls FROM (SELECT query_id, path, min(n) AS id FROM (SELECT query_id, n, 'u' || n % 4 AS path FROM (SELECT doc_id // 10 AS query_id, doc_id % 10 AS n FROM documents) WHERE n <> 7) GROUP BY query_id, path) GROUP BY query_id")
def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image tags of answers resolved by a map: unknown ids and repeated addresses are dropped."""
    answers = base.table(spark, sf_dir, "documents").groupBy(F.expr("doc_id div 10").alias("query_id")).agg(F.array_sort(F.collect_list(F.expr("doc_id % 10"))).alias("n"))
    text = F.array_join(F.transform("n", lambda x: F.concat(F.lit("see [[SHOW_IMAGE: IMG_"), x.cast("string"), F.lit("]]"))), " ")
    known = F.expr("map_from_entries(transform(filter(sequence(0, 9), x -> x <> 7), x -> struct(concat('IMG_', x), concat('u', x % 4))))")
    urls = F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[SHOW_IMAGE: ([A-Z_0-9]+)\]\]"), F.lit(1)), lambda t: F.try_element_at(known, t)))
    return answers.select("query_id", F.array_join(F.array_distinct(urls), ",").alias("urls"))


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows by event type (the batch form of the stream in ``streaming.events``)."""
    from ..streaming.events import tumbling

    return tumbling(base.table(spark, sf_dir, "events"))


@query("events_session", """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events with gaps of at most six hours."""
    from ..streaming.events import sessions

    return sessions(base.table(spark, sf_dir, "events"))


@query("layout_text", """WITH b AS (SELECT *, x1 - x0 AS wide, (x0 + x1) / 2 AS middle, x1 - x0 <= 0.55 * width AS narrow, x1 - x0 > 0.70 * width AS banner FROM (SELECT *, CASE WHEN page % 3 = 0 THEN 40.0 ELSE 130.0 END AS width FROM rects)),
    p AS (SELECT *, count(*) FILTER (narrow) OVER w >= 4 AND count(*) FILTER (narrow AND middle < width / 2) OVER w >= 2 AND count(*) FILTER (narrow AND middle >= width / 2) OVER w >= 2 AS two_columns,
        2 * coalesce(count(*) FILTER (banner) OVER (PARTITION BY page ORDER BY y0, x0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN banner THEN 1 ELSE 0 END AS band FROM b WINDOW w AS (PARTITION BY page))
    SELECT page, id, two_columns, CAST(row_number() OVER (PARTITION BY page ORDER BY CASE WHEN two_columns THEN band ELSE 0 END, CASE WHEN two_columns AND NOT banner AND middle >= width / 2 THEN 1 ELSE 0 END, round(y0, 1), x0, id) AS INTEGER) AS place FROM p""")
def layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of page blocks: two columns where enough narrow blocks stand on both sides (every third page is too narrow)."""
    from ..operators.layout import reading_order

    return reading_order(rects(spark, sf_dir).withColumn("width", F.expr("if(page % 3 = 0, 40D, 130D)")))


@query("invisible_drawings", "SELECT doc_id, NOT (doc_id % 3 = 0) AND (doc_id % 2 = 0 OR (doc_id % 50) / 49.0 >= 0.98) AS value FROM documents")
def invisible_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings without stroke whose fill is missing or white."""
    stroke, fill = F.expr("doc_id % 3 = 0"), F.expr("if(doc_id % 2 = 0, null, array((doc_id % 50) / 49D, 1D))")
    return base.table(spark, sf_dir, "documents").select("doc_id", (~stroke & (fill.isNull() | F.coalesce(F.forall(fill, lambda c: c >= 0.98), F.lit(False)))).alias("value"))


@query("image_prefilter")
def image_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink statistics, verdict and crop of a raster of all of each document's bytes, 160 a row, white behind the last."""
    from ..operators.raster import judged

    data = F.coalesce("text", F.lit("")).cast("binary")
    white = F.expr("unhex(repeat('FF', cast(pmod(-octet_length(coalesce(text, '')), 160) as int)))")
    return judged(base.table(spark, sf_dir, "documents").select("doc_id", F.concat(data, white).alias("pixels"), F.lit(160).alias("width")))


@query("pipeline_stages", "SELECT job_id, pos, CASE WHEN coalesce(bool_or(status = 'error' AND critical) OVER (PARTITION BY job_id ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'pending' ELSE status END AS status FROM stages")
def pipeline_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of ingest runs' stages: behind a critical failure everything waits, other failures are passed over."""
    return I.stage_states(stages(spark, sf_dir))
