"""Boundary values, golden cases and properties of single operators."""

import random

import pytest
from pyspark.sql import functions as F

from ashlar.functions import frames, routing, scorers
from ashlar.functions import text as T
from ashlar.operators import conversation, ingest, layout, raster, retrieval, structure
from ashlar.sources import files
from ashlar.streaming import events, handoffs, upserts


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Front disc part number for the Bantam?", "standalone"), ("Bantam", "clarification"), ("is it ok", "standalone"), ("and for the rear?", "followup"), ("x" * 49, "clarification"), ("x" * 50, "standalone"),
        ("one two three four", "clarification"), ("one two three four five", "standalone"), ("left one?", "clarification"), ("the left one?", "standalone"), ("", "standalone"),
    ],
)
def test_message_classes(spark, text, kind):
    assert one(spark, text, routing.message_class) == kind


@pytest.mark.parametrize("raw, fixed", [("see T0208B VF0070N now", "see T0208BVF0070N now"), ("B0001017ON here", "B00010170N here"), ("A1 B2", "A1 B2"), ("plain text", "plain text")])
def test_part_numbers(spark, raw, fixed):
    assert one(spark, raw, T.part_number_fix) == fixed


@pytest.mark.parametrize("raw, clean", [("a-\nb", "ab"), ("a-\nB", "a-\nB"), ("x\n\n\n\ny\n", "x\n\ny"), ("t\n[OCR augment]\nz", "t"), ("", "")])
def test_clean_text_and_idempotence(spark, raw, clean):
    once = one(spark, raw, T.clean_text)
    assert once == clean
    assert one(spark, once, T.clean_text) == once


@pytest.mark.parametrize("n, k", [(6, 4), (7, 6), (14, 6), (15, 10)])
def test_dynamic_k(spark, n, k):
    assert one(spark, " ".join(["w"] * n), routing.dynamic_k) == k


def test_headings(spark):
    line = lambda x: one(spark, x, structure.numbered_heading)
    assert tuple(line("3.2 VALVE clearance")) == ("3.2", "Valve Clearance")
    assert line("2.5 Liter") is None
    assert line("3.1 The bolt needs to be tight") is None
    assert one(spark, "ENGINE OIL", structure.capital_heading) == "Engine OIL"
    assert one(spark, "NOTE", structure.capital_heading) is None


def test_frames_round_trip(spark):
    got = spark.sql("select 1").select(frames.decode(frames.encode(F.lit("token"), F.lit('{"token":"a"}'))).alias("f")).first().f
    assert (got.event, got.token) == ("token", "a")


@pytest.fixture(scope="module")
def matches(spark):
    rng = random.Random(1)
    rows = []
    for q in range(30):
        scores = sorted((rng.choice([0.0, 0.1, 0.3, 0.9]) for _ in range(rng.randrange(1, 9))), reverse=True)
        rows += [(q, r + 1, 100 * q + r, s, rng.choice(["a", "b", "c"]), rng.choice([None, "v", "w"])) for r, s in enumerate(scores)]
    return spark.createDataFrame(rows, "query_id long, rank long, doc_id long, score double, doc_type string, vehicle string").cache()


def by_query(df, column="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append(r[column])
    return out


def test_guards_never_empty_a_query(matches):
    everything = by_query(matches)
    for kept in (retrieval.vehicle_purity(matches, F.lit("v")), retrieval.score_floor(matches, 0.5, 2), retrieval.guarded(matches, F.lit(False))):
        found = by_query(kept)
        assert found.keys() == everything.keys()
        assert all(set(found[q]) <= set(everything[q]) for q in found)


def test_score_floor_keeps_a_minimum(matches):
    everything, found = by_query(matches), by_query(retrieval.score_floor(matches, 0.5, 2))
    assert all(len(found[q]) >= min(2, len(everything[q])) for q in everything)


def test_rounds_are_a_permutation_prefix(matches):
    everything, found = by_query(matches), by_query(retrieval.by_rounds(matches, F.array(F.lit("b")), 4))
    assert all(len(found[q]) == min(4, len(everything[q])) and len(set(found[q])) == len(found[q]) for q in everything)


def test_merge_unique_is_idempotent(matches):
    m = matches.select("query_id", "rank", "doc_id")
    once = retrieval.merged(m, m, "doc_id")
    assert sorted((r.query_id, r.doc_id) for r in once.collect()) == sorted((r.query_id, r.doc_id) for r in m.collect())


def test_min_score_applies_after_the_cut(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0], None)], "query_id long, query_vec array<double>, wanted string")
    c = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [0.0, 1.0], None), (3, [0.1, 1.0], "v")], "chunk_id long, vec array<double>, vehicle string")
    assert [r.chunk_id for r in retrieval.knn(q, c, 2, 0.5).collect()] == [1]


def test_history_and_handoffs(spark):
    m = spark.createDataFrame([(1, 1, "user", "a"), (2, 1, "user", "b"), (3, 1, "assistant", "c"), (4, 1, "assistant", "d"), (5, 1, "user", "e")], "id long, session_id long, role string, content string")
    assert [(r.question, r.answer) for r in conversation.history_pairs(m).collect()] == [("b", "c")]
    e = spark.createDataFrame([(1, 7, "open", "x", 10), (2, 7, "open", "y", 11), (3, 7, "resolve", "", 12), (4, 7, "open", "z", 13)], "event_id long, session_id long, action string, reason string, at_ms long")
    got = sorted(tuple(r) for r in conversation.handoff_state(e).select("id", "reason", "status", "resolved_at").collect())
    assert got == [(1, "x", "resolved", 12), (4, "z", "open", None)]


def test_streams_match_batches(spark, tmp_path):
    e = spark.createDataFrame([(i, i % 3, ["open", "resolve"][i * 7 % 5 % 2], "r", 1000 + i) for i in range(40)], "event_id long, session_id long, action string, reason string, at_ms long")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    run = handoffs.handoff_changes(source).writeStream.format("memory").queryName("handoff_log").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted(tuple(r) for r in handoffs.latest(spark.table("handoff_log")).select("id", "status", "resolved_at").collect())
    assert got == sorted(tuple(r) for r in conversation.handoff_state(e).select("id", "status", "resolved_at").collect())


def test_windows(spark):
    e = spark.sql("select timestamp_ntz'2024-01-01 01:00:00' as ts, 'a' as event_type, 1D as value, 1L as user_id union all select timestamp_ntz'2024-01-01 23:00:00', 'a', 2D, 1L")
    assert [(r.n, r.total) for r in events.tumbling(e).collect()] == [(2, 3.0)]
    assert len(events.sessions(e).collect()) == 2
    assert sum(r.n for r in events.sliding(e).collect()) == 8


def test_upload_plan_and_resume(spark):
    files_ = spark.createDataFrame([(f"k{i:03d}",) for i in range(20)], "key string")
    got = {r.key: r.outcome for r in ingest.upload_plan(files_, files_.where("key < 'k005'"), 3).collect()}
    assert [k for k, v in sorted(got.items()) if v == "uploaded"] == ["k005", "k006", "k007"]
    assert sum(v == "skipped" for v in got.values()) == 5


def test_stages_wait_behind_critical_failures(spark):
    rows = [(1, 0, "done", True), (1, 1, "error", False), (1, 2, "error", True), (1, 3, "done", True), (2, 0, "done", False)]
    got = ingest.stage_states(spark.createDataFrame(rows, "job_id long, pos int, status string, critical boolean"))
    assert [r.status for r in got.orderBy("job_id", "pos").collect()] == ["done", "error", "error", "pending", "done"]


def test_uploads_are_counted_over_all_ranges(spark):
    files_ = spark.createDataFrame([(f"k{(i * 7919) % 2000:05d}",) for i in range(2000)], "key string")
    got = sorted((r.key, r.outcome) for r in ingest.upload_plan(files_, files_.where("key like '%3'"), 700).collect())
    new = [k for k, o in got if not k.endswith("3")]
    assert [k for k, o in got if o == "uploaded"] == new[:700] and [k for k, o in got if o == "left"] == new[700:]


def test_breadcrumb_freshness(spark):
    h = spark.createDataFrame([(1, 0, 1, "3", "Engine"), (1, 1, 5, "3.1", "Valves"), (1, 2, 36, "3.1.3", "Shims")], "doc_id long, seq long, page long, number string, title string")
    assert [r.path for r in structure.breadcrumbs(h).orderBy("seq").collect()] == ["Engine", "Engine > Valves", "Shims"]


@pytest.mark.parametrize("runs, found", [(2, 0), (3, 1)])
def test_running_header_needs_three_pages(spark, runs, found):
    p = spark.createDataFrame([(1, i, "H" if i < runs else f"x{i}") for i in range(6)], "doc_id long, page long, line string")
    assert structure.running_header(p).count() == found


def test_tables(spark):
    t = spark.createDataFrame([(["", ""], [["1", ""], ["", ""], ["", ""]]), (["Part"], [["1"]]), (["", ""], [["a", "1"]])], "headers array<string>, rows array<array<string>>")
    assert [r.j for r in t.select(structure.is_junk_table(F.col("headers"), F.col("rows")).alias("j")).collect()] == [True, False, False]
    s = spark.createDataFrame([([["and in good co", "ndition"], ["the be", "aring is"], ["x", "y"]],), ([["A", "B"], ["C", "D"], ["E", "F"]],)], "rows array<array<string>>")
    assert [r.s for r in s.select(structure.has_word_splits(F.col("rows")).alias("s")).collect()] == [True, False]


def test_merge_tiny(spark):
    rows = [(1, 1, "S", f"c{i}", "x" * n, i) for i, n in enumerate((250, 50, 300, 99, 220))]
    got = structure.merge_tiny(spark.createDataFrame(rows, "doc_id long, page long, section string, chunk_id string, text string, pos int"))
    assert sorted(r.chars for r in got.collect()) == [220, 250 + 1 + 50, 300 + 1 + 99]


def test_layout_and_raster(spark):
    import numpy as np

    blocks = [(i, 1, x, y, x + 40, y + 5, 100.0) for i, (x, y) in enumerate([(0.0, 0.0), (50.0, 0.0), (0.0, 10.0), (50.0, 10.0)])]
    got = layout.reading_order(spark.createDataFrame(blocks, "id long, page long, x0 double, y0 double, x1 double, y1 double, width double"))
    assert [r.id for r in got.orderBy("place").collect()] == [0, 2, 1, 3]
    page = np.full((64, 64), 255, np.uint8)
    page[10:50, 10:50] = 0
    page = np.full((200, 300), 255, np.uint8)
    page[20:120, 30:140] = 0
    page[150:160, 50:58] = 0  # a glyph
    assert raster.measure(page) == (11000, 110, 100, 1.0) and raster.is_drawing(*raster.measure(page))
    page[:, 250:252] = np.where(np.arange(200) % 40 < 1, 0, 255)[:, None]
    assert raster.crop_box(page) == (0, 0, 300, 138)
    assert raster.trim_rows(page)[1] < 150
    assert raster.crop_box(np.zeros((100, 100), np.uint8)) == (0, 0, 100, 100) and raster.measure(np.zeros((0, 160), np.uint8)) == (0, 0, 0, 0.0)


def plain_components(mask):
    """Flood fill, pixel by pixel."""
    label, n = {}, 0
    points = {(y, x) for y, row in enumerate(mask) for x, v in enumerate(row) if v}
    for start in sorted(points):
        if start in label:
            continue
        stack = [start]
        while stack:
            y, x = stack.pop()
            if (y, x) in label or (y, x) not in points:
                continue
            label[y, x] = n
            stack += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        n += 1
    return label, n


@pytest.mark.parametrize("share", [0.05, 0.2, 0.35, 0.5, 0.9])
def test_components_match_a_flood_fill(share):
    import numpy as np

    mask = np.random.default_rng(3).random((60, 70)) < share
    (row, first, end), label = raster.components(mask)
    want, n = plain_components(mask)
    assert len(np.unique(label)) == n and int((end - first).sum()) == mask.sum()
    seen = {}
    for y, a, b, name in zip(row.tolist(), first.tolist(), end.tolist(), label.tolist()):
        assert {want[y, x] for x in range(a, b)} == {seen.setdefault(name, want[y, a])}
    wide = raster.dilated(mask, 2)
    assert all(wide[y, x] == mask[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].any() for y in range(60) for x in range(70))


def test_recognition_tables_are_whole():
    whole = "specific specifically specification specifications specified specifies confirm confirmed confirms confirmation configuration configurations configured confident confidence confidential define defined defines definition definitions identification identified identifies verified verifies verification modification modifications modified notification notifications notified classification classified qualification qualified rectification rectified rectifier amplifier amplification purification purified magnification magnified unified simplified simplification intensified satisfied satisfies notifier purifier humidifier intensifier amplifiers benefit benefits beneficial efficient efficiency sufficient sufficiently difficult difficulty efficacy official"
    want = {w.replace("fi", " ", 1): w for w in whole.split()} | {"speci fy": "specify", "trafc": "traffic"}
    assert T.LIGATURE_DROPS == want
    assert len(set(T.OCR_WORDS)) == 197 and {"yellow", "tools", "lubrication", "diagnostic", "specifications", "regulator", "maintenance", "components"} <= set(T.OCR_WORDS)


def test_lost_ligatures_keep_the_first_letter(spark):
    rows = spark.createDataFrame([("Speci cations are speci ed; DE NED, con rm the Trafc of cial bene ts",), ("air lter stays",)], "t string")
    assert [r.x for r in rows.select(T.phrase_fix(F.col("t"), T.LIGATURE_DROPS).alias("x")).collect()] == ["Specifications are specified; Defined, confirm the Traffic official benefits", "air lter stays"]


def test_nearest_chunks_match_a_plain_search(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 6))
    vectors[300:] = vectors[:100]  # ties
    facets = [None if i % 3 == 0 else "ab"[i % 2] for i in range(400)]
    chunks = spark.createDataFrame([(i, v.tolist(), f) for i, (v, f) in enumerate(zip(vectors, facets))] + [(900, None, None), (901, [0.0] * 6, None), (902, [1.0], None)], "chunk_id long, vec array<double>, vehicle string")
    queries = chunks.where("chunk_id % 20 = 0 or chunk_id > 800").selectExpr("chunk_id as query_id", "vec as query_vec", "vehicle as wanted")
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in retrieval.knn(queries, chunks, 7).collect())
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    want = []
    for i in range(0, 400, 20):
        score = np.round(unit @ unit[i], 12)
        open_ = [j for j in range(400) if j != i and (facets[i] is None or facets[j] in (None, facets[i]))]
        want += [(i, n + 1, j) for n, j in enumerate(sorted(open_, key=lambda j: (-score[j], j))[:7])]
    assert got == want


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","page":3}\n\nbad\n{"id":"2"}\n')
    good, bad = files.read_jsonl(spark, [str(tmp_path / "a.jsonl")] * 2)
    assert sorted((r.id, r.page) for r in good.collect()) == [("1", 3), ("2", None)]
    assert bad.count() == 1
    files.write_jsonl(good.select("id", "page"), str(tmp_path / "out"))
    assert sorted("page" in r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == [False, True]
    (tmp_path / "log.txt").write_text("Q: one\nA: first\n═════\nQ: two\nA: second\nline\n═════\n")
    assert [(r.question, r.answer) for r in files.read_chat_logs(spark, str(tmp_path / "log.txt")).orderBy("turn").collect()] == [("one", "first"), ("two", "second\nline")]
    turns = spark.createDataFrame([("u1", "how", "so\nand so"), ("u2", "why", "because")], "user string, question string, answer string")
    for n in (1, 2):
        files.append_chat_log(turns, str(tmp_path / "logs"))
        got = files.read_chat_logs(spark, str(tmp_path / "logs")).select("question", "answer").collect()
        assert sorted(map(tuple, got)) == sorted([("how", "so\nand so"), ("why", "because")] * n)
    (tmp_path / "doc.txt").write_text("page one\f\fpage three")
    spark.dataSource.register(files.PageSource)
    pages = spark.read.format("pages").options(path=str(tmp_path / "doc.txt"), pages="4", pagesPerTask="2").load()
    assert [(r.page, r.method) for r in pages.orderBy("page").collect()] == [(1, "text"), (2, "blank"), (3, "text"), (4, "error")]
    assert files.resumable(pages, pages.where("page < 3")).count() == 2


def test_scorers(spark):
    row = spark.createDataFrame([("oil filter", "the oil filter here")], "q string, t string").select(scorers.lexical_rerank(F.col("q"), F.col("t")).alias("s"), scorers.hashed_embedding(F.col("t")).alias("e"), scorers.fail_open(F.lit(None).cast("double")).alias("f")).first()
    assert row.s == 1.0 and row.f == 1.0 and abs(sum(x * x for x in row.e) - 1) < 1e-5


def test_session_and_job_streams(spark, tmp_path):
    m = spark.createDataFrame([(1, 10), (1, 30), (2, 20)], "session_id long, created_at long")
    m.coalesce(1).write.parquet(str(tmp_path / "in"))
    changes = handoffs.session_changes(spark.readStream.schema(m.schema).parquet(str(tmp_path / "in")))
    table = upserts.Upserts(str(tmp_path / "table"), "session_id", "updated_at")
    run = changes.writeStream.outputMode("update").foreachBatch(table.write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted(tuple(r) for r in table.read(spark, changes.schema).collect())
    assert got == [(1, 10, 30, 2), (2, 20, 20, 1)]
    e = spark.createDataFrame([(1, 0, "queued"), (1, 1, "running"), (1, 2, "done"), (1, 3, "late"), (2, 0, "queued")], "job_id long, seq long, status string")
    assert sorted((r.job_id, r.seq) for r in handoffs.job_stream(e, 0).collect()) == [(1, 1), (1, 2)]


def test_intents_have_directives_or_none(spark):
    from ashlar.functions import prompt

    assert one(spark, "procedure", prompt.directive).startswith("Answer") and one(spark, "general", prompt.directive) == ""


def test_structured_tables_keep_headers_that_could_be_promoted(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame([(252, "m", "de"), (384, "m", "es"), (1, "m", "en"), (10, "m", "fr"), (8, "m", "en")], "doc_id long, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["structure_table"]).fetchall()
    got = entry.queries()["structure_table"](spark, str(tmp_path)).select("doc_id", "headers", "rows").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r.doc_id: r.headers for r in got}[252] == "|"


def test_first_neighbours_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(i // 10, i, rng.choice("ab"), rng.randrange(8), rng.choice((None, "x", "y"))) for i in range(400)]
    m = spark.createDataFrame(rows + [(7, 70, "a", 3, "x"), (None, None, "a", 3, None)], "query_id long, doc_id long, source string, page long, vehicle string")
    seeds = m.where("doc_id % 10 = 0")
    all_ = sorted({(r.query_id, r.seed_id, r.doc_id) for r in retrieval.neighbours(seeds, m).collect()})
    for most in (1, 5, 18):
        ids = {}
        for query, seed, doc in all_:
            ids.setdefault((query, seed), []).append(doc)
        got = retrieval.neighbours(seeds, m, most=most)
        assert sorted({(r.query_id, r.seed_id, r.doc_id) for r in got.collect()}) == sorted((*k, d) for k, v in ids.items() for d in v[:most])
    # of a page and vehicle no more than the first are met: 3,000 rows of one page are not 3,000 pairs a match
    many = spark.range(3000).selectExpr("id div 10 as query_id", "id as doc_id", "'s' as source", "1L as page", "cast(null as string) as vehicle").cache()
    pairs = retrieval.neighbours(many.where("doc_id % 10 = 0"), many, most=18)
    assert pairs.count() == 300 * 18
    assert "WindowGroupLimit" in pairs._jdf.queryExecution().optimizedPlan().toString()
