"""Trace logs: blocks of text, replays, restarts, days."""

from datetime import date, datetime, timedelta

from ashlar.streaming import traces

START = datetime(2024, 3, 1, 23, 50)
CHUNK = (0.98765, "manual.pdf", 7, "Oil", "two\n  lines " + "x" * 300)
FULL = (1, START, "ann", "standalone", "Oil?", "engine oil", "model=a", 6, {"search": 12, "answer": None}, ["refine", None], [CHUNK, (None, None, None, None, None)], {"IMG_10": "b.png", "IMG_9": "a.png", "other": None}, "Drain it. \n", [("torque", "25 Nm")])
BARE = (2, START) + (None,) * 12

FULL_BLOCK = """[2024-03-01T23:50:00] user=ann class=standalone
Q: Oil?
search: engine oil
filter: model=a top_k: 6
times: answer=-ms search=12ms
steps:
  1. refine
  2. -
chunks: 2
  1. 0.9877 manual.pdf p.7 Oil
     two lines {}…
  2. - - p.- -
     
images:
  other = -
  IMG_9 = a.png
  IMG_10 = b.png
answer:
Drain it. 

grounding: FLAGGED
  ! torque: 25 Nm""".format("x" * 230)


def test_blocks_of_requests(spark):
    rows = {r.id: r for r in traces.request_log(spark.createDataFrame([FULL, BARE, (3, None) + (None,) * 12, (None, START) + (None,) * 12], traces.REQUEST)).collect()}
    assert rows["1"].block == FULL_BLOCK and rows["1"].day == date(2024, 3, 1)
    assert rows["2"].block == "[2024-03-01T23:50:00] user=- class=-\nQ: \nchunks: 0\nanswer:\n"
    assert len(rows) == 3 and "3" not in rows  # a row without a time is no trace, one without an id is one
    fine = FULL[:-1] + ([],)
    assert traces.request_log(spark.createDataFrame([fine], traces.REQUEST)).first().block.endswith("\ngrounding: OK")
    assert traces.request_log(spark.createDataFrame([], traces.REQUEST)).count() == 0


def test_blocks_of_stages(spark):
    rows = [(1, START, 5, "embed", "running", 0, None), (2, START, 5, "embed", "done", 12500, ""), (3, START, 5, "embed", "error", 850, "boom\nat line 3"), (4, START, None, None, "custom", None, "x")]
    found = [r.block for r in traces.stage_log(spark.createDataFrame(rows, traces.STAGE)).orderBy("id").collect()]
    head = "[2024-03-01 23:50:00] "
    assert found == [head + "START embed (job=5)", head + "DONE embed (12.5s) (job=5)", head + "ERROR embed (850ms) (job=5)\n    boom\n    at line 3", head + "CUSTOM - (job=-)\n    x"]


def test_replays_and_restarts_leave_each_trace_once(spark, tmp_path):
    def event(i, minutes):
        return (i, START + timedelta(minutes=minutes), i % 3, "embed", "done", 10 * i, None)

    turns = [[event(i, i) for i in range(12)], [event(i, i) for i in range(6, 20)], [event(3, 3), event(30, 30)]]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for turn, rows in enumerate(turns):  # the stream ends after each turn and goes on from its checkpoint
            spark.createDataFrame(rows + rows[:2], traces.STAGE).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{turn}"))
            source = spark.readStream.schema(traces.STAGE).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            query = traces.append(traces.once(traces.stage_log(source)), str(tmp_path / "log"), str(tmp_path / "ck")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    log = traces.read(spark, str(tmp_path / "log"))
    assert sorted(int(r.id) for r in log.collect()) == [*range(20), 30]
    assert sorted(int(r.id) for r in traces.read(spark, str(tmp_path / "log"), last="2024-03-01").collect()) == list(range(10))
    late = traces.read(spark, str(tmp_path / "log"), first="2024-03-02")
    assert late.count() == 11 and "PartitionFilters: [isnotnull(day" in late._jdf.queryExecution().toString()
