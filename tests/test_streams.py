"""Lifecycles over shuffled micro-batches against their batch forms; upserts that rewrite what they touch."""

import random

import pytest

from ashlar.operators import conversation
from ashlar.streaming import handoffs, lifecycles, upserts

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "event_id long, session_id long, action string, reason string, at_ms long"
JOBS = "event_id long, job_id long, status string, at_ms long"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def fed(spark, tmp_path, batches, schema):
    """A stream of the batches, one micro-batch each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    return query


def test_handoffs_of_shuffled_batches_equal_the_batch_form(rocks, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), rng.choice(["open", "open", "resolve"]), f"r{i % 3}", 100_000_000 + 1000 * rng.randrange(100)) for i in range(90)]
    shuffled = rng.sample(rows, len(rows))
    batches = [shuffled[i::4] + shuffled[:3] for i in range(4)]  # some rows come again and again
    batches += [[(999, 99, "open", "end", 200_000_000)], [(1000, 99, "open", "end", 200_000_001)]]  # time moves on
    source = fed(rocks, tmp_path, batches, EVENTS)
    run(lifecycles.handoff_lifecycle(source), "lifecycle", tmp_path)
    changes = rocks.table("lifecycle").where("session_id < 99")
    got = sorted((tuple(r) for r in handoffs.latest(changes).select("id", "reason", "status", "created_at", "resolved_at").collect()), key=str)
    want = conversation.handoff_state(rocks.createDataFrame(rows, EVENTS)).select("id", "reason", "status", "created_at", "resolved_at")
    assert got == sorted((tuple(r) for r in want.collect()), key=str) and len(got) > 10


def test_jobs_end_with_a_terminal_row_or_a_timeout(rocks, tmp_path):
    cap = lifecycles.CAP_MS
    first = [(2, 1, "done", 30), (1, 1, "running", 20), (3, 1, "late", 40), (5, 2, "running", 10)]
    second = [(0, 1, "queued", 10), (6, 2, "running", cap + 20), (7, 3, "queued", 50)]
    ahead = [[(900 + i, 9, "queued", 10 * cap + i)] for i in range(2)]
    stale = [[(8, 3, "done", 60)]]  # behind the watermark by then
    source = fed(rocks, tmp_path, [first, second, *ahead, *stale, [(950, 9, "queued", 20 * cap)]], JOBS)
    query = run(lifecycles.job_lifecycle(source), "jobs", tmp_path)
    got = sorted((r.job_id, r.at_ms, r.event_id, r.status) for r in rocks.table("jobs").where("job_id < 9").collect())
    assert got == [(1, 10, 0, "queued"), (1, 20, 1, "running"), (1, 30, 2, "done"), (2, 10, 5, "running"), (2, cap + 10, -1, "timeout"), (3, 50, 7, "queued"), (3, cap + 50, -1, "timeout")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 12  # what has ended is forgotten


ROWS = "key long, at long, value string, gone boolean"


def test_upserts_rewrite_what_a_batch_touches(spark, tmp_path):
    rng = random.Random(4)
    table = upserts.Upserts(str(tmp_path / "t"), "key", "at", deleted="gone", buckets=16)
    batches = [[(k, 1, f"v{k}", False) for k in range(400)]]
    batches += [[(rng.randrange(500), rng.randrange(4), f"n{i}{j}", rng.random() < 0.2) for j in range(3)] for i in range(3)]
    batches += [[(None, 1, "a", False), (None, 2, "b", False)], []]
    for i, rows in enumerate(batches):
        table.write(spark.createDataFrame(rows, ROWS), i)
        # deletions are forgotten with their row: what comes later begins anew, as in the plain form of what is held
        files = list((tmp_path / "t" / "rows" / f"version={i}").glob("bucket=*")) if rows else []
        assert i == 0 or len(files) <= len(rows)
    held = sorted(map(tuple, table.read(spark, ROWS).select("key", "at", "value", "gone").collect()), key=str)
    want, now = {}, {}
    for rows in batches:
        for key in {r[0] for r in rows}:
            best = max([r for r in rows if r[0] == key] + ([now[key]] if key in now else []), key=lambda r: (r[1], r[2], r[3]))
            now[key] = best
            if best[3]:
                del now[key]
    want = sorted(now.values(), key=str)
    assert held == want
    # a batch that comes again changes nothing, also if it says something else
    table.write(spark.createDataFrame([(1, 99, "again", False)], ROWS), 3)
    assert table.read(spark, ROWS).count() == len(want)
    table.forget(spark, keep=1)
    assert sorted(map(tuple, table.read(spark, ROWS).select("key", "at", "value", "gone").collect()), key=str) == want
    assert len(list((tmp_path / "t" / "state").glob("batch=*"))) == 1


def test_a_restarted_stream_goes_on_where_it_ended(spark, tmp_path):
    table = upserts.Upserts(str(tmp_path / "t"), "key", "at", buckets=4)
    for turn in range(2):
        spark.createDataFrame([(k, turn, f"v{turn}", False) for k in range(turn * 5, 10)], ROWS).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{turn}"))
        source = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = source.writeStream.foreachBatch(table.write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted((r.key, r.value) for r in table.read(spark, ROWS).collect()) == [(k, "v0" if k < 5 else "v1") for k in range(10)]
    assert upserts.Upserts(str(tmp_path / "none"), "key", "at").read(spark, ROWS).count() == 0
