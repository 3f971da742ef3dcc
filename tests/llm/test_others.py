import math
import random

import numpy as np
import pytest

from ashlar.llm import maxscore, sharding


def test_table_is_filled_in_turns():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    counts = [table.count(i) for i in range(7)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == 101
    # written out slot by slot
    asked, plain = [0] * 7, [-1] * 101
    start = [sharding._number(f"start:{s}") % 101 for s in names]
    step = [sharding._number(f"step:{s}") % 100 + 1 for s in names]
    i = 0
    while -1 in plain:
        while plain[(start[i] + asked[i] * step[i]) % 101] >= 0:
            asked[i] += 1
        plain[(start[i] + asked[i] * step[i]) % 101] = i
        i = (i + 1) % 7
    assert plain == table


def test_few_slots_change_when_a_shard_leaves():
    names = [f"s{i}" for i in range(16)]
    before, after = sharding.lookup_table(names, 4093), sharding.lookup_table(names[:-1], 4093)
    moved = sum(a != b for a, b in zip(before, after) if a != 15)
    assert moved < 0.25 * 4093
    heavy = sharding.lookup_table(names, 4093, {"s0": 3})
    assert heavy.count(0) > 2 * heavy.count(1)
    for bad in (100, 1):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 101)


def test_shards_of_rows(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, "z"), (7, None)], "doc_id long, shard string")
    names = ["a", "b", "c"]
    got = sharding.sharded(rows, "doc_id", names, 101).collect()
    assert len(got) == 5
    table = sharding.lookup_table(names, 101)
    for r in got:
        assert r.shard == names[table[r.slot]] and r.slot == int(__import__("hashlib").md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
    assert sharding.sharded(rows.limit(0), "doc_id", names, 101).count() == 0


def plain_top(rows, k, every):
    usable = []
    for key, v, *_ in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((key, [math.floor(1024 * x) for x in v]))
    out = []
    for i, (key, q) in enumerate(usable):
        if key is None or key % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), math.inf if other is None else other) for j, (other, v) in enumerate(usable) if j != i))
        out += [(key, r + 1, None if o == math.inf else o, -s) for r, (s, o) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_rows, sparse", [(8192, False), (40, False), (64, True)])
def test_top_k_is_exact(spark, shard_rows, sparse):
    rng = random.Random(9)
    value = lambda: 0.0 if sparse and rng.random() < 0.8 else rng.gauss(0.2 if sparse else 0, 1)
    rows = [(i, [value() for _ in range(12)], 1) for i in range(300)]
    rows += [(400 + i, rows[0][1], 1) for i in range(30)]  # ties
    rows += [(0, rows[0][1], 1), (None, rows[3][1], 2), (500, None, 1), (600, [1.0, None], 1), (700, [float("nan")] * 12, 1), (710, [float("inf")] * 12, 1), (720, [1.0, 2.0], 1), (730, [], 1), (2**63 - 1, rows[5][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(5)
    got = maxscore.top_k(table, k=10, every=10, shard_rows=shard_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_top(rows, 10, 10)


def test_few_candidates_and_no_rows(spark):
    rows = [(0, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in maxscore.top_k(table).collect()) == [(0, 1, 1, 1048576), (0, 2, 2, -1048576)]
    assert maxscore.top_k(table.limit(0)).count() == 0


def test_bounds_spare_most_postings():
    rng = np.random.default_rng(4)
    columns = np.round(rng.normal(size=(40, 20_000)) * (1000 * 0.7 ** np.arange(40))[:, None]).astype(np.int64)
    shard = maxscore.Shard(np.arange(20_000), np.zeros(20_000, bool), np.arange(20_000), columns)
    for query in range(20):
        at, score = shard.top(columns[:, query], query, 10)
        every = columns[:, query] @ columns
        every[query] = -(2**62)
        best = np.lexsort((np.arange(20_000), -every))[:10]
        assert at.tolist() == best.tolist() and score.tolist() == every[best].tolist()
    assert shard.touched < 0.6 * 20 * columns.size


def test_a_long_vector_and_only_queries(spark):
    rows = [(0, [0.5] * 5000), (100, [0.5] * 5000), (None, [0.5] * 5000)]
    got = maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.query_id, r["rank"], str(r.vec_id), r.score) for r in got) == [(0, 1, "100", 5000 * 512 * 512), (0, 2, "None", 5000 * 512 * 512), (100, 1, "0", 5000 * 512 * 512), (100, 2, "None", 5000 * 512 * 512)]
