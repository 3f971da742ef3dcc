"""Places over ranges against a sorted list, with a value that most rows share and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from ashlar.operators.ranking import counted, ranged


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_places_equal_a_sorted_list(spark, descending, kind):
    rng = random.Random(9)
    value = (lambda: rng.choice([7, 7, 7, 7, None, rng.randrange(50)])) if kind == "long" else (lambda: rng.choice(["m", "m", None, "", "é", f"k{rng.randrange(30)}"]))
    rows = [(i, value(), rng.choice([None, i % 5, i]), rng.random() < 0.6) for i in range(4000)]
    frame = spark.createDataFrame(rows, f"id long, v {kind}, t long, ok boolean")
    ties = [F.col("t"), F.col("id")]
    low = lambda x: (x is not None, x if x is not None else (0 if kind == "long" else ""))
    order = sorted(rows, key=lambda r: (low(r[2]), r[0]))
    order.sort(key=lambda r: low(r[1]), reverse=descending)  # stable: ties stay in order
    want, n = {}, 0
    for i, _, _, ok in order:
        n += ok
        want[i] = n
    found = counted(frame, F.col("v"), ties, F.col("ok"), "place", descending)
    assert {r.id: r.place for r in found.collect()} == want and set(found.columns) == {"id", "v", "t", "ok", "place"}
    sizes = [r["count"] for r in ranged(frame, F.col("v"), ties, descending).groupBy("_range").count().collect()]
    assert max(sizes) <= 20 and sum(sizes) == 4000  # the common value is many ranges


def test_no_rows_and_no_ties(spark):
    frame = spark.createDataFrame([], "id long, v long")
    assert counted(frame, F.col("v"), [], F.lit(True), "place").count() == 0
    some = spark.createDataFrame([(1, None), (2, 5), (3, 4)], "id long, v long")
    assert {r.id: r.place for r in counted(some, F.col("v"), [], F.lit(True), "place").collect()} == {1: 1, 3: 2, 2: 3}
    assert {r.id: r.place for r in counted(some, F.col("v"), [], F.lit(True), "place", descending=True).collect()} == {2: 1, 3: 2, 1: 3}


def test_learned_lookup_searches_all_stored_questions(spark, tmp_path):
    from ashlar import queries, registry

    queries.load()
    rows = [(0, [1.0, 0.0], 1), (50, [0.0, 1.0], 2), (7, [0.99, 0.01], 3), (8, [0.5, 0.5], 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(0, "en")], "doc_id long, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.query_id: (r.chunk_id, r.hit) for r in registry.QUERIES["learned_lookup"](spark, str(tmp_path)).collect()}
    assert got == {0: (1_000_007, True), 50: (1_000_050, True)}  # row 7, of an odd label, is the nearest of 0
