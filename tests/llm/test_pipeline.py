import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ashlar.llm import quality, simhash, toxicity

from .test_simhash import plain_groups


def test_stages_on_a_small_corpus(spark, docs, labels, tmp_path):
    clean = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")
    clean.unionByName(clean.selectExpr("doc_id + 5000 as doc_id", "concat(text, ' ') as text", "lang", "source", "n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.drop("text").write.parquet(str(tmp_path / "labels.parquet"))
    start = spark.read.parquet(str(tmp_path / "documents.parquet"))
    held = start
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        assert held.columns == start.columns, name
    kept = {r.doc_id for r in quality.quality_scores(start, labels).where("predicted = 1").collect()}
    rows = start.where(start.doc_id.isin(*kept))
    kept -= {r.doc_id for r in toxicity.toxicity_scores(rows, labels).where("predicted = 1").collect()}
    left = [(r.doc_id, r.text) for r in start.collect() if r.doc_id in kept]
    want = {g[2] for g in plain_groups(left)}
    got = [r.doc_id for r in held.collect()]
    assert sorted(got) == sorted(want)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(left)
    assert {r.doc_id for r in pieces} == want
    assert sum(r.length for r in pieces) == sum(len(theirs.encode(texts[k] or "", add_special_tokens=False).ids) + 1 for k in want)


def test_representatives_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, 8, 9), (2, "a b c d", 5, 6, 4)], "doc_id long, text string, _row int, kept int, fp int")
    assert [tuple(r) for r in simhash.representatives(docs).collect()] == [(1, "a b c d", 7, 8, 9)]


def test_representatives_of_ties_and_unknown_ids(spark):
    rows = [(None, "same text of a group"), (None, "same text of a group"), (4, "other text here now"), (4, "other text here now"), (9, "other text here now"), (None, "other text here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in simhash.representatives(docs).collect())
    assert got == [("4", "other text here now"), ("None", "same text of a group")]
    assert simhash.representatives(docs.limit(0)).count() == 0


def test_stages_on_odd_tables(spark, docs, labels, no_labels, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, row int, label int"
    rows = [(1, None, None, None, None, 1, 2, 3), (2, "", "en", "s", 0, 4, 5, 6), (None, "the house " * 40, None, "s", 1, 7, 8, 9), (3, "plain words " * 60_000, "en", "s", 1, 1, 1, 1), (3, "plain words " * 60_000, "en", "s", 1, 1, 1, 2)]
    odd, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, known in (("some", labels.drop("text")), ("no", no_labels.select("doc_id", "quality", "toxic"))):
        known.write.parquet(str(tmp_path / name / "labels.parquet"))
        for stage, function in corpus_pipeline.STAGES:
            for table in (odd, none):
                out = function(spark, table, str(tmp_path / name)).collect()
                if table is none:
                    assert out == []
                elif stage == "packing":
                    assert {r.doc_id for r in out} == {1, 2, 3, None} and sum(r.length for r in out if r.doc_id in (1, 2)) == 2
                elif stage == "near-dedup":
                    assert sorted(str(r.doc_id) for r in out) == ["1", "3", "None"]
                elif name == "no":
                    assert sorted(map(str, out)) == sorted(map(str, odd.collect()))
