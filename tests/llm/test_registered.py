from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from ashlar.llm import queries

DATA = Path("/root/testdata/sf0.001")
COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op3_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op6_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_exact_topk_search": ["query_id", "rank", "vec_id", "score"],
    "op11_embedding_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op12_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op13_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op10_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert sorted(n.split("_")[0] for n in queries.QUERIES if n != "pipeline") == sorted(f"op{i}" for i in range(1, 14))


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_whole_tables(spark, name):
    got = queries.QUERIES[name](spark, str(DATA))
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = got.count()
    if name.startswith(("op1_", "op2_", "op6_", "op7_", "op8_", "op10_", "op12_")):
        assert rows == spark.read.parquet(str(DATA / "documents.parquet")).count()
    assert rows > 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, str(DATA))
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in got.columns]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[i] for i in order) for r in found.fetchall())
