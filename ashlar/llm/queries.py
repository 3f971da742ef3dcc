"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, html, langid, maxscore, packing, phrases, quality, rules, sharding, simhash, spelling, toxicity, whitening
from .common import table

SHARD_NAMES = [f"shard-{i:02d}" for i in range(sharding.SHARDS)]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.sharded(docs, "doc_id", SHARD_NAMES).select("doc_id", "slot", "shard")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_quality_classifier,
        op3_html_extraction,
        op4_packing,
        op5_sharding,
        op6_simhash_near_dedup,
        op7_quality_rules,
        op8_toxicity,
        op9_exact_topk_search,
        op10_bpe,
        op11_embedding_whitening,
        op12_document_fingerprints,
        op13_spelling_variants,
        pipeline,
    )
}

_SLOTS = sharding.lookup_table(SHARD_NAMES)

#: CRC-32 of a list of bytes in SQL, by the table of its rule.
_CRC = "(xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: xor(c >> 8, (" + str(spelling.CRC.tolist()) + "::BIGINT[])[xor(c, b) % 256 + 1])), 4294967295::BIGINT))"
_BYTES = "flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END))"

ORACLES: dict[str, str] = {
    "op13_spelling_variants": f"""
        WITH RECURSIVE runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
        ), said AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
        ), marked AS (SELECT run, n, {_CRC.format(bytes=_BYTES)} AS h FROM said
        ), spoiled AS (SELECT CASE WHEN h % {spelling.SPOILED} = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM marked
        ), words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoiled WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}
        ), cuts AS MATERIALIZED (SELECT word, i, left(word, CAST(i AS INTEGER)) || substring(word, CAST(i AS INTEGER) + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
        ), pairs AS MATERIALIZED (
            SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
            UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word
        ), ranked AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM pairs JOIN words ON word = b
        ), formed AS MATERIALIZED (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= {spelling.RATIO} * w.n THEN b END AS form, CASE WHEN r.n >= {spelling.RATIO} * w.n THEN r.n END AS form_n FROM words w LEFT JOIN ranked r ON a = word AND place = 1
        ), followed AS (SELECT word, word AS at, form AS onward FROM formed UNION ALL SELECT f.word, n.word, n.form FROM followed f JOIN formed n ON n.word = f.onward)
        SELECT f.word, f.form, l.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN followed l ON l.word = f.word AND l.onward IS NULL
    """,
    "op5_sharding": f"""
        WITH placed AS (
            SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::UBIGINT % {sharding.TABLE_SIZE} AS BIGINT) AS slot
            FROM documents
        )
        SELECT doc_id, slot, 'shard-' || lpad(CAST(({_SLOTS})[slot + 1] AS VARCHAR), 2, '0') AS shard FROM placed
    """,
    "op9_exact_topk_search": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS n
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
        ), scored AS (
            SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.n <> c.n
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
}
