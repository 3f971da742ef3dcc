import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ashlar.llm import bpe, packing

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(2)
    pool = "abcABC ΣσςİıǅéÉ²½٣中文한́̀​\x1c\x1d\x85\xa0　'st'LL 'd😀\n\t!?_-ßẞﬁ"
    made = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(1500)]
    return made + ["ΟΔΟΣ", "<|endoftext|>Hi <|startoftext|><|ENDOFTEXT|>", "a" * 5000, "ab" * 3000, "  ", "'S 'Re", "'sabc's", "", " \n\n  x", "\n" * 3000]


def test_word_bpe_matches_the_library():
    own, theirs = bpe.WordBpe(WORD), Tokenizer.from_file(WORD)
    for text in odd_texts():
        want = theirs.encode(text, add_special_tokens=False)
        assert own.encode(text) == want.ids
        assert own.decode(want.ids) == theirs.decode(want.ids, skip_special_tokens=False)


def test_digests(docs, docs_rows, no_docs):
    theirs = Tokenizer.from_file(WORD)
    got = sorted(tuple(r) for r in bpe.digests(docs.where("doc_id is not null and doc_id % 6 = 0"), WORD).collect())
    want = []
    for key, text in {(r[0], r[1]) for r in docs_rows[0] if r[0] is not None and r[0] % 6 == 0}:
        e = theirs.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((key, len(e), sha(" ".join(map(str, e))), sha(theirs.decode(e, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.digests(no_docs, WORD).count() == 0


def test_ids_and_texts_in_spark(docs):
    some = docs.where("doc_id < 20")
    ids = bpe.token_ids(some, WORD)
    theirs = Tokenizer.from_file(WORD)
    want = {r.doc_id: theirs.decode(r.ids, skip_special_tokens=False) for r in ids.collect()}
    assert {r.doc_id: r.text for r in bpe.decoded(ids, WORD).collect()} == want


def test_small_word_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 10)
    texts = odd_texts()[:200]
    own, theirs = bpe.WordBpe(WORD), bpe.WordBpe(WORD)
    assert list(own.digest(texts)) == [next(theirs.digest([t])) for t in texts]


def test_byte_bpe_matches_the_library():
    own, theirs = packing.ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    for text in odd_texts():
        assert own.ids(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "histogram",
    [np.bincount(np.random.default_rng(0).integers(1, 2048, 9000), minlength=2048), np.bincount([1500] * 1000 + [7] * 3, minlength=2048), np.bincount([1], minlength=2048), np.zeros(2048, int), np.bincount([1024] * 11 + [512] * 7, minlength=2048)],
)
def test_plans_place_every_id_once(histogram):
    plan = packing.Plan(histogram.astype(np.int64))
    filled = defaultdict(list)
    for length in np.flatnonzero(histogram).tolist():
        for rank in range(histogram[length]):
            for sequence, offset, n in plan.place(length, rank):
                filled[sequence].append((offset, n))
    assert set(filled) == set(range(plan.sequences))
    for pieces in filled.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_combinations_use_most_remainders():
    histogram = np.bincount(np.random.default_rng(3).integers(1, 2048, 60000), minlength=2048).astype(np.int64)
    plan = packing.Plan(histogram)
    assert plan.combined * 2048 > 0.8 * (histogram * np.arange(2048)).sum()


@pytest.mark.parametrize("broadcast", [packing.BROADCAST_SHIFTS, 0])
def test_packing(docs, docs_rows, no_docs, broadcast, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_SHIFTS", broadcast)
    got = packing.packed(docs, BYTE, with_ids=True).collect()
    theirs = Tokenizer.from_file(BYTE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    texts = defaultdict(list)
    for r in docs_rows[0]:
        texts[r[0]].append(r[1])
    for key, values in texts.items():
        want = np.array(theirs.encode(values[0] or "", add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted(by_doc[key], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(values) * len(want)
        assert {r.doc_tokens for r in pieces} == {len(want)}
        for r in pieces:
            assert r.ids == want[r.start : r.start + r.length].tobytes()
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert packing.packed(no_docs, BYTE).count() == 0


def test_very_long_texts_are_encoded_whole(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    text = " ".join(f"Word{i % 977} runs, ({i})" for i in range(60_000))
    rows = [(1, text), (2, "x" * 200_000), (3, "short")]
    got = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    theirs = Tokenizer.from_file(path)
    for key, value in rows:
        ids = theirs.encode(value, add_special_tokens=False).ids
        assert got[key].n_tokens == len(ids) and got[key].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
