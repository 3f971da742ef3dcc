import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ashlar.llm import kernel, simhash


def plain_fingerprint(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((k, f"{p:016x}", least.get(find(i))) for i, ((k, _), p) in enumerate(zip(rows, prints))), key=str)


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    texts = [None, "", " \t\n", "One", "one", "Two words", "a b c d", "x" * 40 + " " + "y" * 50]
    for _ in range(n):
        words = rng.choices(vocab, k=rng.randrange(1, 400))
        texts.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            near = list(words)
            near[rng.randrange(len(near))] = rng.choice(vocab)
            texts.append(("\n" if rng.random() < 0.5 else " ").join(near))
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[9]), (14, texts[9]), (14, texts[20])]


def test_fingerprints_match_the_plain_form():
    texts = [t for _, t in corpus()] + ["w " * 70000 + "end"]
    data, offsets = kernel.flat(pa.array(texts))
    got = simhash.fingerprints(data, offsets)
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("limit", [2048, 12])
def test_groups_match_all_pairs(spark, limit):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, fp string, root int")
    if limit < 2048:  # long runs: many fingerprints that share most bits
        docs = docs.limit(len(rows))
    got = simhash.near_duplicates(docs, limit=limit).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_groups(rows)


def test_long_runs_are_divided_not_dropped(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3, dtype=np.int64)
    fps = set()
    for b in base.tolist():
        for _ in range(150):
            x = b
            for bit in rng.integers(0, 40, rng.integers(1, 7)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    reps = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = [tuple(r) for r in simhash.near_links(reps, limit=16).collect()]
    root = {x: x for x in fps}

    def find(x, root):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        root[find(u, root)] = find(v, root)
    want = {x: x for x in fps}
    for i, u in enumerate(fps):
        for v in fps[:i]:
            if ((u ^ v) & (2**64 - 1)).bit_count() <= 3:
                want[find(u, want)] = find(v, want)
    same = lambda r: {(u, v) for u in fps for v in fps if find(u, r) == find(v, r)}
    assert same(root) == same(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(docs).count() == 0


def test_representatives_do_not_depend_on_how_a_second_scan_is_split(spark, tmp_path, monkeypatch):
    for i in range(16):
        rows = [(100 * i + j, f"word{i} is text number {j} of file {i} and no other") for j in range(3)]
        spark.createDataFrame(rows + [(9000 + i, rows[0][1])], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    written = simhash.keep

    def keep(df):
        out = written(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        return out

    monkeypatch.setattr(simhash, "keep", keep)
    try:
        got = [r.doc_id for r in simhash.representatives(docs, bits=0).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == [100 * i + j for i in range(16) for j in range(3)]


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 5000}x{i % 7}" for i in range(120_000))
    rows = [(4, text), (9, text.upper()), (5, "w1 w2")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4].fingerprint == got[9].fingerprint == f"{plain_fingerprint(text):016x}"
    assert got[9].component_id == 4 and got[5].component_id == 5
