import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from ashlar.llm import kernel, nearcopies


def plain_set(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(least.values())


def edited(rng, words, share):
    """A copy that shares about ``share`` of its shingles: new words at the end."""
    n = round(len(words) * (1 - 2 * share / (1 + share)))
    return words[: len(words) - n] + [f"new{rng.random()}" for _ in range(n)]


def planted(seed=5, groups=40):
    rng = random.Random(seed)
    rows, pairs = [(9001, None), (9002, ""), (9003, " \n"), (9004, "Few words"), (9005, "few\nwords")], []
    for g in range(groups):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(120, 400))]
        rows.append((10 * g, " ".join(words)))
        for i, share in enumerate((0.6, 0.82, 0.88, 0.95)):
            rows.append((10 * g + i + 1, " ".join(edited(rng, words, share))))
            if share > 0.8:
                pairs.append(10 * g + i + 1)
    return rows, pairs


def test_shingle_sets_match_the_plain_form():
    rows, _ = planted(groups=4)
    texts = [t for _, t in rows] + ["a b a b a b a b a", "x " * 50]
    data, offsets = kernel.flat(pa.array(texts))
    hashed, bounds = nearcopies.shingle_sets(data, offsets)
    assert np.diff(bounds).tolist() == [len(plain_set(t)) for t in texts]
    whole = [set(hashed[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    assert len(whole[5] & whole[7]) == len(plain_set(texts[5]) & plain_set(texts[7]))


def test_edited_copies_do_not_survive_the_stage(spark):
    rows, copies = planted()
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, _row int")
    kept = corpus_pipeline.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.collect())
    assert got == plain_kept(rows)
    assert not set(got) & set(copies)


def test_a_large_group_is_connected_and_others_stay(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(4000)}" for _ in range(200)]
    rows = [(i, " ".join(words[:190] + [f"n{i}x{j}" for j in range(10)])) for i in range(400)]
    rows += [(1000 + i, " ".join(words[:120] + [f"o{i}x{j}" for j in range(80)])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.representatives(docs).collect()) == [0, *range(1000, 1100)]


def test_ties_unknown_ids_and_no_rows(spark):
    rows = [(None, "same text of a group"), (None, "same text of a group"), (4, "other text here now"), (4, "other text here now"), (None, "other text here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in nearcopies.representatives(docs).collect())
    assert got == [("4", "other text here now"), ("None", "same text of a group")]
    assert nearcopies.representatives(docs.limit(0)).count() == 0


def test_randomly_edited_copies_are_grouped_as_by_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for g, copies in ((0, 260), (1, 60), (2, 3)):
        base = [f"g{g}w{i}" for i in range(150)]
        for i in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 5, 7])):
                words[rng.randrange(150)] = f"x{rng.random()}"
            rows.append((1000 * g + i, " ".join(words)))
    rows += [(9000 + i, " ".join(f"g0w{j}" for j in range(i, 150 - i))) for i in range(0, 30, 2)]  # of other sizes
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in nearcopies.representatives(docs).collect())
    assert got == plain_kept(rows)


def alike(rng, n, shared=0):
    """Texts of one template that resemble each other just too little: some words of each are its own, or of few (``shared``)."""
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in (20, 60, 100, 140, 198):
            words[at] = f"s{at}x{rng.randrange(shared)}" if shared else f"u{i}x{at}"
        rows.append((i, " ".join(words)))
    return rows


def test_alike_texts_are_dismissed_by_counting(spark, monkeypatch):
    rng = random.Random(1)
    made = []
    inner = nearcopies.keep
    monkeypatch.setattr(nearcopies, "keep", lambda df: made.append(inner(df)) or made[-1])
    for n in (150, 300):
        made.clear()
        docs = spark.createDataFrame(alike(rng, n), "doc_id long, text string").repartition(3)
        assert nearcopies.representatives(docs).count() == n
        sizes = {tuple(d.columns): d.count() for d in made}
        assert sizes[("key", "node", "root", "block", "i", "j")] == 0  # nothing is left to compare
        assert sizes[("a", "b")] <= 20 * n and sizes[("u", "v")] == 0
        assert all(rows <= 33 * n for rows in sizes.values())


def test_alike_texts_that_share_their_own_words_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = alike(rng, 160, shared=400)
    rows += [(1000 + i, t + " tail") for i, (_, t) in enumerate(rows[:30])]
    monkeypatch.setattr(nearcopies, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(nearcopies, "BROADCAST_ROWS", 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in nearcopies.representatives(docs).collect())
    assert got == plain_kept(rows)
    assert 1 < len(got) < 160


def test_links_of_blocks_join_what_all_pairs_join():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 400).astype(np.uint64)
    sets = [np.unique(np.append(rng.choice(base[i % 4 * 100 : i % 4 * 100 + 100], 95, replace=False), rng.integers(0, 2**62, 5).astype(np.uint64))) for i in range(40)]
    nodes, roots = np.arange(40) + 500, np.arange(40)
    near = {(i, j) for i in range(40) for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}

    def groups(pairs):
        root = list(range(40))
        for _ in range(40):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    every = np.arange(40)
    links = [(a - 500, b - 500) for a, b in nearcopies.block_links(nodes, roots, every, every, sets)]
    assert groups(links) == groups(near) and all((max(p), min(p)) in near for p in links) and len(links) == 36
    halves = [pair for left in (every[:20], every[20:]) for right in (every[:20], every[20:]) for pair in nearcopies.block_links(nodes, roots, left, right, sets)]
    assert groups([(a - 500, b - 500) for a, b in halves]) == groups(near)
    assert not nearcopies.block_links(nodes, np.zeros(40, np.int64), every, every, sets)


def test_a_very_long_text_and_its_copy(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short one")], "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.representatives(docs).collect()) == [1, 3]


def test_copies_meet_by_simhash_without_any_band(spark, monkeypatch):
    words = [f"w{i}" for i in range(900)]
    rows = [(5, " ".join(words)), (9, " ".join([*words[:899], "x"])), (7, "a text of its own that no other is like"), (1, ""), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "_key_batches", lambda sent: lambda batches: iter(()))
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()) == [1, 5, 7]
