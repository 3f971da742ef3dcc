import random
import re
import zlib
from collections import Counter

import numpy as np

from ashlar.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) == len(a) + 1 and a[at:] == b[at + 1 :]


def plain(rows):
    count = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    form, links = {}, {}
    for w in n:
        others = [v for v in n if v != w and near(w, v)]
        links[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], links[w], n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def texts():
    rng = random.Random(2)
    stems = ["".join(rng.choice("abcéèÀß") for _ in range(rng.randrange(4, 9))) for _ in range(30)]
    words = list(stems)
    for w in stems:
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            words.append(rng.choice([w[:i] + "a" + w[i:], w[:i] + w[i + 1 :], w[:i] + "é" + w[i + 1 :], w[:i].upper() + w[i:]]))
    rows = [(i, rng.choice([" ", "-", "_1"]).join(rng.choices(words, weights=[1 + 40 // (k + 1) for k in range(len(words))], k=200))) for i in range(60)]
    long = "y" * 300_000
    odd = [None, "", " \n ", "123 ÷×÷×÷ ÷×÷×÷ ÷×÷×÷", "naïve—naïve naïve naive naive naive naives ŒUVRE œuvre Œuvre", f"{long} {long} {long} {long}y {long}y {long}y z{long[1:]} z{long[1:]} z{long[1:]}"]
    odd += [" ".join(w * 3 for w in (f"{'q' * n} " for n in (63, 64, 65, 66)))]
    odd += [" ".join([f"{'q' * 62}b", f"{'q' * 63}b", f"{'q' * 64}b"] * 5)]
    odd += [" ".join(["zzabcdx"] * 3 + ["zzabcdy"] * 8 + ["zzabcey"] * 20)]
    rows += [(1000 + i, t) for i, t in enumerate(odd)]
    return rows + [(None, "abcde abcde abcde abcdf"), (3, rows[3][1]), (3, rows[3][1])]


def test_equals_all_pairs(spark):
    rows = texts()
    docs = spark.createDataFrame([(k, t, "w", 1, "f") for k, t in rows], "doc_id long, text string, word string, n int, form string").repartition(6)
    got = spelling.variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] and r[2] != r[1] for r in want)


def test_no_words(spark):
    schema = "doc_id long, text string"
    assert spelling.variants(spark.createDataFrame([], schema)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "abc abc abc abcd")], schema)).count() == 0


def test_keys_are_those_of_distinct_deletions():
    words = ["aabbc", "x", "ééé", "abcde", "abde", "abcd"]
    keys, place = spelling.delete_keys(words)
    by = {}
    for key, i in zip(keys.tolist(), place.tolist()):
        by.setdefault(i, []).append(key)
    for i, w in enumerate(words):
        forms = {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}
        assert len(by[i]) == len(set(by[i])) == len(forms)
        for j, v in enumerate(words):
            other = {v} | {v[:k] + v[k + 1 :] for k in range(len(v))}
            assert len(set(by[i]) & set(by[j])) == len(forms & other)


def test_crc_of_spans():
    data = np.frombuffer(b"hello world" + b"z" * 200, np.uint8)
    start, size = np.array([0, 6, 11, 3, 0]), np.array([5, 5, 200, 0, 1])
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(5)], np.uint32)
    got = spelling.crc32(data, start, size, before)
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + data[a : a + n].tobytes()) for i, (a, n) in enumerate(zip(start.tolist(), size.tolist()))]


def test_roots_follow_long_paths(spark):
    forms = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 5), (200, 300)], "id long, form long")
    got = {r.id: r.root for r in spelling.roots(forms).collect()}
    assert got == {i: 40 for i in range(1, 40)} | {100: 40, 200: 300}
