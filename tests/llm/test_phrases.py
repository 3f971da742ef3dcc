import hashlib
import random

import numpy as np
import pytest

from ashlar.llm import kernel, phrases


def plain_symbols(text):
    """Symbols of a text: (a word) or single bytes of long runs."""
    out, data, at = [], text.encode(), 0
    while at < len(data):
        end = at + 1
        while end < len(data) and kernel.CLASS[data[end]] == kernel.CLASS[data[at]]:
            end += 1
        if kernel.CLASS[data[at]] != kernel.SPACE:
            out += [data[at:end]] if end - at <= phrases.LONGEST else [data[i : i + 1] for i in range(at, end)]
        at = end
    return out


def plain_phrases(text):
    known, now = set(), ()
    for s in plain_symbols(text):
        now += (s,)
        if now not in known:
            known.add(now)
            now = ()
    return known


def number(phrase):
    """A phrase's number from those of its symbols."""
    node = 0
    for s in phrase:
        at = int(kernel.xxh64(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]))[0]) >> 4
        node = ((node ^ at) * phrases.STEP) & phrases.MASK
    return node


def plain_print(text):
    found = sorted(number(p) for p in plain_phrases(text))
    if not found:
        return ""
    least = {}
    for v in found:
        h = int(kernel.mix(np.array([v], np.uint64), np.array([v], np.uint64))[0])
        least[h >> 57] = min(least.get(h >> 57, 2**64), h & (2**57 - 1))
    out = []
    for slot in range(phrases.SLOTS):
        asked, turn = slot, 0
        while asked not in least:
            turn += 1
            asked = int(kernel.mix(np.array([slot], np.uint64), np.array([turn], np.uint64))[0]) % phrases.SLOTS
        v = np.array([least[asked]], np.uint64)
        out.append(int(kernel.mix(v, v)[0]) & 255)
    return bytes(out).hex()


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(bytes.fromhex(a), bytes.fromhex(b))) / phrases.SLOTS
    return max((256 * same - 1) / 255, 0)


def plain(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        a, b, c = plain_print(text), plain_print(edited), plain_print(after)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out, key=str)


def texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß中") for _ in range(rng.randrange(1, 7))) for _ in range(80)]
    rows = []
    for i in range(150):
        rows.append((i * 3, "".join(rng.choice(words) + rng.choice([" ", "\n", ", ", "-", "7"]) for _ in range(rng.randrange(0, 60)))))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "abc"), (904, "abcd"), (905, "x" * 3000), (906, "x" * 3000 + "y"), (907, "日本語" * 400), (908, "日本語" * 390), (909, rows[5][1]), (910, rows[5][1]), (None, "no id here at all")]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_a_plain_parse(spark, parts):
    rows = texts()
    docs = spark.createDataFrame([(k, t, "f", 3) for k, t in rows], "doc_id long, text string, fingerprint string, kind int").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    try:
        got = phrases.fingerprints(docs)
        assert sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got.collect()), key=str) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ties_and_repeated_rows(spark):
    rows = [(5, "a b c d e f g h")] * 40 + [(5, "other words stand here")] * 3 + [(9, "the last one of all")]
    got = phrases.fingerprints(spark.createDataFrame(rows, "doc_id int, text string").repartition(6)).collect()
    assert len(got) == 44
    # rows of one id come in runs of equal texts: all but the last of a run are followed by themselves
    assert sum(r.near_next == 1.0 for r in got) == 39 + 2


def test_few_rows(spark):
    schema = "doc_id long, text string"
    assert phrases.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = phrases.fingerprints(spark.createDataFrame([(1, "abcdefgh ijkl")], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefgh iabc").hexdigest()


def test_likeness_follows_what_is_shared():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = [rng.choice(words) for _ in range(2000)]
    shares = []
    for part in (0, 200, 600, 1200, 2000):
        other = text[: 2000 - part] + [rng.choice(words) for _ in range(part)]
        columns = phrases.compared([" ".join(text), " ".join(other)])
        shares.append(columns[-1][0].as_py())
        exact = (a := plain_phrases(" ".join(text))) and len(a & (b := plain_phrases(" ".join(other)))) / len(a | b)
        assert abs(shares[-1] - exact) < 0.15
    assert shares[0] == 1.0 and shares == sorted(shares, reverse=True)


def test_a_very_long_text(spark):
    text = "wort für wort " * 200_000
    got = phrases.fingerprints(spark.createDataFrame([(1, text), (2, text + "ende"), (3, "kurz")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_chars for r in got] == [2_800_000, 2_800_004, 4] and got[0].near_next > 0.9 and got[2].near_next == 0
