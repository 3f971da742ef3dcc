import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash

from ashlar.llm import kernel, langid, quality, rules, toxicity
from ashlar.llm.common import sampled
from ashlar.llm.ftrl import Ftrl


def rest(key, m):
    return zlib.crc32(str(key).encode()) % m


def test_languages(docs, docs_rows, no_docs):
    got = langid.languages(docs).collect()
    assert len(got) == len(docs_rows[0])
    langs = {r[0]: r[2] for r in docs_rows[0][:240]}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (rest(r.doc_id, 4) == 2)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.held_out]
    assert len(held) > 30 and np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1000] == by[1001] == by[1002] == by[1003] == "und" and by[1004] == "de"
    assert langid.languages(no_docs).count() == 0


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "only here", "xx") for i in range(400) if rest(i, 4) == 2] + [(i, "plain words", "aa") for i in range(40) if rest(i, 4) != 2]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa"]


def test_backoff_goes_from_words_to_short_grams():
    model = langid.Model([("a", "hello", 3), ("b", "zebra", 2)])
    known, gram, letter, unknown = model.vectors(["hello", "hellos", "ozz", "ш"])
    assert known[0] > known[1] and gram[0] > gram[1] and letter[1] > letter[0] and (unknown == 0).all()


class PlainModel:
    """The same backoff, one word and one n-gram at a time."""

    def __init__(self, counts):
        self.languages = sorted({lang for lang, _, _ in counts})
        self.tables = [Counter() for _ in range(langid.NGRAM + 1)]
        for lang, word, n in counts:
            for level, table in enumerate(self.tables):
                for gram in self.grams(word, level):
                    table[gram, lang] += n

    @staticmethod
    def grams(word, level):
        if not level:
            return [word]
        held = f"\x02{word}\x03" if level > 1 else word
        return [held[i : i + level] for i in range(len(held) - level + 1)]

    def logs(self, level, gram):
        table = self.tables[level]
        size = len({g for g, _ in table})
        return [math.log((table[gram, lang] + 0.5) / (sum(n for (_, x), n in table.items() if x == lang) + 0.5 * size + 1e-9)) for lang in self.languages]

    def predict(self, text):
        sums, words = [0.0] * len(self.languages), regex.findall(r"\p{L}+", (text or "").lower())
        for word in words:
            for level in (0, *range(langid.NGRAM, 0, -1)):
                known = [g for g in self.grams(word, level) if any((g, lang) in self.tables[level] for lang in self.languages)]
                if known:
                    rows = [self.logs(level, g) for g in known]
                    sums = [s + sum(r[i] for r in rows) / len(rows) for i, s in enumerate(sums)]
                    break
        if not words or not self.languages:
            return "und", 0.0
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        return self.languages[best], 1 / sum(math.exp(s - max(sums)) for s in sums)


def test_every_text_scores_as_in_the_plain_form():
    counts = [("en", "house", 4), ("en", "the", 9), ("de", "haus", 3), ("de", "das", 8), ("fr", "maison", 2), ("fr", "la", 9), ("de", "straße", 1), ("el", "ὁδός", 2)]
    model, plain = langid.Scorer(langid.Model(counts)), PlainModel(counts)
    texts = ["The HOUSE", "das Haus", "houses maisons", "x² ½ ①", "Ⅷ", "²½", None, "", "q", "ш ж", "ὁδόΣ", "ΟΔΟΣ the", "l'a\u0301b", "la la la das", "house " * 3000, "日本 house", "a_b1c"]
    for text, (lang, score) in zip(texts, model.best(texts)):
        want = plain.predict(text)
        assert (lang, pytest.approx(score, abs=1e-4)) == (want[0], want[1]), text


def test_numbers_are_no_letters(spark):
    rows = [(i, "aa bb", "x") for i in range(8)] + [(20, "²½", None), (21, "①", None), (22, "Ⅷ", None), (23, "12 _", None), (24, "a²", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[i] for i in (20, 21, 22, 23)} == {("und", 0.0)} and got[24] == ("x", 1.0)


def test_quality(docs, labels, docs_rows, no_docs, no_labels):
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(docs_rows[0])
    truth = {r[0]: r[1] for r in docs_rows[1][:240]}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (rest(r.doc_id, 5) == 0)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert {r.score for r in quality.quality_scores(docs, no_labels).collect()} == {0.5}
    assert quality.quality_scores(no_docs, labels).count() == 0


def test_quality_features_are_tokens_bigrams_and_returns():
    data, offsets = kernel.flat(pa.array(["ab ## ab", "", "x"]))
    feature, doc = quality.occurrences(data, offsets)
    assert Counter(doc.tolist()) == {0: 3 + 2 + 1, 2: 1}


def test_accepted_rows_keep_all_columns(docs, labels):
    kept = quality.accepted(docs, labels)
    assert kept.schema == docs.schema
    good = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    calm = toxicity.accepted(docs, labels)
    bad = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in docs.collect()} - bad == {r.doc_id for r in calm.collect()}


def test_toxicity(docs, labels, docs_rows, no_docs, no_labels):
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(docs_rows[0])
    truth = {r[0]: r[2] for r in docs_rows[1][:240]}
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001] == by[1002] == by[1003] == 0.0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert max(r.predicted for r in toxicity.toxicity_scores(docs.where("doc_id < 9"), no_labels).collect()) == 0
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0


def test_offending_sentences_are_located(docs, labels):
    found = toxicity.locate(docs, toxicity.fit(docs, labels)).collect()
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 240").collect()}
    assert found and np.mean(["blockhead" in r.sentence for r in found]) > 0.95
    assert all(texts[r.doc_id].encode()[r.start : r.start + r.length].decode() == r.sentence for r in found)


def test_toxic_documents_come_with_their_sentences(docs, labels):
    rows = toxicity.toxicity_scores(docs, labels).where("doc_id < 240").collect()
    texts = {r.doc_id: r.text.encode() for r in docs.where("doc_id < 240").collect()}
    assert all(bool(r.offending) == bool(r.predicted) for r in rows)
    found = [texts[r.doc_id][x.start : x.start + x.length].decode() for r in rows for x in r.offending]
    assert found and np.mean(["blockhead" in x for x in found]) > 0.95


def plain_toxicity(text, weights):
    """One sentence and one word at a time."""
    feature = lambda part, seed: xxhash.xxh64_intdigest(part, seed) >> (64 - toxicity.BITS)
    hazards = []
    for sentence in re.split(rb"[.!?\n]", (text or "").encode()):
        words = re.findall(rb"[a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in sentence))
        if words:
            logit = weights[-1] + toxicity.BIAS + sum(weights[feature(w, 42)] + sum(weights[feature(w[:n], n)] for n in toxicity.PREFIXES if len(w) >= n) for w in words)
            hazards.append(math.log1p(math.exp(logit)))
    floor, most = -math.log1p(-toxicity.FLOOR), toxicity.BACKGROUND * math.log1p(math.exp(toxicity.BIAS))
    return -math.expm1(-(sum(max(h - floor, 0) for h in hazards) + min(sum(min(h, floor) for h in hazards), most)))


def plain_quality(text, weights):
    """One token at a time."""
    tokens = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff \t-\r]+", (text or "").encode())
    hashed = np.array([xxhash.xxh64_intdigest(t, 42) for t in tokens], np.uint64)
    found = [*hashed, *(kernel.mix(hashed[i : i + 1], hashed[i + 1 : i + 2])[0] for i in range(len(tokens) - 1))]
    for lag in range(1, quality.LAGS + 1):
        found += [kernel.mix(np.array([lag], np.uint64), kernel.P5)[0]] * sum(tokens[i] == tokens[i + lag] for i in range(len(tokens) - lag))
    logit = weights[-1] + quality.SCALE * sum(weights[int(x) >> (64 - quality.BITS)] for x in found) / max(1, len(found))
    return 1 / (1 + math.exp(-logit))


def test_scores_match_the_plain_forms(docs, labels, docs_rows):
    weights = {"quality": quality.fit(docs, labels).astype(float), "toxic": toxicity.fit(docs, labels).astype(float)}
    texts = [r[1] for r in docs_rows[0] if len(r[1] or "") < 5000] + ["Ünïcode ##?! 12,5\tx\x0by", "a. b! c\n\nd?", "You blockhead, blockheads! " * 40]
    flat = kernel.flat(pa.array(texts))
    got = 1 / (1 + np.exp(-quality.logits(*flat, weights["quality"])))
    assert np.allclose(got, [plain_quality(t, weights["quality"]) for t in texts], atol=1e-9)
    assert np.allclose(toxicity.document_scores(*flat, weights["toxic"]), [plain_toxicity(t, weights["toxic"]) for t in texts], atol=1e-9)


def numeric(loss, x, at, step=1e-6):
    high, low = x.copy(), x.copy()
    high[at] += step
    low[at] -= step
    return (loss(high) - loss(low)) / (2 * step)


def test_slopes_of_both_losses_are_their_numeric_gradients():
    rng = np.random.default_rng(2)
    for _ in range(60):
        logit = rng.normal(-4, 3, int(rng.integers(1, 40)))
        for label in (0.0, 1.0):

            def loss(x):
                total = float(toxicity.document_hazards(toxicity.softplus(x), np.zeros(len(x), np.int64), 1)[0])
                return total if label == 0 else -math.log(-math.expm1(-total))

            got = toxicity.loss_slopes(logit, label)
            for i in range(len(logit)):
                want = numeric(loss, logit, i)
                if abs(want) < 0.999:  # beyond, slopes are cut
                    assert got[i] == pytest.approx(want, abs=1e-4)
        weight, value = rng.normal(size=7), rng.normal(size=7)
        for label in (0.0, 1.0):
            entropy = lambda w: math.log1p(math.exp((1 - 2 * label) * float(w @ value)))  # noqa: B023, E731
            assert quality.loss_slope(weight, value, label) == pytest.approx([numeric(entropy, weight, i) for i in range(7)], abs=1e-6)


def test_updates_follow_the_proximal_rule_one_coordinate_at_a_time():
    rng = np.random.default_rng(3)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.01
    model = Ftrl(5, alpha, beta, l1, l2)
    z, n = [0.0] * 6, [0.0] * 6

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(200):
        index = np.sort(rng.choice(6, 3, replace=False))
        held = model.weights(index)
        assert held == pytest.approx([weight(i) for i in index], abs=1e-12)
        gradient = rng.normal(size=3)
        model.update(index, held, gradient)
        for i, g in zip(index, gradient):
            w = weight(i)
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w
            n[i] += g * g
    assert model.weights() == pytest.approx([weight(i) for i in range(6)], abs=1e-12)


def test_very_long_texts_pass_every_model(spark, docs, labels):
    sentence = "The green house of the people and nothing, where water was running slowly. "
    long = sentence * 20_000  # 1.5 million characters
    rows = spark.createDataFrame([(1, long), (2, sentence * 30), (3, "z" * 2_000_000)], "doc_id long, text string")
    tongues = {r.doc_id: r.lang_pred for r in langid.predict(rows, langid.fit(docs)).collect()}
    assert tongues[1] == tongues[2] == "en" and len(tongues) == 3
    scores = {r.doc_id: r.score for r in quality.score(rows, quality.fit(docs, labels)).collect()}
    assert scores[1] == pytest.approx(plain_quality(long[: len(sentence) * 400], quality.fit(docs, labels).astype(float)), abs=0.02) and len(scores) == 3
    verdicts = {r.doc_id: r for r in rules.judged(rows, *rules.fit(docs, labels)).collect()}
    assert verdicts[1].n_words == 20_000 * 13 and verdicts[1].base_failed and verdicts[3].word_chars == 2_000_000
    assert verdicts[1].n_repeat_words == verdicts[1].n_words


def test_noisy_or_of_sentences():
    data, offsets = kernel.flat(pa.array(["a b. c!\nd", None]))
    word, sentence, doc, start, end = toxicity.instances(data, offsets)
    assert sentence.tolist() == [0, 0, 1, 2] and doc.tolist() == [0, 0, 0]
    weights = np.zeros((1 << toxicity.BITS) + 1)
    p = 1 / (1 + np.exp(-toxicity.BIAS))
    assert np.allclose(toxicity.document_scores(data, offsets, weights), [1 - (1 - p) ** 3, 0])


def test_long_clean_texts_are_not_toxic(spark, docs, labels, no_labels):
    calm = [s + "." for r in docs.where("doc_id < 240").collect() for s in r.text.split(".") if s.strip() and "blockhead" not in s]
    many = " ".join((calm * (20000 // len(calm) + 1))[:20000])
    rows = [(1, many), (2, "One neutral sentence. " * 20000), (3, "Plain words here. " * 280), (4, "Plain words here. " * 20000 + "You utter blockhead, what a blockheaded thing.")]
    long = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.predicted for r in toxicity.toxicity_scores(long, no_labels).collect()} == {0}
    assert toxicity.accepted(long, no_labels).count() == 4
    weights = toxicity.fit(docs, labels)
    assert {r.doc_id: r.predicted for r in toxicity.score(long, weights).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


def plain_statistics(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_rule_statistics_match_the_plain_form(docs_rows):
    texts = [r[1] for r in docs_rows[0]] + ["a a a a", "x\nx\n x\n\n\ny", "é ü\x0bß\x1cz", "one two three one two three", "\nlast", "a\n" * 50]
    got = rules.statistics(*kernel.flat(pa.array(texts)))[:, :5].tolist()
    assert got == [plain_statistics(t) for t in texts]


def test_rules(docs, labels, docs_rows, no_docs, no_labels):
    got = rules.rule_verdicts(docs, labels).collect()
    assert len(got) == len(docs_rows[0])
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    truth = {r[0]: r[1] for r in docs_rows[1][:240]}
    passed = [r for r in got if r.doc_id is not None and r.doc_id < 240 and not r.base_failed]
    assert np.mean([r.kept for r in passed if truth[r.doc_id]]) > 0.97
    assert np.mean([r.kept for r in passed if not truth[r.doc_id]]) < 0.1
    assert all(r.kept != r.base_failed for r in rules.rule_verdicts(docs, no_labels).collect())
    assert rules.rule_verdicts(no_docs, labels).count() == 0


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    rows = np.append(rng.normal(size=(500, 3)), [[9.0, 9.0, 9.0]], axis=0)
    score = rules.Forest(rows, trees=100, leaves=64).anomaly(rows)
    assert score.argmax() == 500


def plain_anomaly(forest, row):
    """One row, one tree and one node at a time."""
    total = 0.0
    for feature, value, path in zip(forest.feature, forest.value, forest.path):
        node = 0
        while feature[node] >= 0:
            node = 2 * node + (2 if row[feature[node]] >= value[node] else 1)
        total += path[node]
    return 2 ** (-total / len(forest.feature) / rules.average_path(forest.size))


def test_verdicts_match_a_plain_form(docs, labels, docs_rows):
    forest, cut = rules.fit(docs, labels)
    got = {(r.doc_id, r.n_words): r for r in rules.judged(docs, forest, cut).collect()}
    for key, text, *_ in docs_rows[0]:
        stats = np.array([plain_statistics(text) + [len((text or "").encode().split(b"\n")), *(len(re.findall(p, text or "")) for p in ("[A-Z]", "[0-9]"))] + [len(re.findall(rb"[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]", (text or "").encode()))]])
        r = got[key, int(stats[0, 0])]
        failed = stats[0, 0] < 50 or 100 * stats[0, 4] > 50 * stats[0, 0]
        score = plain_anomaly(forest, rules.ratios(stats)[0])
        assert r.anomaly == pytest.approx(score, abs=1e-9)
        assert (r.base_failed, r.kept) == (failed, not failed and score <= cut)


def test_bad_rows_are_rejected_and_good_ones_kept_with_few_and_many_labels(spark):
    for sf, least in (("sf0.01", 20), ("sf0.1", 200)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet") for name in ("documents", "labels"))
        got = rules.rule_verdicts(docs, labels).where("not base_failed").join(labels.select("doc_id", "quality"), "doc_id").where("quality is not null").collect()
        assert sum(r.quality == 0 for r in got) > least
        assert np.mean([r.kept for r in got if r.quality == 0]) < 0.1
        assert np.mean([r.kept for r in got if r.quality == 1]) > 0.99


def test_rules_learn_from_all_labelled_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for n in (50, 4000):
        marks = (rng.random(n) < 0.8).astype(int)
        scores = np.round(rng.normal(0.4 + 0.15 * (1 - marks), 0.06), 3)
        scored = spark.createDataFrame([(int(a), float(b)) for a, b in zip(marks, scores)], "label int, score double")
        assert rules.spread_threshold(scored, int(marks.sum())) == pytest.approx(rules.threshold(scores, marks), abs=1e-12)
    docs = spark.range(6000).selectExpr("id as doc_id", "array_join(transform(sequence(1, 60), x -> concat('w', x * 37 % (id % 50 + 61))), if(id % 9 = 0, ' ## ', ' ')) as text")
    labels = spark.range(6000).selectExpr("id as doc_id", "if(id % 9 = 0, 0, 1) as quality", "0 as toxic")
    usable = sum(rest(i, 5) > 0 for i in range(6000))
    sizes, collected = [], rules._collected
    monkeypatch.setattr(rules, "_collected", lambda df: sizes.append(df.count()) or collected(df))
    whole, cut = rules.fit(docs, labels)
    assert sizes == [usable] and usable > 4000
    spread, wide_cut = rules.fit(docs, labels, pool=1000)  # trees draw from about a thousand good rows, all the rest is of all rows
    assert 800 < sizes[1] < 1200
    for forest, limit in ((whole, cut), (spread, wide_cut)):
        got = rules.judged(docs, forest, limit).where("not base_failed").collect()
        assert not any(r.kept for r in got if r.doc_id % 9 == 0) and np.mean([r.kept for r in got if r.doc_id % 9]) > 0.98


def test_samples_are_bounded_and_do_not_depend_on_order(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id for r in sampled(ids, "doc_id", 500, 20000).collect()}
    b = {r.doc_id for r in sampled(ids.repartition(7), "doc_id", 500, 20000).collect()}
    assert a == b and 350 < len(a) < 650
    assert sampled(ids, "doc_id", 20000, 20000).count() == 20000


def test_samples_hold_one_row_of_a_repeated_id(spark, monkeypatch):
    rows = [(7, f"text number {i} of one id") for i in range(600)] + [(i, f"text of id {i}") for i in range(8, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(7, 60) for _ in range(2)], "doc_id long, quality int, toxic int")
    usable = {i for i in range(7, 60) if rest(i, 5)}
    for label in ("quality", "toxic"):
        ids = [r.doc_id for r in quality.labelled(docs, labels, label).collect()]
        assert len(ids) == len(set(ids)) and set(ids) == usable
    a, b = (sorted(map(tuple, quality.labelled(x, labels, "quality").collect())) for x in (docs, docs.repartition(5)))
    assert a == b
    sizes, collected = [], rules._collected
    monkeypatch.setattr(rules, "_collected", lambda df: sizes.append(df.count()) or collected(df))
    monkeypatch.setattr(rules, "base_failed", lambda stats: np.zeros(len(stats), bool))
    rules.fit(docs, labels)
    assert sizes == [len(usable)]


def known_words(model, words):
    """Whether the model knows each word whole."""
    key, _ = langid.Words(words).whole(np.arange(len(words)))
    return model.levels[0].places(key) >= 0


def test_every_language_is_learned_at_every_size(spark):
    some = [i for i in range(400) if rest(i, 4) != 2]
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, f"own{str(i).translate(letters)}", "rare" if i % 20 == 0 else "aa") for i in some]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    unlabelled = spark.range(1000, 31000).selectExpr("id as doc_id", "'no label' as text", "cast(null as string) as lang")
    others = spark.range(1000, 31000).selectExpr("id as doc_id", "'many rows' as text", "'zz' as lang")
    words = [r[1] for r in rows]
    model = langid.fit(docs.unionByName(unlabelled))
    assert known_words(model, words).all() and not known_words(model, ["label"]).any()
    model = langid.fit(docs.unionByName(others))
    assert model.languages == ["aa", "rare", "zz"] and known_words(model, words + ["many", "rows"]).all()
    usable = docs.unionByName(others).where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in langid.sample_by_language(usable, 1000).groupBy("lang").count().collect()}
    assert sizes["aa"] + sizes["rare"] == len(rows) and 850 < sizes["zz"] < 1250


def test_no_language_is_left_out(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('w', translate(id % 500, '0123456789', 'abcdefghij')) as text", "concat('l', id % 500) as lang")
    usable = docs.where(langid.crc_rest("doc_id", 4) != 2)
    per = {r["lang"]: r["count"] for r in langid.sample_by_language(usable, 1000, total=700).groupBy("lang").count().collect()}
    assert len(per) == 500 and sum(per.values()) < 1600
    model = langid.fit(docs)
    assert len(model.languages) == 500
    hit = [r.lang_pred == r.lang for r in langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()]
    assert np.mean(hit) == 1.0
