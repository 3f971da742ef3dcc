import random

import pytest

WORDS = {
    "en": "the of and house water green running slowly because window garden people where nothing".split(),
    "de": "der die und haus wasser grün langsam weil fenster garten leute nichts schön straße".split(),
    "fr": "le la et maison eau vert lentement parce fenêtre jardin gens rien très où".split(),
}


def make_docs(n=240, seed=1):
    """doc_id, text, lang, source, n_chars rows with all the odd cases, and labels."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        sentences = [" ".join(rng.choices(WORDS[lang], k=rng.randrange(4, 12))).capitalize() + "." for _ in range(rng.randrange(8, 20))]
        bad, toxic = i % 7 == 0, i % 5 == 0
        if toxic:
            sentences.insert(rng.randrange(len(sentences)), "You utter blockhead, what a blockheaded thing.")
        text = " ".join(w + "###" if bad else w for s in sentences for w in s.split())
        rows.append((i, text, lang, "src0", len(text)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(1000, None, "en", None, None), (1001, "", None, "s", 0), (1002, " \n\t ", "de", "s", 4), (1003, "123 456 !!", "fr", "s", 10), (None, "the house", "en", "s", 9), (5, rows[5][1], "en", "s", 1), (1004, "straßen " * 30000, "de", "s", 1)]
    labels += [(None, 1, 0), (1000, None, None), (3, 1, 0), (3, 1, 0)]
    return rows, labels


@pytest.fixture(scope="session")
def docs_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows[0], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as label", "1 as score", "2 as held_out", "3 as row").cache()


@pytest.fixture(scope="session")
def labels(spark, docs_rows):
    return spark.createDataFrame(docs_rows[1], "doc_id long, quality int, toxic int").selectExpr("*", "'y' as text").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
