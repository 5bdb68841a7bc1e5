import random

import pytest

WORDS = "the of and a river stone light house green small open walk carry bright water field under never always table mountain copper silver music window garden".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, exact and near copies, shared passages, junk, edge cases."""
    rng = random.Random(5)
    docs = [prose(rng, rng.choice([3, 12, 60, 200, 400])) for _ in range(60)]
    passage = prose(rng, 60)
    docs += [docs[0], docs[1], docs[1], docs[2] + " end", "start " + docs[3]]
    docs += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(6)]
    long = docs[4].split()
    docs += [" ".join(w if i % 40 else "changed" for i, w in enumerate(long)), docs[5].upper(), "é" * 70 + docs[6], "é" * 70, "word " * 500, "a" * 300, "a" * 299]
    docs += ["", None, "   \n\t ", "one", "two words", "日本語の文章 です " * 20, "\x00\x01 control", "▁▁ mark  double  space ", passage]
    return list(enumerate(docs))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """With a column that no operator asked for, named as one it makes."""
    return spark.createDataFrame([(i, t, "x", 7) for i, t in corpus], "doc_id bigint, text string, kept string, n_words int").repartition(3)


@pytest.fixture
def empty(documents):
    return documents.limit(0)
