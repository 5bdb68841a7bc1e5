import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

sd = pytest.importorskip("tessera.llm.suffix_dedup")


def brute(rows):
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - 49):
            s = raw[k : k + 50]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def run(df, **more):
    done = sd.remove_repeats(df, keep=["doc_id"], **more)
    return {r[0]: tuple(r)[1:] for r in done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}


def test_against_brute_force(documents, corpus):
    assert run(documents) == brute(corpus)


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_passages(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ab cdé") for _ in range(900))
    rows = []
    for i in range(25):
        cuts = sorted(rng.sample(range(len(base)), 4))
        rows.append((i, base[cuts[0] : cuts[1]] + str(rng.random()) + base[cuts[2] : cuts[3]] + rng.choice(["", "aaaa" * 40])))
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == brute(rows)


def test_whole_characters_and_edge_rows(spark, empty):
    assert run(empty) == {}
    rows = [(None, "x" * 80), (1, "x" * 80), (1, "x" * 80), (2, "x" * 80), (3, None)]
    got = sorted(map(tuple, sd.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=["doc_id"]).select("doc_id", "n_removed").collect()), key=str)
    assert got == sorted([(None, 0), (1, 0), (1, 0), (2, 80), (3, 0)], key=str)
    text = spark.createDataFrame([(1, "é" * 60 + "a"), (2, "ü" * 3 + "é" * 60)], "doc_id bigint, text string")
    assert [r["kept"].decode() for r in sd.remove_repeats(text, keep=["doc_id"], whole_characters=True).orderBy("doc_id").collect()][1].startswith("üüü")


def test_difference_cover():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 70))]
        assert sd.difference_cover_order(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_passage_in_a_third_of_the_rows(spark):
    """Also where a task forgets what it has seen."""
    rng = random.Random(7)
    passage = "".join(rng.choice("abc def") for _ in range(700))
    rows = [(i, f"{rng.random()} {passage if i % 3 == 0 else ''} {rng.random()} {passage[100:300] if i % 7 == 0 else ''}{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert run(df) == brute(rows)
    around = sd._segments(spark.createDataFrame([(i, 1, t, []) for i, t in rows], "doc_id bigint, print bigint, text string, anchors array<bigint>"), 4)
    assert around.count() == 0


def test_crowded_anchors_lose_no_string(documents, corpus, spark):
    assert run(documents, hot_anchor=2) == brute(corpus)
    rng = random.Random(17)
    line = "".join(rng.choice("abc def") for _ in range(70))
    rows = [(i, f"{'x' * rng.randrange(30)}{line}{rng.choice('uvw') * rng.randrange(40)}{i}") for i in range(90)]
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), hot_anchor=2) == brute(rows)


def test_texts_longer_than_a_run_are_marked_as_a_whole(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    long = " ".join(word() for _ in range(3 * sd.RUN_BYTES // 5))
    raw = np.frombuffer(long.encode(), np.uint8)
    assert len(raw) > 2.5 * sd.RUN_BYTES
    for got, want in zip(sd._places_of_one(raw), sd._places(raw, np.array([0, len(raw)])), strict=True):
        assert got.tolist() == want.tolist()
    half = len(long) // 2
    rows = [(1, long[half - 400_000 : half + 100_000]), (2, long), (3, "x" * 30_000 + long[-90:])]
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_kept_columns_may_have_any_names(spark):
    rows = [(1, "y" * 90, 4, "a", 2), (2, "y" * 90, 5, "b", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, print int, `odd.name` string, n_spans int")
    got = sd.remove_repeats(df, keep=["doc_id", "print", "odd.name", "text", "n_spans"]).orderBy("doc_id").collect()
    assert [(r["print"], r["odd.name"], r["text"][0], r["n_removed"], r["n_spans"]) for r in got] == [(4, "a", "y", 0, 0), (5, "b", "y", 90, 1)]
