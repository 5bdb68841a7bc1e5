import math
import os
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sp = pytest.importorskip("tessera.llm.sentencepiece_sampling")
pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no vocabulary file")


def vocabulary():
    return sp.Vocabulary(Path(sp.MODEL).read_bytes(), 1.0)


def test_round_trip_and_order_of_rows(spark, documents, corpus):
    got = {r["doc_id"]: r for r in sp.round_trip(documents).collect()}
    again = {r["doc_id"]: r["ids"] for r in sp.round_trip(documents.orderBy(F.desc("doc_id")).coalesce(1)).collect()}
    assert len(got) == len(corpus)
    for i, text in corpus:
        assert got[i]["lossless"] and got[i]["ids"] == again[i]
        assert (got[i]["ids"] is None) == (text is None)
        assert got[i]["n_bytes"] == len((text or "").encode())


def test_decode_is_the_inverse(documents, corpus):
    encoded = sp.encode(documents, F.col("doc_id"), keep=["doc_id"])
    assert {r["doc_id"]: r["text"] for r in sp.decode(encoded, keep=["doc_id"]).collect()} == dict(corpus)


def test_other_seeds_cut_differently(documents):
    a, b = ({r["doc_id"]: r["ids"] for r in sp.encode(documents, F.col("doc_id"), keep=["doc_id"], seed=s).collect()} for s in (1, 2))
    assert a != b


def test_empty_table(empty):
    assert sp.round_trip(empty).collect() == []


def test_draws_follow_the_weights():
    lat = sp.Lattices(vocabulary())
    v, unit = lat.v, b" hello"
    ids = {p: i for i, p in enumerate(v.pieces) if p and i not in set(v.byte_ids.tolist())}

    def paths(at):
        if at == len(unit):
            yield (), 0.0
        for to in range(at + 1, len(unit) + 1):
            if unit[at:to] in ids:
                for rest, w in paths(to):
                    yield (ids[unit[at:to]], *rest), w + v.log_weight[ids[unit[at:to]]]

    weights = {p: math.exp(w) for p, w in paths(0)}
    total = sum(weights.values())
    lat.add([unit])
    n = 100_000
    pieces, count = lat.sample(np.full(n, lat.end_node[unit]), sp._mix(np.arange(n, dtype=np.uint64)))
    ends = np.cumsum(count)
    seen = Counter(tuple(pieces[e - c : e].tolist()) for e, c in zip(ends, count, strict=True))
    for path, w in weights.items():
        p = w / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p / n) + 1e-4


def table_of(lat, unit):
    """The cumulative probabilities of a unit's nodes."""
    end = lat.end_node[unit]
    first = lat.first[end - len(unit) : end + 1]
    return [lat.cum[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


def test_tables_do_not_depend_on_the_batch():
    rng = np.random.default_rng(5)
    unit = lambda: b" " + bytes(rng.integers(97, 123, rng.integers(1, 14)).astype(np.uint8))
    some, others = [unit() for _ in range(300)], [unit() for _ in range(20_000)]
    some, others = list(dict.fromkeys(some)), list(dict.fromkeys(others))
    v = vocabulary()
    alone, mixed = sp.Lattices(v), sp.Lattices(v)
    alone.add(some)
    mixed.add([u for u in others if u not in some] + some)
    assert [table_of(alone, u) for u in some] == [table_of(mixed, u) for u in some]


def brute_path(v, text, key):
    """A whole text, unit by unit and edge by edge, from the weights alone."""
    known = {p: i for i, p in enumerate(v.pieces) if p and i not in set(v.byte_ids.tolist())}
    out = []
    for place, unit in enumerate(sp._UNITS.findall(b" " + text)):
        starts = [k for k in range(len(unit)) if unit[k] & 0xC0 != 0x80]
        char = {k: unit[s:e] for s, e in zip(starts, [*starts[1:], len(unit)], strict=True) for k in range(s, e)}
        into = {to: [(a, known[unit[a:to]]) for a in starts if a < to and unit[a:to] in known] for to in range(1, len(unit) + 1)}
        for to in into:
            if char[to - 1] not in known:
                into[to].append((to - 1, int(v.byte_ids[unit[to - 1]])))
        total = {0: 1.0}
        for to in range(1, len(unit) + 1):
            total[to] = sum(total[a] * math.exp(v.log_weight[p]) for a, p in into[to])
        state = sp._states(np.array([key], np.uint64), np.array([place]))
        own, to = [], len(unit)
        while to:
            state = sp._mix(state + sp._GOLD)
            u, cum = int(state[0] >> np.uint64(11)) * 2.0**-53, 0.0
            for a, p in into[to]:
                cum += total[a] * math.exp(v.log_weight[p]) / total[to]
                at, drawn = a, p
                if u < cum:
                    break
            own.append(drawn)
            to = at
        out += own[::-1]
    return out


def test_whole_texts_against_brute_force(spark, documents, corpus):
    v = vocabulary()
    keyed = documents.select("doc_id", "text", F.xxhash64("doc_id", F.lit(sp.SEED)).alias("key"))
    key = {r["doc_id"]: r["key"] % (1 << 64) for r in keyed.collect()}
    got = {r["doc_id"]: r["ids"] for r in sp.round_trip(documents).collect()}
    for i, text in corpus:
        if text is not None and len(text) < 1500:
            assert got[i] == brute_path(v, text.encode(), key[i]), i


def test_long_units_are_cut_as_short_ones(monkeypatch):
    rng = np.random.default_rng(6)
    v = vocabulary()
    texts = ["".join(rng.choice(list("abcdeé日ж\u1234"), 400)).encode() for _ in range(6)] + [b"aaaa" * 90]
    keys = np.arange(len(texts), dtype=np.uint64)
    want = sp._encode(sp.Lattices(v), texts, keys)
    monkeypatch.setattr(sp, "LONG_UNIT", 100)
    monkeypatch.setattr(sp, "BLOCK", 64)
    got = sp._encode(sp.Lattices(v), texts, keys)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_very_long_texts(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 3 * sp.RUN_BYTES // 6))), "x" * 100_000 + "é" * 1000, "z " * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in sp.round_trip(df).collect()}
    assert all(r["lossless"] for r in got.values())
    v, key = vocabulary(), df.select("doc_id", F.xxhash64("doc_id", F.lit(sp.SEED)).alias("key"))
    keys = {r["doc_id"]: r["key"] % (1 << 64) for r in key.collect()}
    head = texts[0][: texts[0].index(" ", 2000)].encode()
    want = brute_path(v, head, keys[0])
    assert got[0]["ids"][: len(want)] == want


def test_kept_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same text", 5), (1, "same text", 6), (None, "x", 7)], "doc_id bigint, text string, ids int")
    got = sp.encode(df, F.col("doc_id"), keep=["doc_id", "text", "ids"]).collect()
    assert got[0]["ids"] == got[1]["ids"] and {r["text"] for r in got} == {"same text", "x"}
    assert sorted(map(str, sp.round_trip(df).columns)) == ["doc_id", "ids", "lossless", "n_bytes", "n_pieces"]
