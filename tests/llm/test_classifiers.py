import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm.queries")
from tessera.llm import language_id, quality_classifier, quality_rules, toxicity  # noqa: E402

from .conftest import prose  # noqa: E402


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        toxic, bad = i % 4 == 0, i % 5 == 0
        words = prose(rng, rng.choice([20, 80, 200])).split()
        if toxic:
            words[3:3] = ["zorkfool"]
        if bad:
            words = [w.upper() + "!!%%" for w in words]
        rows.append((i, " ".join(words), int(not bad), int(toxic), f"src{i % 7 if not bad else 8}", "en"))
    rows += [(300, None, 1, 0, None, None), (301, "", 1, 0, "src1", "en"), (301, "", 0, 1, "src1", "en")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int, source string, lang string")


def test_toxicity(spark, labelled, documents, empty):
    held = F.col("doc_id") % 3 == 1
    model = toxicity.fit(labelled.select("doc_id", "text"), labelled.where(~held).select("doc_id", "toxic"))
    rows = toxicity.score_documents(labelled.where("doc_id < 300"), model, keep=["doc_id", "toxic"]).collect()
    assert sum((r["score"] >= 0.7) == bool(r["toxic"]) for r in rows) >= 0.97 * len(rows)
    scored = toxicity.score_documents(documents, model, keep=["doc_id"])
    assert scored.count() == documents.count() and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.score_documents(empty, model, keep=["doc_id"]).count() == 0
    neutral = toxicity.fit(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic").limit(0))
    assert {r["score"] for r in toxicity.score_documents(documents, neutral, keep=["doc_id"]).collect()} == {0.5}


def test_quality_classifier(labelled, empty):
    docs = labelled.drop("quality", "toxic")
    got = {r["doc_id"]: r for r in quality_classifier.judge_documents(docs, labelled.select("doc_id", "quality"), keep=["doc_id"]).collect()}
    assert len(got) == 242
    wrong = [i for i in range(240) if got[i]["kept"] != (i % 5 != 0)]
    assert len(wrong) <= 4
    assert all(0 < r["score"] < 1 and 0 < r["site_prior"] < 1 for r in got.values())
    bare = empty.select("doc_id", "text", F.lit("s").alias("source"), F.lit("l").alias("lang"))
    assert quality_classifier.judge_documents(bare, labelled.select("doc_id", "quality"), keep=["doc_id"]).count() == 0
    none = quality_classifier.judge_documents(docs, labelled.select("doc_id", "quality").limit(0), keep=["doc_id"])
    assert none.where("evidence <> 0").count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(i, "plain words here " * 9, "big", "en") for i in range(60)] + [(100, "plain words here " * 9, "tiny", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)] + [(100, 0)], "doc_id bigint, quality int")
    prior = {r["source"]: r["site_prior"] for r in quality_classifier.judge_documents(docs, labels, keep=["doc_id", "source"]).collect()}
    assert prior["tiny"] > 0.2 and 0.4 < prior["big"] < 0.6


def words_in(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_quality_rules_against_brute_force(documents, corpus, empty, spark):
    import re
    from collections import Counter

    trusted = spark.createDataFrame([(i,) for i in range(40)], "doc_id bigint")
    got = {r["doc_id"]: r for r in quality_rules.judge_quality(documents, trusted, keep=["doc_id"]).collect()}
    for i, text in corpus:
        w = words_in(text)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if words_in(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert quality_rules.judge_quality(empty, trusted, keep=["doc_id"]).count() == 0


def test_ratio_prefers_the_target(labelled):
    judged = quality_rules.judge_quality(labelled.where("doc_id < 300"), labelled.where("quality = 1").select("doc_id"), keep=["doc_id", "quality"])
    mean = {r["quality"]: r["m"] for r in judged.groupBy("quality").agg(F.avg("log_ratio").alias("m")).collect()}
    assert mean[1] > mean[0] + 0.3


def test_quality_threshold_lies_between_the_labels(spark, tmp_path):
    """Bad documents that differ from good ones in a few words, and the same ones in a corpus with many rare words."""
    rng = random.Random(6)
    spoil = lambda words: [w if i % 5 else rng.choice(["%%x", "&&y"]) for i, w in enumerate(words)]
    small = [(i, " ".join(spoil(prose(rng, 90).split()) if i % 4 == 0 else prose(rng, 90).split())) for i in range(160)]
    rare = [(1000 + i, " ".join(f"{w} r{rng.randrange(10**6)}" for w in prose(rng, 300).split())) for i in range(600)]
    labels = [(i, int(i % 4 != 0), 0) for i, _ in small if i % 8 < 6]
    for name, rows in (("a", small), ("b", small + rare)):
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = {r["doc_id"]: r["kept"] for r in quality_rules.op4_quality_rules(spark, f"{tmp_path}/{name}").collect()}
        assert [i for i, _ in small if kept[i] != (i % 4 != 0)] == [], name


def test_quality_model_follows_the_corpus(spark, labelled):
    docs = labelled.where("doc_id < 300").select("doc_id", "text")
    assert quality_rules.buckets_for(docs.limit(0)) == quality_rules.LEAST_BUCKETS
    longer = spark.range(100).select(F.repeat(F.lit("x"), 2_000_000).alias("text"))
    assert quality_rules.buckets_for(longer) >= 4 * quality_rules.LEAST_BUCKETS
    trusted = labelled.where("quality = 1").select("doc_id")
    by = [quality_rules.score_quality(labelled.select("doc_id", "text"), trusted, keep=["doc_id"], array_buckets=n) for n in (0, 1 << 22)]
    joined, array = ([sorted((r["doc_id"], r["n_words"], round(r["log_ratio"], 9), round(r["ratio_without"] or 0.0, 9)) for r in x.collect()) for x in by])
    assert joined == array and len(array) == labelled.count()
    nothing = quality_rules.judge_quality(docs, trusted.limit(0), keep=["doc_id"])
    assert nothing.where("log_ratio <> 0 OR kept = base_failed").count() == 0


def test_quality_counts_are_sent_a_few_times_only(spark, labelled, monkeypatch):
    """Not once for every partition that has a bucket; a model that is no array takes the documents in blocks."""
    docs, trusted = labelled.select("doc_id", "text").repartition(24), labelled.where("quality = 1").select("doc_id")
    asked, joined = [], []
    count, join = quality_rules.gram_counts, quality_rules._means_by_join
    monkeypatch.setattr(quality_rules, "BLOCK_BUCKETS", quality_rules.LEAST_BUCKETS // 3)
    monkeypatch.setattr(quality_rules, "gram_counts", lambda marked, *a: asked.append(marked) or count(marked, *a))
    monkeypatch.setattr(quality_rules, "_means_by_join", lambda counted, *a: joined.append(counted.count()) or join(counted, *a))
    quality_rules.score_quality(docs, trusted, keep=["doc_id"]).collect()
    assert len(asked) == 1 and asked[0].rdd.getNumPartitions() <= quality_rules.COUNT_PARTS
    quality_rules.score_quality(docs, trusted, keep=["doc_id"], array_buckets=0).collect()
    parts = [m.count() for m in asked[1:]]
    assert sum(joined) == sum(parts) == docs.count() and len(joined) == len(parts) == 3 and max(joined + parts) < docs.count() / 2


def test_quality_blocks_hold_odd_rows(spark, monkeypatch):
    """Null and repeated doc_ids, copies, texts without words, trusted ids of another type."""
    monkeypatch.setattr(quality_rules, "BLOCK_BUCKETS", quality_rules.LEAST_BUCKETS // 3)
    rng = random.Random(8)
    rows = [(i % 50 or None, prose(rng, 40)) for i in range(120)]
    rows += [(200 + i, rows[1][1]) for i in range(5)] + [(300, None), (301, " \n"), (302, "one"), (303, ""), (1, rows[1][1])]
    docs, trusted = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i,) for i in range(0, 40, 2)] + [(None,), (2,)], "doc_id int")
    by = [quality_rules.score_quality(docs, trusted, keep=["doc_id"], array_buckets=n) for n in (0, 1 << 22)]
    rounded = lambda v: round(v, 9) if isinstance(v, float) else v
    joined, array = (sorted([tuple(rounded(v) for v in r) for r in x.select(*by[0].columns).collect()], key=str) for x in by)
    assert joined == array and len(array) == len(rows)


TONGUES = {"aa": "abra kadab ramak lota ", "bb": "xyzzy plugh quux fnord ", "cc": "ñandú señor mañana óleo "}


def test_language_id(spark, documents, empty):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(TONGUES[t].split()) + " " for _ in range(rng.choice([5, 60]))), t) for i, t in enumerate(list(TONGUES) * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = language_id.fit(df.where("doc_id % 5 <> 0"))
    got = language_id.identify(df, models, keep=["doc_id", "lang"]).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    odd = language_id.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "ж" * 90)], "doc_id bigint, text string"), models, keep=["doc_id"])
    by = {r["doc_id"]: r for r in odd.collect()}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by[4]["rejected"]
    assert language_id.identify(empty, models, keep=["doc_id"]).count() == 0
    assert language_id.identify(documents, models, keep=["doc_id"]).count() == documents.count()
    nothing = language_id.fit(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(df, nothing, keep=["doc_id"]).collect()} == {"und"}


def brute_models(rows):
    """Interpolated Kneser-Ney trigrams over letters, from dictionaries."""
    import math
    from collections import Counter, defaultdict

    def symbols(text):
        out = ["\0"]
        for c in text + " ":
            s = c.lower()[0] if c.isalpha() else "\0"
            if s != "\0" or out[-1] != "\0":
                out.append(s)
        return out

    def grams(text):
        s = symbols(text)
        return [(s[k - 2] if k > 1 else "\0", s[k - 1], s[k]) for k in range(1, len(s))]

    tri = defaultdict(Counter)
    for text, lang in rows:
        tri[lang].update(grams(text))
    alphabet = len({g[2] for c in tri.values() for g in c}) + 1

    def discount(counts):
        one, two = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
        return one / (one + 2 * two) if one and two else language_id.DISCOUNT

    def model(counts):
        f2 = Counter(g[1:] for g in counts)
        f1 = Counter(p[1] for p in f2)
        d3, d2, d1 = discount(counts), discount(f2), discount(f1)
        t1, k1 = sum(f1.values()), len(f1)
        t2, k2, t3, k3 = Counter(), Counter(), Counter(), Counter()
        for p, n in f2.items():
            t2[p[0]] += n
            k2[p[0]] += 1
        for g, n in counts.items():
            t3[g[:2]] += n
            k3[g[:2]] += 1

        def p(g):
            one = max(f1[g[2]] - d1, 0) / t1 + d1 * k1 / t1 / alphabet
            two = max(f2[g[1:]] - d2, 0) / t2[g[1]] + d2 * k2[g[1]] / t2[g[1]] * one if t2[g[1]] else one
            return max(counts[g] - d3, 0) / t3[g[:2]] + d3 * k3[g[:2]] / t3[g[:2]] * two if t3[g[:2]] else two

        return p

    models = {lang: model(c) for lang, c in tri.items()}

    def entropy(lang, text):
        own = grams(text)
        return -sum(math.log(models[lang](g)) for g in own) / len(own)

    return entropy


@pytest.mark.parametrize("shard_entries", [50, 10**6])
def test_language_models_against_brute_force(spark, shard_entries):
    rng = random.Random(21)
    rows = [("".join(rng.choice(TONGUES[t].split()) + rng.choice([" ", ". ", ""]) for _ in range(30)), t) for t in list(TONGUES) * 12]
    rows += [("日本語の文 です", "jp"), ("яблоко ёж", "ru"), ("яблоко ёж", "ru")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(3)
    counted = [tuple(r) for r in df.where(~language_id._fold(df)).select("text", "lang").collect()]
    entropy = brute_models(counted)
    langs = sorted({lang for _, lang in counted})
    models = language_id.fit(df, shard_entries)
    assert models.langs == langs and (len(models.shards) > 5) == (shard_entries == 50)
    odd = df.select("text").unionByName(spark.createDataFrame([("xyzzyabra Ärger жжя",), ("  ...b",), ("é",)], "text string"))
    for r in language_id.identify(odd, models, keep=["text"]).collect():
        want = {lang: entropy(lang, r["text"]) for lang in langs}
        assert r["lang_pred"] == min(langs, key=want.get) and abs(r["cross_entropy"] - min(want.values())) < 1e-4


def test_toxicity_scores_against_brute_force(spark, labelled, documents):
    """Scores from the model's weights and n-grams taken one by one."""
    import math

    import numpy as np

    held = F.col("doc_id") % 3 == 1
    model = toxicity.fit(labelled.select("doc_id", "text"), labelled.where(~held).select("doc_id", "toxic"))
    rows = toxicity.score_documents(documents.unionByName(spark.createDataFrame([(900, "Zorkfool! " * 40_000)], "doc_id bigint, text string"), allowMissingColumns=True), model, keep=["doc_id", "text"]).collect()
    one = lambda gram: [int(h[0]) for k, (h, _) in enumerate(toxicity._grams(*arrow(gram))) if len(gram) == toxicity.ORDERS[k]]

    def arrow(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return raw, np.array([0, len(raw)])

    for r in rows:
        folded = []
        for c in (r["text"] or "") + "\n":
            s = c.lower()[0] if c.isalpha() else " "
            if s != " " or not folded or folded[-1] != " ":
                folded.append(s)
        grams = {"".join(folded[k : k + n]) for n in toxicity.ORDERS for k in range(len(folded) - n + 1)}
        slots = {int(model.slot[h]) for g in grams for h in one(g)} - {-1}
        z = model.bias + sum(model.weight[k] for k in slots)
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-5, r["doc_id"]


def test_quality_words_leave_the_document_out(spark):
    """Documents that differ in their words alone; a labelled document's own rare words do not speak for it."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["calm", "clear", "sound"] if i % 2 else ["buyy", "nowx", "clik"]) + f" {w} id{rng.random()}" for w in prose(rng, 30).split()), f"s{i % 5}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality_classifier.judge_documents(docs, labels, keep=["doc_id"], threshold=0.5).collect()}
    assert sum(got[i]["kept"] == bool(i % 2) for i in range(200, 300)) >= 97
    model = quality_classifier.word_model(docs.select("doc_id", "text"), labels.withColumnRenamed("quality", "good"))
    assert model.rows.tolist() == [100, 100] and (model.ratios(1) <= model.ratios(None) + 1e-9).any()


def test_quality_sites_leave_the_document_out(spark):
    """The prior of a document is its site's without it, worked out by hand."""
    text = "plain words here " * 9
    rows = [(i, text, f"h{i % 3}", f"p{i % 2}") for i in range(12)] + [(12, text, "alone", "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(13)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["site_prior"] for r in quality_classifier.judge_documents(docs, labels, keep=["doc_id"]).collect()}
    vote = {i: float(i % 4 == 0) for i in range(13)}
    at = {i: (h, p) for i, _, h, p in rows}
    overall = (sum(vote.values()) + 1) / (len(vote) + 2)

    def strength(groups):
        n = sum(m for m, _, _ in groups)
        within, between = sum(m * a * (1 - a) for m, _, a in groups) / n, sum(m * (r - a) ** 2 for m, r, a in groups) / n
        return min(max(within / max(between - within / (n / len(groups)), 1e-6) - 1, 2.0), 10_000.0)

    hosts = {h: [i for i in vote if at[i][0] == h] for h, _ in at.values()}
    sites = {s: [i for i in vote if at[i] == s] for s in at.values()}
    rate = lambda ids: sum(vote[i] for i in ids) / len(ids)
    kh = strength([(len(ids), rate(ids), overall) for ids in hosts.values()])
    above = {h: (sum(vote[i] for i in ids) + kh * overall) / (len(ids) + kh) for h, ids in hosts.items()}
    kp = strength([(len(ids), rate(ids), above[s[0]]) for s, ids in sites.items()])
    for i in vote:
        h, s = hosts[at[i][0]], sites[at[i]]
        up = (sum(vote[j] for j in h) - vote[i] + kh * overall) / (len(h) - 1 + kh)
        want = (sum(vote[j] for j in s) - vote[i] + kp * up) / (len(s) - 1 + kp)
        assert abs(got[i] - min(max(want, 0.001), 0.999)) < 1e-9
