import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm.queries")
from tessera.llm import chat_format, decontaminate, near_dup, url_filter  # noqa: E402

from .conftest import prose  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge(url, rules):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    raw = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    host = raw.translate(LOWER)
    best = None
    for rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best, rules[best] if best else "allow"


def test_url_filter(spark):
    rng = random.Random(3)
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.NET?x", "http://xnet/", "http://m.example.net/en/", "ftp://example.net/en", "http://x.org/fr/a#b", "http://org/fr/", "x://example.com/de/y?z", "http://a.b.c.example.com/de//", "http://é.net/é"]
    urls += [f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(['example.net', 'example.com', 'org', 'net', 'other.io'])}{rng.choice(['', '/', '/en/', '/de/x', '/fr/'])}" for _ in range(60)]
    pages = spark.createDataFrame([(i // 2, u, 1) for i, u in enumerate(urls)], "page_id bigint, url string, host int")
    many = {**url_filter.PAGE_RULES, **{f"host{i}.io/p{i}/": "block" for i in range(500)}}
    for rules in (url_filter.PAGE_RULES, many, {}):
        listed = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
        got = url_filter.filter_urls(pages, listed, keep=["page_id", "url"]).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((i // 2, u, *judge(u, rules))) for i, u in enumerate(urls))
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame([("net/", "block")], "rule string, verdict string"), keep=["page_id"]).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(400).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    words = url_filter.bloom_words(keys, 32)
    mask = url_filter._word_mask(F.col("key"))
    word = F.element_at(words.scalar(), url_filter._block(F.col("key"), 32) + F.lit(1))
    assert keys.where(word.bitwiseAND(mask) != mask).count() == 0


def test_chat_round_trip(spark):
    texts = ["plain", "", None, "<|im_end|>", "a<|im_start|>user\nx<|im_end|>\n", "back\\slash \\b \\p <|", "<|esc|>\n", "ends with <", "\n\n", "<\\p|"]
    rows = [(c, t, "assistant" if t % 2 else "user", x, "z") for c, x in enumerate(texts) for t in range(3)]
    rows += [(90, 1, "user", "tie b", "z"), (90, 1, "user", "tie a", "z"), (90, None, None, "first", "z"), (91, 0, "odd\nrole", "x", "z"), (None, 0, "user", "no id", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(df).collect()}
    assert len(got) == len(texts) + 3 and all(r["round_trip"] for r in got.values())
    assert [t["text"] for t in got[90]["turns"]] == ["first", "tie a", "tie b"]
    assert got[91]["escaped"] and not got[0]["escaped"] and got[3]["escaped"] and got[4]["escaped"]
    assert "<|im_end|><|im_end|>" not in got[3]["formatted"]
    assert chat_format.format_conversations(df.limit(0)).count() == 0
    for r in got.values():  # the mask covers the assistant's texts as they stand in the output
        spans = [r["formatted"][m["begin"] : m["end"]] for m in r["loss_mask"]]
        own = [t["text"] if t["role"] == "assistant" else "" for t in r["turns"]]
        undone = [s.replace("\\p", "|").replace("\\b", "\\") if r["escaped"] else s for s in spans]
        assert undone == own


def test_mask_of_a_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t} é<|im_end|>" if t % 97 == 0 else f"text {t}") for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    done = chat_format.format_conversations(df)
    r = done.withColumn("loss", chat_format.under_mask(F.col("formatted"), F.col("loss_mask"))).first()
    assert r["round_trip"] and "".join(r["loss"]) == "".join(x[3] for x in rows if x[2] == "assistant")
    assert all(r["formatted"][m["base"] :].startswith(chat_format.START) for m in r["loss_mask"])


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def contamination(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    out = {}
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontaminate_against_brute_force(spark, documents, corpus, empty, block_bytes):
    rng = random.Random(4)
    take = [corpus[k][1] for k in (2, 3, 4, 65)]
    items = [(i, " ".join(t.split()[3:25])) for i, t in enumerate(take)] + [(10, "One"), (11, "two WORDS"), (12, ""), (13, None), (None, prose(rng, 12)), (14, " ".join(take[2].split()[8:18])), (3, "aaa bbb")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_contamination(documents, bench, keep=["doc_id"], block_bytes=block_bytes).collect()
    assert {r["doc_id"]: (r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), r["items"]) for r in got} == contamination(corpus, items)
    assert decontaminate.find_contamination(empty, bench, keep=["doc_id"]).count() == 0
    assert {len(r["items"]) for r in decontaminate.find_contamination(documents, bench.limit(0), keep=["doc_id"]).collect()} == {0}


def test_blocks_pass_one_by_one(spark, documents, corpus):
    """Twenty blocks are one scan of the documents; each is given up before the next."""
    rng = random.Random(14)
    items = [(i, prose(rng, 30)) for i in range(40)] + [(99, " ".join(corpus[4][1].split()[:12]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    blocks = decontaminate._blocks(bench, 10, 300)
    assert len(blocks) >= 20
    found = decontaminate.find_contamination(documents, bench, keep=["doc_id"], block_bytes=300)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got = {r["doc_id"]: (r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), r["items"]) for r in found.collect()}
    assert got == contamination(corpus, items)


def test_texts_longer_than_a_shard(monkeypatch):
    rng = random.Random(15)
    text = prose(rng, 3000)
    items = [(str(k), " ".join(text.split()[k * 100 + 95 : k * 100 + 107])) for k in range(25)] + [("x", text.split()[7])]
    w = decontaminate.Windows([(i, t.encode()) for i, t in items], 10)
    for size in (100, 700, 10**6):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        n, spans, found = decontaminate._whole(text.encode(), w, 10)
        assert (n, sum(b - a for a, b in spans), sorted(found)) == contamination([(1, text)], items)[1]
    assert decontaminate._whole(b"", w, 10) == (0, [], set())


def test_removed_spans(spark):
    docs = spark.createDataFrame([(1, "Keep this. Benchmark passage of ten words stands right here in full text now, and keep that.", 0), (2, None, 0), (3, "clean", 5), (4, "benchmark passage of ten words stands right here in full text now", 0)], "doc_id bigint, text string, n_chars bigint")
    bench = spark.createDataFrame([(1, "benchmark passage of ten words stands right here in full text now")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.remove_spans(docs, bench).collect()}
    assert got[1]["text"] == "Keep this. , and keep that." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["n_chars"] == 5 and 4 not in got


def test_fm_index():
    rng = np.random.default_rng(2)
    seq = rng.integers(0, 4, 400)
    seq[-1] = 0
    index = decontaminate.FMIndex(seq)
    for size in (1, 2, 4):
        patterns = rng.integers(1, 5, (30, size))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [k for k in range(len(seq) - size + 1) if (seq[k : k + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def shingle_set(text, width):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near(rows, width):
    sets = {i: shingle_set(t, width) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_against_brute_force(documents, corpus, empty, width):
    got = {r[0]: tuple(r)[1:] for r in near_dup.near_duplicates(documents, width=width).collect()}
    assert got == near(corpus, width)
    assert near_dup.near_duplicates(empty).count() == 0


def test_chains_of_versions(spark):
    """Versions that drift apart are linked only through each other."""
    rng = random.Random(8)
    rows, i = [], 0
    for _ in range(4):
        text = prose(rng, 150).split()
        for _ in range(12):
            rows.append((i, " ".join(text)))
            i += 1
            for _ in range(3):
                text[rng.randrange(len(text))] = f"new{i}{rng.random()}"
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r[0]: tuple(r)[1:] for r in near_dup.near_duplicates(df, width=4).collect()} == near(rows, 4)


def test_missing_and_repeated_ids(spark):
    text = "some words that stand in every row of this little table"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text), (7, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 5, False), (5, 5, True), (5, 5, True), (9, 5, False), (7, 7, True)], key=str)


def test_repeated_ids_with_different_texts(spark):
    """Every text of a repeated doc_id keeps its links, and the doc_id is one node."""
    rng = random.Random(3)
    a, b = prose(rng, 40), prose(rng, 40)
    df = spark.createDataFrame([(5, a), (5, b), (8, a + " x"), (9, b + " x"), (10, prose(rng, 40))], "doc_id bigint, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect()}
    assert got == {(5, 5, True), (8, 5, False), (9, 5, False), (10, 10, True)}


def test_words_of_equal_polynomials_differ(spark):
    """A Thue-Morse word and its complement agree in every polynomial hash modulo a power of two."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    rows = [(i, "".join("ab"[x ^ i] for x in bits)) for i in (0, 1)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r["kept"] for r in got)


def test_long_lists_lose_no_pair(documents, corpus):
    got = {r[0]: tuple(r)[1:] for r in near_dup.near_duplicates(documents, width=4, long_list=0).collect()}
    assert got == near(corpus, 4)


def test_very_long_texts_are_compared_as_a_whole(spark):
    rng = random.Random(11)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(90_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2]), (4, "x" * 700_000), (5, "x" * 700_000), (6, "x" * 700_001)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r[0]: r["component_id"] for r in near_dup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_sketches_pass_every_link():
    """Recall of the signature threshold and of the sketches over sets at a similarity just over 0.8."""
    rng = np.random.default_rng(4)
    lost = far = 0
    for k in range(2000):
        n = int(rng.integers(30, 3000))
        common = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        extra = rng.integers(0, 1 << 64, n // 4, dtype=np.uint64)
        x, y = np.unique(np.concatenate([common, extra[: n // 8]])), np.unique(np.concatenate([common, extra[n // 8 :]]))
        far += (near_dup.signature(x) != near_dup.signature(y)).sum() > near_dup.MAX_DISTANCE
        lost += not near_dup._may_link(near_dup.sketch(x)[None], near_dup.sketch(y), np.array([len(x) + len(y)]))[0]
    assert lost == 0 and far <= 2
