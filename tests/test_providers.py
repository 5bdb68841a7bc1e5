import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import COUNTER_PATTERN, WORD_PATTERN
from tessera.operators import bootstrap, calibration, judge, leaderboard, providers, retrieval, store
from tessera.sources import sinks


@pytest.fixture(scope="module")
def tasks(spark):
    return spark.createDataFrame([("t1", "where is parse_url defined", "auto_contains", "parse_url"), ("t2", "why does the retry loop end", "llm_judge", "g")], "task_id string, question string, scoring string, gold string")


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"m{k}.py", " ".join(f"word{(k * j) % 37}" for j in range(90 + 60 * k)) + (" parse_url here" if k == 3 else " retry loop" if k % 2 else "")) for k in range(6)]
    return spark.createDataFrame([*rows, ("empty.py", "")], "file string, text string")


def brute_rag(rows, question):
    chunks = []
    for file, text in rows:
        tokens = re.findall(COUNTER_PATTERN, text)
        for start in range(0, len(tokens), 160):
            chunks.append((f"{file}#{start // 160:08d}", file, " ".join(tokens[start : start + 200]), len(tokens[start : start + 200])))
            if start + 200 >= len(tokens):
                break
    words = [[w.lower() for w in re.findall(WORD_PATTERN, c[2])] for c in chunks]
    n, mean = len(chunks), sum(map(len, words)) / len(words)
    df = Counter(w for ws in words for w in set(ws))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    scores = []
    for ws in words:
        tf = Counter(ws)
        scores.append(sum((raw[w] if raw[w] >= 0 else low) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in re.findall(WORD_PATTERN, question.lower()) if w in tf))
    best = sorted(range(n), key=lambda i: (-round(scores[i], 9), chunks[i][0]))[:5]
    return "\n\n".join(f"# file: {chunks[i][1]}\n{chunks[i][2]}" for i in best), sum(c[3] for c in chunks)


def test_rag_against_brute_force(tasks, files):
    rows = [tuple(r) for r in files.collect()]
    got = {r["task_id"]: r for r in providers.rag(tasks, files).collect()}
    for t in tasks.collect():
        context, cost = brute_rag(rows, t["question"])
        assert f"<context>\n{context}\n</context>" in got[t["task_id"]]["prompt"]
        assert got[t["task_id"]]["build_tokens"] == cost
    assert got["t1"]["prompt"].startswith(providers.STANDARD) and got["t2"]["prompt"].startswith(providers.FREEFORM)
    with pytest.raises(Exception, match="no chunks"):
        providers.rag(tasks, files.limit(0)).collect()


def test_raw_dump_is_cut_at_the_budget(tasks, files):
    whole = "\n\n".join(f"# file: {r['file']}\n{r['text']}" for r in files.orderBy("file").collect())
    assert providers.dump_text(files, 10**6).first()["text"] == whole
    cut = providers.dump_text(files, 150).first()["text"]
    assert len(re.findall(COUNTER_PATTERN, cut)) == 150 and whole.startswith(cut)
    assert providers.dump_text(files.limit(0)).first()["text"] == ""


def test_fixed_contexts(tasks):
    zero = {r["task_id"]: r for r in providers.zero_context(tasks).collect()}
    assert "<context>\n\n</context>" in zero["t1"]["prompt"] and zero["t1"]["build_tokens"] == 0
    gamed = providers.exploit_baseline(tasks).first()["prompt"]
    assert "parse_url" not in gamed.replace("where is parse_url defined", "") and providers.JUDGE_NOTE in gamed
    counts = {n: providers.mock(tasks, n).first() for n in providers.MOCKS}
    assert counts["mock-raw"]["prompt"].count("word ") == 3999 and counts["mock-graphify"]["build_tokens"] == 200_000


def test_map_ranks_files_without_links(spark, tasks):
    nothing = spark.createDataFrame([], "source string, target string")
    assert retrieval.link_rank(nothing).collect() == []
    symbols = spark.createDataFrame([("b.py", "beta", "def beta()", ""), ("a.py", "alpha", "def alpha()", "Says."), ("c.py", "gamma", "def gamma()", "")], "file string, name string, signature string, summary string")
    texts = spark.createDataFrame([("b.py", "alpha()"), ("a.py", "x"), ("c.py", "")], "file string, text string")
    ranks = {r["node"]: r["rank"] for r in retrieval.link_rank(retrieval.reference_edges(texts, symbols), nodes=texts.select(F.col("file").alias("node"))).collect()}
    want = {f: 1 / 3 for f in ("a.py", "b.py", "c.py")}
    for _ in range(30):
        want = {"a.py": 0.05 + 0.85 * want["b.py"], "b.py": 0.05, "c.py": 0.05}
    assert all(abs(ranks[f] - want[f]) < 1e-12 for f in want)
    lines = [r["text"] for r in retrieval.symbol_map(texts, symbols).orderBy("place").collect()]
    assert [re.search(r"file: (\S+)", x)[1] for x in lines] == ["a.py", "b.py", "c.py"]
    alone = retrieval.symbol_map(texts.where("file = 'c.py'"), symbols.where("file = 'c.py'")).collect()
    assert len(alone) == 1
    prompt = providers.repo_map(tasks, texts, symbols).first()
    assert "# file: a.py\n  def alpha()  — Says.\n" in prompt["prompt"] and prompt["build_tokens"] > 0


def test_judge_guards_and_votes(spark):
    for votes, model in ((1, "j"), (4, "j"), (3, "answers")):
        with pytest.raises(ValueError):
            judge.guard(votes, model, ["answers"])
    rows = spark.createDataFrame([("t", "q", "r", " c ", "llm_judge")], "task_id string, question string, reference string, candidate string, scoring string")
    say = lambda prompt, k: F.when(k == 1, "sorry").otherwise('{"correctness": 2, "completeness": 1, "faithfulness": 1}')
    r = judge.judged(rows, say, judge_model="j", answering=["answers"], run="x").first()
    assert (r["pass_count"], r["correct"], round(r["raw"], 3), r["trace_uri"]) == (2, True, 0.667, "x.jsonl")
    assert [v["parse_error"] for v in r["votes"]] == [False, True, False] and len({v["prompt"] for v in r["votes"]}) == 3
    with pytest.raises(Exception, match="not for a judge"):
        judge.judged(rows.withColumn("scoring", F.lit("auto_contains")), say, judge_model="j", answering=[], run="x").collect()


def test_leaderboard_counts_records(spark):
    """Tasks of unequal repeats: accuracy is over records, the interval over tasks."""
    rows = [("needle-a-1", 1), ("needle-a-1", 1), ("needle-a-1", 1), ("needle-a-2", 0), ("swe-1", 0), ("swe-1", 1)]
    runs = spark.createDataFrame([(t, "p", "v.m", k, ok, 10, 1, 5) for k, (t, ok) in enumerate(rows)], "task_id string, provider string, model string, repeat int, correct int, input_tokens bigint, output_tokens bigint, build_tokens bigint")
    manifest = spark.createDataFrame([(t, "heldout" if t == "needle-a-2" else "public") for t, _ in rows], "task_id string, split string")
    split = leaderboard.with_split(runs, manifest)
    board = {r["family"]: r["accuracy"] for r in leaderboard.by_family(split, interval=bootstrap.hashed_ci).collect()}
    assert board == {"needle": 0.75, "swe_qa": 0.5}
    text = leaderboard.report(split, interval=bootstrap.hashed_ci)
    assert "# needle (public)" in text and "No records for swe_qa (heldout)" in text and "| p × m | 1.000 | 0.000 | +1.000 | no |" in text


def test_store_extras(spark, tmp_path):
    runs = spark.createDataFrame([("t", "p", "m", 0), ("t", "q", "n", 1)], "task_id string, provider string, model string, repeat int")
    assert store.resumable(runs, [], [], 2).count() == 2 and store.resumable(runs, ["q"], [], 2).count() == 1
    assert store.cell_count(3, ["a", "b"], ["m"], 5) == 30
    humans = spark.createDataFrame([("t", True), ("u", False)], "task_id string, human boolean")
    assert calibration.voted(humans, spark.createDataFrame([("t", [1])], "task_id string, votes array<int>")).count() == 1
    sinks.write_sample(runs.select("task_id"), str(tmp_path / "s"), ("seed 7", "two rows"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert lines == ["# seed 7", "# two rows", '{"task_id":"t"}', '{"task_id":"t"}']


def test_needles_at_word_edges(spark):
    docs = spark.createDataFrame([(1, "Concatenate the Red Bolt now"), (2, "the red bolts"), (3, None), (4, "red")], "doc_id int, text string")
    needles = spark.createDataFrame([(1, "cat"), (2, "ate the red bolt"), (3, "red"), (4, "the redder bolt"), (5, "e RED b")], "item_id int, text string")
    got = sorted(map(tuple, retrieval.containing(docs, needles, "doc_id", "item_id").collect()))
    low = {d: (t or "").lower() for d, t in docs.collect()}
    assert got == sorted((d, i) for d, t in low.items() for i, n in needles.collect() if n.lower() in t)
