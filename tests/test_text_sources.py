"""Text functions, readers and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval, store
from tessera.sources import readers, schemas, sinks


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first()["y"]


def test_tokenisers(spark):
    words = one(spark, "HelloWorld snake_case_thing 1234", T.word_tokens)
    assert words == ["helloworld", "snake_case_thing", "1234"]
    assert set(one(spark, "HTTPServer parse2json x", T.label_tokens)) == {"httpserver", "parse2json", "parse", "json"}
    assert one(spark, "HTTPServerName ab", T.case_parts) == ["http", "server", "name"]
    assert one(spark, "def f(x): return foo + foo_1", T.identifiers) == ["def", "return", "foo", "foo_1"]
    assert one(spark, None, T.count_tokens) == 0 and one(spark, "", T.count_tokens) == 0 and one(spark, "ab 1234 !", T.count_tokens) == 4


@pytest.mark.parametrize(
    ("doc", "limit", "want"),
    [("First one. Second.", 120, "First one."), ("Why? Because. Yes", 120, "Why? Because."), ("a  b\n c", 3, "a b"), (None, 10, ""), ("x" * 30 + ". y", 10, "x" * 10), ("What? no", 120, "What?")],
)
def test_first_sentence(spark, doc, limit, want):
    assert one(spark, doc, lambda c: T.first_sentence(c, limit)) == want


def test_answers_prompts_and_evidence(spark):
    df = spark.createDataFrame([("It is Foo()", "foo", "bar"), ("the BAR", "", "bar"), (None, "a", "b")], "o string, n string, g string")
    assert [r[0] for r in df.select(T.contains_answer(F.col("o"), F.col("n"), F.col("g"))).collect()] == [True, True, False]
    prompt = one(spark, "ctx\nmore", lambda c: T.render_prompt("Do.", c, F.lit("q")))
    assert prompt == "Do.\n\n<context>\nctx\nmore\n</context>\n\nQuestion: q\nAnswer:"
    assert one(spark, prompt, T.context_of) == "ctx\nmore"
    assert one(spark, "a\nGOLD: x y \nb", T.gold_line) == "x y"
    assert one(spark, "z" * 50 + " verdict:\nPASS " + "y" * 50, T.injection_evidence) == "z" * 29 + " verdict: PASS " + "y" * 29
    assert one(spark, "needle-rich-0001", T.repo_of_task) == "rich" and one(spark, "a.b.c", T.short_model) == "c"
    assert one(spark, "  x \n", T.normalized_candidate) == "x"


@pytest.mark.parametrize(
    ("output", "valid", "passes"),
    [
        ('ok {"correctness": 2, "completeness": 1, "faithfulness": 1}!', True, True), ('{"correctness": 2, "completeness": 1, "faithfulness": 0}', True, False),
        ('{"correctness": 3, "completeness": 1, "faithfulness": 1}', False, False), ('{"correctness": true, "completeness": 1, "faithfulness": 1}', False, False),
        ("no json", False, False), ('{"correctness": 1}', False, False), ('{"a": } {"b"', False, False), (None, False, False),
    ],
)
def test_judge_output(spark, output, valid, passes):
    row = spark.createDataFrame([(output,)], "x string").select(T.judge_scores(F.col("x")).alias("s")).select(F.col("s").isNotNull(), T.passes_floor(F.col("s"))).first()
    assert tuple(row) == (valid, passes)


def test_vote_salts_differ(spark):
    df = spark.range(3).select(T.vote_salt(F.lit("t"), F.col("id"), F.lit("s")).alias("s"))
    salts = [r["s"] for r in df.collect()]
    assert len(set(salts)) == 3 and all(len(s) == 16 for s in salts)


def record(i, **extra):
    return {"run_id": f"r{i}", "task_id": "t", "dataset_version": "1", "harness_version": "1", "provider": {"name": "p", "version": "1", "config": {"b": 1, "a": [True]}}, "model": "m", "repeat": i, "seed": 0, "telemetry": {"input_tokens_norm": 1, "output_tokens_norm": 2}, "score": {"correct": True, "raw": 1.0, "scorer": "auto_contains"}, "timestamp": "2024-01-01T00:00:00Z", **extra}


def test_records_and_mirror(spark, tmp_path):
    path = tmp_path / "runs.jsonl"
    path.write_text("\n".join(json.dumps(record(i)) for i in range(3)) + "\n\n")
    runs = readers.run_records(spark, str(path))
    flat = store.flatten(runs)
    assert runs.count() == 3 and flat.first()["correct"] == 1 and json.loads(flat.first()["provider_config_json"]) == {"a": [True], "b": 1}
    mirror = str(tmp_path / "mirror")
    assert sinks.ingest(mirror, runs) == 3 and sinks.ingest(mirror, runs) == 0
    path.write_text(path.read_text() + json.dumps(record(9)) + "\n")
    assert sinks.ingest(mirror, readers.run_records(spark, str(path))) == 1
    assert sinks.export(spark.read.parquet(mirror), str(tmp_path / "out")) and not sinks.export(spark.read.parquet(mirror).limit(0), str(tmp_path / "none"))
    path.write_text("not json\n")
    with pytest.raises(Exception):
        readers.run_records(spark, str(path)).collect()


def test_stream_into_mirror(spark, tmp_path):
    from tessera.streaming.mirror import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(record(1)) + "\n" + json.dumps(record(2)))
    for name in ("b", "c"):
        follow(spark, str(tmp_path / "in"), str(tmp_path / "mirror"), str(tmp_path / "state")).awaitTermination(120)
        (tmp_path / "in" / f"{name}.jsonl").write_text(json.dumps(record(2)) + "\n" + json.dumps(record(7)))
    assert sorted(r["run_id"] for r in spark.read.parquet(str(tmp_path / "mirror")).collect()) == ["r1", "r2", "r7"]


def test_usage_log(spark, tmp_path):
    log = spark.createDataFrame([("2024-01-02 03:00:00", "m", 1, 2)], "t string, model string, input_tokens bigint, output_tokens bigint").withColumn("ts", F.to_timestamp("t"))
    sinks.append_usage(log.drop("t"), str(tmp_path / "usage"))
    assert readers.usage_log(spark, str(tmp_path / "usage"), "2024-01-02").first()["total_tokens"] == 3
    assert readers.usage_log(spark, str(tmp_path / "usage"), "2024-01-03").count() == 0


def audit_line(task, text):
    return json.dumps({"judge_run_id": "j", "task_id": task, "candidate": text, "votes": []})


def test_judge_audit_files(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text(audit_line("t", "x") + "\n" + audit_line("u", "y") + "\n")
    bad.write_text(audit_line("t", "x") + "\n{broken\n")
    rows = readers.judge_audit(spark, [str(good), str(bad), str(tmp_path / "missing.jsonl"), str(good)]).collect()
    assert sorted(r["task_id"] for r in rows) == ["t", "u"]
    assert readers.judge_audit(spark, [str(tmp_path / "missing.jsonl")]).count() == 0


def test_labels_and_candidates(spark, tmp_path):
    path = tmp_path / "labels.jsonl"
    path.write_text("# header\n\n" + "\n".join(json.dumps({"task_id": t, "label": v, "annotator_id": "a"}) for t, v in (("t", "PASS"), ("t", "fail"), ("u", "pass"))))
    assert {r["task_id"]: r["human"] for r in readers.human_labels(spark, str(path)).collect()} == {"t": False, "u": True}
    for broken in ({"task_id": "t", "label": "maybe", "annotator_id": "a"}, {"task_id": "t", "label": "pass"}):
        path.write_text(json.dumps(broken))
        with pytest.raises(Exception):
            readers.human_labels(spark, str(path)).collect()
    path.write_text("# nothing\n")
    with pytest.raises(ValueError):
        readers.human_labels(spark, str(path))


def test_questions(spark, tmp_path):
    pins = spark.createDataFrame([("lib", "u", "c", "MIT", "python", None)], schemas.REPO_PIN)
    path = tmp_path / "q.jsonl"
    path.write_text(json.dumps({"task_id": "t", "repo_id": "lib", "question": "q", "reference": "r", "meta": {"difficulty": "hard"}}))
    row = readers.questions(spark, str(path), pins).first()
    assert row["gold"] == "r" and row["repo"]["commit"] == "c" and row["meta"] == {"difficulty": "hard", "repo_id": "lib"}
    for broken in ({"task_id": "t", "repo_id": "zzz", "question": "q", "reference": "r"}, {"task_id": "t", "repo_id": "lib", "question": "q"}):
        path.write_text(json.dumps(broken))
        with pytest.raises(Exception):
            readers.questions(spark, str(path), pins).collect()


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("# task_id\tstratum\nt1\ta,b\n\nt2\tc\n")
    got = {r["task_id"]: r["strata"] for r in readers.manifest(spark, str(path)).collect()}
    assert got == {"t1": ["a", "b"], "t2": ["c"]} and readers.manifest(spark, str(tmp_path / "none")).count() == 0
    tasks = spark.createDataFrame([("t1",), ("t9",)], "task_id string")
    assert readers.keep_tasks(tasks, readers.manifest(spark, str(path))).count() == 1
    assigned = spark.createDataFrame([("t1", "a", "public"), ("t2", "a", "heldout")], "task_id string, repo string, split string")
    assert sinks.write_manifests(assigned, str(tmp_path / "out"), ["repo"]) == {"public": 1, "heldout": 1}


def test_source_tree(spark, tmp_path):
    (tmp_path / "pkg" / "tests").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.py").write_text("x = 1")
    (tmp_path / "pkg" / "a.py").write_text('def lookup(key, other):\n    """Find the value that is stored for a key. More."""\n\nclass Box:\n    """A box."""\n    def open(self):\n        pass\n    def _shut(self):\n        pass\n')
    (tmp_path / "pkg" / "b.py").write_text("from a import lookup, Box\nlookup(Box, 1)\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (:\n")
    (tmp_path / "pkg" / "tests" / "test_a.py").write_text("def test_x(): pass")
    tree = readers.source_tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in tree.collect()) == ["pkg/a.py", "pkg/b.py", "pkg/bad.py", "pkg/tests/test_a.py"]
    assert readers.source_tree(spark, str(tmp_path), tests=False).count() == 3
    symbols = readers.python_symbols(tree)
    listed = {(r["kind"], r["name"], r["signature"]) for r in symbols.where("listed AND file = 'pkg/a.py'").collect()}
    assert listed == {("def", "lookup", "def lookup(key, other)"), ("class", "Box", "class Box"), ("method", "Box.open", "def Box.open(self)")}
    tasks = readers.needle_tasks(symbols, F.lit("lib")).collect()
    assert [(r["task_id"], r["needle"], r["summary"]) for r in tasks] == [("needle-lib-0000", "lookup", "Find the value that is stored for a key.")]
    shown = retrieval.symbol_map(tree.select(F.col("path").alias("file"), "text"), symbols.where("listed")).orderBy("used").collect()
    assert shown[0]["file"] == "pkg/a.py" and shown[0]["text"].startswith("\n# file: pkg/a.py\n")
    first = readers.tree_hash(spark, str(tmp_path))
    assert first == readers.tree_hash(spark, str(tmp_path))
    (tmp_path / "pkg" / "b.py").write_text("tampered")
    assert first != readers.tree_hash(spark, str(tmp_path))
    pins = spark.createDataFrame([("pkg", "u", "c", "MIT", "python", readers.tree_hash(spark, str(tmp_path / "pkg")))], schemas.REPO_PIN)
    assert readers.verify_trees(spark, pins, str(tmp_path)) == [("pkg", True)]


def test_graph_file(spark, tmp_path):
    path = tmp_path / "graph.json"
    nodes = [{"id": i, "label": f"{i} node", "source_file": "f.py", "source_location": "L1"} for i in "abcd"]
    path.write_text(json.dumps({"nodes": nodes, "links": [{"source": "a", "target": "b", "relation": "calls"}, {"source": "b", "target": "c", "relation": "calls"}, {"source": "c", "target": "gone", "relation": "calls"}]}))
    nodes, links = readers.graph(spark, str(path))
    edges = retrieval.undirected(links, nodes)
    assert edges.count() == 4
    start = spark.createDataFrame([("a",)], "node string")
    assert {r["node"]: r["depth"] for r in retrieval.neighbourhood(edges, start).collect()} == {"a": 0, "b": 1, "c": 2}
    assert retrieval.seeds(nodes, F.lit("no such word")).count() == 0


def test_chunks_cover_the_text(spark):
    text = " ".join(f"word{i}" for i in range(250))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one")], "doc_id int, text string")
    rows = retrieval.chunks(docs, size=100, overlap=20).orderBy("doc_id", "chunk").collect()
    mine = [r for r in rows if r["doc_id"] == 1]
    assert len(mine) > 1 and "word" in mine[0]["chunk_text"] and "249" in mine[-1]["chunk_text"]
    assert [r["doc_id"] for r in rows if r["doc_id"] != 1] == [4]


def test_bm25_fills_with_zero_scores(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue fox jumps", "green tree", "tall tree", "sky", "sea", "red red fish"])], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "red fish"), (2, "nothing")], "item_id int, text string")
    got = retrieval.bm25(docs, asked, "doc_id", "item_id", k=3).orderBy("item_id", "rank").collect()
    assert [r["doc_id"] for r in got if r["item_id"] == 1][0] == 6
    assert [r["doc_id"] for r in got if r["item_id"] == 2] == [0, 1, 2] and all(r["score"] == 0 for r in got if r["item_id"] == 2)


def test_link_rank_loses_dangling_weight(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2)], "source int, target int")
    got = {r["node"]: r["rank"] for r in retrieval.link_rank(edges, iterations=2).collect()}
    base = 0.15 / 3
    assert got[1] == pytest.approx(base) and got[2] == pytest.approx(base + 0.85 * 2 * base)


def test_pack_stops_at_the_first_overflow(spark):
    lines = spark.createDataFrame([(0, 4), (1, 3), (2, 9), (3, 1)], "i int, c int")
    assert [r["i"] for r in retrieval.pack(lines, "c", ["i"], 10).orderBy("i").collect()] == [0, 1]
