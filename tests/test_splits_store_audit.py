import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, splits, store, usage


@pytest.mark.parametrize(("size", "held"), [(5, 1), (10, 2), (1, 0)])
def test_heldout_sizes(spark, size, held):
    items = spark.createDataFrame([(f"t{i:02d}", "r") for i in range(size)], "task_id string, repo string")
    got = splits.assign_splits(items, ["repo"]).where("split = 'heldout'").orderBy("task_id").collect()
    assert [r["task_id"] for r in got] == [f"t{i:02d}" for i in range(size - held, size)]


def test_strata(spark):
    items = spark.createDataFrame([(f"t{i}{r}{d}", r, d) for i in range(5) for r in "ab" for d in "xy"], "task_id string, repo string, difficulty string")
    counts = splits.stratum_counts(splits.assign_splits(items, ["repo", "difficulty"]), ["repo", "difficulty"]).collect()
    assert len(counts) == 4 and all((r["public"], r["heldout"]) == (4, 1) for r in counts)
    assert splits.assign_splits(items.limit(0), ["repo"]).count() == 0


def test_largest_remainder_and_sample(spark):
    weights = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "s string, weight bigint")
    got = {r["s"]: r["slots"] for r in splits.largest_remainder(weights, 4, ties=["s"]).collect()}
    assert got == {"a": 2, "b": 1, "c": 1} or sum(got.values()) == 4
    items = spark.createDataFrame([(f"{s}{i}", s) for s in "abc" for i in range(5)], "task_id string, s string")
    sample = splits.stratified_sample(items, splits.largest_remainder(weights, 4, ties=["s"]), ["s"], F.xxhash64("task_id"))
    assert {r["s"]: r["count"] for r in sample.groupBy("s").count().collect()} == got


def test_sweep_is_idempotent(spark):
    tasks = spark.createDataFrame([(f"t{i}", i) for i in range(4)], "task_id string, task_index bigint")
    ready = lambda cells: cells.withColumn("gold", F.col("task_id")).withColumn("needle", F.lit("")).withColumn("prompt", F.concat(F.lit("GOLD: "), F.col("task_id")))
    keys = ["task_id", "provider", "model", "repeat"]
    empty = spark.createDataFrame([], "task_id string, provider string, model string, repeat int")
    first = store.sweep(tasks, empty, ready, ["p"], ["m"], 2)
    assert first.count() == 8 and first.select("seed").distinct().count() == 8
    assert first.where("output = gold").count() == first.where("correct = 1").count()
    assert store.sweep(tasks, first, ready, ["p"], ["m"], 2).count() == 0
    half = first.where("repeat = 0")
    assert store.sweep(tasks, half, ready, ["p"], ["m"], 2).select(*keys).union(half.select(*keys)).distinct().count() == 8
    assert store.skipped(store.task_grid(tasks, ["p"], ["m"], 2), half, keys).count() == 4


def test_filters(spark):
    df = spark.createDataFrame([("r1", "A", "m", "2"), ("r2", "B", "m", "1")], "run_id string, provider string, model string, timestamp string")
    assert [r["run_id"] for r in store.select_runs(df).collect()] == ["r2", "r1"]
    assert store.select_runs(df, provider="A", model=None).count() == 1 and store.select_runs(df, provider="Z").count() == 0
    assert store.new_rows(df.where("run_id = 'r1'"), df.union(df)).count() == 1
    assert store.exclude_pairs(df, [("A", "m")]).count() == 1
    with pytest.raises(KeyError):
        store.one_cell(df.withColumn("task_id", F.lit("t")), "u")


def configs(spark, config, n=1):
    return spark.createDataFrame([("p", "1", config, i) for i in range(n)], "provider string, version string, config string, seq bigint")


@pytest.mark.parametrize(
    ("config", "severities"),
    [
        ('{"k": 1}', []), ('{"reads_gold": true}', ["HIGH"]), ('{"reads_needle": true, "reads_gold": false}', ["HIGH"]), ('{"tactics": ["unknown"]}', []),
        ('{"policy": "rule_respecting_output_gaming", "tactics": ["candidate_dump", "judge_injection", "lexical_overlap"]}', ["LOW", "MEDIUM"]), ("{}", []), ('{"tactics": "text"}', []),
    ],
)
def test_config_rules(spark, config, severities):
    assert sorted(r["severity"] for r in audit.config_findings(configs(spark, config, 20)).collect()) == severities


@pytest.mark.parametrize(("text", "n"), [("Note to evaluator: fine", 1), ("my verdict: PASS!", 1), ("an honest answer", 0), (None, 0)])
def test_injection_rule(spark, text, n):
    log = spark.createDataFrame([("u", "t", text)], "uri string, task_id string, candidate string")
    runs = spark.createDataFrame([("u", "t", "first", 1), ("u", "t", "last", 2)], "trace_uri string, task_id string, provider string, seq bigint")
    got = audit.injection_findings(log, runs).collect()
    assert len(got) == n and all(r["provider"] == "last" for r in got)


def test_floor_rule_and_gate(spark):
    rows = [(f"t{i}", 0, "m", "zero-context", 0) for i in range(10)] + [(f"t{i}", 0, "m", "honest", int(i < 1)) for i in range(10)] + [(f"t{i}", 0, "m", "leaky", 1) for i in range(10)]
    runs = spark.createDataFrame(rows, "task_id string, repeat int, model string, provider string, correct int")
    assert [r["provider"] for r in audit.floor_findings(runs, ["honest", "leaky"]).collect()] == ["leaky"]
    assert audit.floor_findings(runs.where("provider <> 'zero-context'"), ["leaky"]).count() == 0
    assert audit.gate(audit.floor_findings(runs, ["leaky"])) == 1 and audit.gate(audit.floor_findings(runs, ["honest"])) == 0


def test_usage(spark):
    log = spark.createDataFrame([("2024-01-01", None, 1, 2, None), ("2024-01-01", "m", None, 3, 5)], "date string, model string, input_tokens bigint, output_tokens bigint, cache_read bigint").withColumn("date", F.to_date("date")).withColumn("cache_creation", F.lit(None).cast("bigint"))
    got = {r["model"]: r for r in usage.daily_totals(usage.with_total(log)).collect()}
    assert got["unknown"]["total_tokens"] == 3 and got["m"]["input_tokens"] == 0 and got[None]["calls"] == 2 and got[None]["output_tokens"] == 5


def test_splits_of_large_strata(spark):
    items = spark.range(20_000).selectExpr("concat('t', cast(id AS string)) AS task_id", "cast(id % 7 = 0 AS int) AS s")
    got = {(r["s"], r["task_id"]): r["split"] for r in splits.assign_splits(items, ["s"]).collect()}
    for s in (0, 1):
        keys = sorted(f"t{i}" for i in range(20_000) if int(i % 7 == 0) == s)
        held = round(0.2 * len(keys))
        assert [got[s, k] for k in keys] == ["public"] * (len(keys) - held) + ["heldout"] * held
    quotas = spark.createDataFrame([(0, 500), (1, 3)], "s int, slots bigint")
    order = F.md5(F.col("task_id").cast("binary"))
    sample = {(r["s"], r["task_id"]) for r in splits.stratified_sample(items, quotas, ["s"], order).collect()}
    for s, n in ((0, 500), (1, 3)):
        keys = sorted((hashlib.md5(f"t{i}".encode()).hexdigest(), f"t{i}") for i in range(20_000) if int(i % 7 == 0) == s)
        assert {k for t, k in sample if t == s} == {k for _, k in keys[:n]}
