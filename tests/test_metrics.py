"""Closed-form cases of the metric definitions."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.numeric import half_even, required_sample
from tessera.operators import bootstrap, metrics

SCHEMA = "task_id string, provider string, model string, repeat bigint, input_tokens bigint, output_tokens bigint, build_tokens bigint, correct int"


def runs(spark, rows):
    """rows: (task, provider, repeat, in, out, build, correct)."""
    return spark.createDataFrame([(t, p, "m", r, i, o, b, c) for t, p, r, i, o, b, c in rows], SCHEMA)


def test_cost_per_correct(spark):
    df = runs(spark, [("t0", "A", 0, 100, 10, 0, 1), ("t1", "A", 0, 200, 20, 0, 1), ("t0", "B", 0, 100, 10, 0, 0), ("t0", "C", 0, 100, 10, 10_000, 1)])
    got = {(r["provider"], r["volume"]): r["tpca"] for r in metrics.cost_curve(df).collect()}
    assert got["A", 1.0] == 165.0
    assert math.isinf(got["B", 1.0])
    assert [got["C", v] for v in (1.0, 100.0, 10_000.0)] == [10110, 210, 111]


def test_volume_must_be_positive(spark):
    with pytest.raises(Exception, match="volume"):
        metrics.cost_curve(runs(spark, [("t", "A", 0, 1, 1, 1, 1)]), volumes=[0.0]).collect()


def test_empty_runs(spark):
    df = runs(spark, [])
    assert metrics.cost_curve(df).collect() == []
    assert metrics.accuracy(df).collect() == []


def test_accuracy(spark):
    df = runs(spark, [(f"t{i}", "A", 0, 1, 1, 0, c) for i, c in enumerate([1, 0, 1])])
    row = metrics.accuracy(df).first()
    assert (row["n_cells"], row["n_tasks"]) == (3, 3) and row["accuracy"] == pytest.approx(2 / 3)


def test_distribution_is_interpolated(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 10)] + [("h", 1.0)] * 10 + [("h", 1000.0)], "k string, x double")
    rows = {r["k"]: r for r in metrics.distribution(df, F.col("x"), ["k"]).collect()}
    assert (rows["g"]["q25"], rows["g"]["median"], rows["g"]["q75"]) == (1.75, 2.5, 4.75)
    assert rows["h"]["median"] == 1 and rows["h"]["iqr"] == 0 and rows["h"]["mean"] > 50


def test_frontier_keeps_ties(spark):
    points = spark.createDataFrame([("A", 0.5, 100.0), ("B", 0.9, 300.0), ("C", 0.7, 400.0), ("D", 0.5, 100.0)], "p string, acc double, t double")
    assert {r["p"] for r in metrics.frontier(points, "t", "acc").collect()} == {"A", "B", "D"}


def test_paired(spark):
    rows = [("t1", "a", 0, 1, 1, 0, 1), ("t1", "a", 1, 1, 1, 0, 1), ("t2", "a", 0, 1, 1, 0, 1), ("t1", "b", 0, 1, 1, 0, 0), ("t2", "b", 0, 1, 1, 0, 0), ("t3", "b", 0, 1, 1, 0, 0)]
    got = metrics.paired_summary(metrics.paired(runs(spark, rows), "a", "b")).first()
    assert (got["n"], got["mean_diff"], got["wins"], got["losses"], got["ties"]) == (2, 1.0, 2, 0, 0)


def test_iso(spark):
    df = runs(spark, [(f"t{i}", "A", 0, 100, 10, 1000, int(i < 8)) for i in range(10)])
    acc = {(r["volume"], r["target"]): r for r in metrics.iso_accuracy(df).collect()}
    assert acc[1.0, 0.7]["tokens"] == 1110 and acc[10_000.0, 0.7]["tokens"] == pytest.approx(110.1) and acc[1.0, 0.9]["tokens"] is None
    assert acc[1.0, 0.9]["acc_reached"] == 0.8
    budget = {(r["volume"], r["budget"]): r for r in metrics.iso_budget(df).collect()}
    assert not budget[1.0, 1000.0]["feasible"] and budget[1.0, 1000.0]["accuracy"] == 0 and budget[100.0, 1000.0]["accuracy"] == 0.8


def test_bootstrap(spark):
    assert bootstrap.interval([5.0] * 50) == (5.0, 5.0)
    assert bootstrap.interval([]) == (0.0, 0.0)
    df = spark.createDataFrame([("g", i, float(i % 2)) for i in range(40)], "k string, i int, x double")
    exact = bootstrap.bootstrap_ci(df, "x", ["k"], ["i"]).first()
    hashed = bootstrap.hashed_ci(df, "x", ["k"], ["i"], resamples=500).first()
    assert abs(exact["ci_low"] - hashed["ci_low"]) < 0.05 and abs(exact["ci_high"] - hashed["ci_high"]) < 0.05


def test_division(spark):
    df = runs(spark, [("t", "A", 0, 1, 1, 0, 1), ("t", "B", 0, 1, 1, 0, 1), ("u", "A", 0, 1, 1, 0, 1)])
    assert [r["task_id"] for r in metrics.incomplete_cells(df).collect()] == ["u"]


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in metrics.keep_last(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", "z")}


def test_half_even_and_power(spark):
    rows = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, 3.5)], "x double").select(half_even(F.col("x")).alias("r")).collect()
    assert [r["r"] for r in rows] == [0, 2, 2, 4]
    assert round(required_sample(0.4)) == 49


def test_frontier_over_many_ranges_of_cost(spark):
    import random

    rng = random.Random(11)
    rows = [(k, float(rng.randrange(3000)), rng.randrange(3000) + rng.random() * (k % 3)) for k in range(4000)] + [(4000, float("inf"), 9e9), (4001, 0.0, -1.0)]
    points = spark.createDataFrame(rows, "k int, cost double, gain double")
    want, best = set(), float("-inf")
    for cost in sorted({r[1] for r in rows}):
        top = max(r[2] for r in rows if r[1] == cost)
        if top > best:
            best = top
            want |= {r[0] for r in rows if r[1] == cost and r[2] == top}
    assert {r["k"] for r in metrics.frontier(points, "cost", "gain").collect()} == want
    assert metrics.frontier(points.limit(0), "cost", "gain").count() == 0
