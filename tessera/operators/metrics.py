"""Run-record metrics: token cost, accuracy, amortisation, frontiers and paired comparisons.

Run records have columns task_id, provider, model, repeat, input_tokens, output_tokens,
build_tokens (bigint), correct (int) and an order column where a rule needs one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import amortized, per_correct

VOLUMES = (1.0, 100.0, 10_000.0)
METHOD = ("provider", "model")
#: Ranges of cost that a frontier is taken over.
COST_RANGES = 256


def tokens_at(volume: Column | float) -> Column:
    """A record's tokens when its build cost is shared by ``volume`` queries."""
    v = F.lit(volume) if isinstance(volume, (int, float)) else volume
    return amortized((F.col("input_tokens") + F.col("output_tokens")).cast("double"), F.col("build_tokens").cast("double"), v)


def _with_values(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Each row once for each of a few fixed values."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def totals(runs: DataFrame, by: Sequence[str] = METHOD) -> DataFrame:
    """One row a group: integer sums, from which every cost curve follows without another pass."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").alias("n_correct"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("build_tokens").alias("build"),
    )


def cost_curve(runs: DataFrame, volumes: Sequence[float] = VOLUMES, by: Sequence[str] = METHOD) -> DataFrame:
    """Tokens per correct answer at every volume; infinite where nothing is correct."""
    each = _with_values(totals(runs, by), "volume", volumes)
    total = amortized(F.col("tokens").cast("double"), F.col("build").cast("double"), F.col("volume"))
    return each.select(*by, "volume", per_correct(total, F.col("n_correct")).alias("tpca"))


def log_spaced_curve(runs: DataFrame, points: int = 30, decades: float = 4.5, by: Sequence[str] = ("provider",)) -> DataFrame:
    """``cost_curve`` at logarithmically spaced volumes."""
    each = totals(runs, by).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    volume = F.pow(F.lit(10.0), F.col("point") * (decades / (points - 1)))
    total = F.col("tokens") + F.col("build") / volume
    return each.select(*by, "point", volume.alias("volume"), per_correct(total, F.col("n_correct")).alias("tpca"))


def accuracy(runs: DataFrame, by: Sequence[str] = METHOD) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct("task_id").alias("n_tasks"),
        F.sum("correct").alias("n_correct"), F.avg("correct").alias("accuracy"),
    )


def distribution(df: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """n, mean, median, quartiles (interpolated) and their distance."""
    x = df.select(*by, value.cast("double").alias("_x"))
    return (
        x.groupBy(*by)
        .agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.percentile("_x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
        .select(*by, "n", "mean", F.get("_q", F.lit(1)).alias("median"), F.get("_q", F.lit(0)).alias("q25"), F.get("_q", F.lit(2)).alias("q75"),
                (F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))).alias("iqr"))
    )


def _mean_tokens(runs: DataFrame, volumes: Sequence[float], by: Sequence[str]) -> DataFrame:
    each = _with_values(totals(runs, by), "volume", volumes)
    return each.select(*by, "volume", ((F.col("tokens") + F.col("build") / F.col("volume")) / F.col("n")).alias("mean_tokens"), (F.col("n_correct") / F.col("n")).alias("accuracy"))


def iso_accuracy(runs: DataFrame, targets: Sequence[float] = (0.5, 0.7, 0.9), volumes: Sequence[float] = VOLUMES, by: Sequence[str] = METHOD) -> DataFrame:
    """Mean tokens where a method reaches the target accuracy, else null."""
    each = _with_values(_mean_tokens(runs, volumes, by), "target", targets)
    return each.select(*by, "volume", "target", F.when(F.col("accuracy") >= F.col("target"), F.col("mean_tokens")).alias("tokens"), F.col("accuracy").alias("acc_reached"))


def iso_budget(runs: DataFrame, budgets: Sequence[float] = (1_000.0, 10_000.0, 100_000.0), volumes: Sequence[float] = VOLUMES, by: Sequence[str] = METHOD) -> DataFrame:
    """Accuracy within a token budget; 0 where the budget does not hold the mean."""
    each = _with_values(_mean_tokens(runs, volumes, by), "budget", budgets)
    fits = F.col("mean_tokens") <= F.col("budget")
    return each.select(*by, "volume", "budget", fits.alias("feasible"), F.when(fits, F.col("accuracy")).otherwise(F.lit(0.0)).alias("accuracy"), "mean_tokens")


def frontier(points: DataFrame, cost: str, gain: str) -> DataFrame:
    """Points that no other beats in cost and gain; ties stay.

    A point stays if it has the best gain at its cost and beats all cheaper ones. Best gains per
    distinct cost are aggregated first. Costs fall into at most ``COST_RANGES`` + 1 ranges: a running maximum
    over one row a range, and one over the costs of each range, need no window over all costs.
    """
    from pyspark.sql import Window

    best = points.groupBy(cost).agg(F.max(gain).alias("_best"))
    marks = best.agg(F.percentile_approx(cost, F.array(*[F.lit(k / COST_RANGES) for k in range(COST_RANGES)]), 10_000)).scalar()
    ranged = best.withColumn("_marks", marks).withColumn("_range", F.coalesce(F.size(F.filter("_marks", lambda m: m < F.col(cost))), F.lit(0))).drop("_marks")
    ranges = ranged.groupBy("_range").agg(F.max("_best").alias("_top"))
    lower = ranges.withColumn("_lower", F.max("_top").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    cheaper = Window.partitionBy("_range").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    passed = ranged.withColumn("_before", F.max("_best").over(cheaper)).join(F.broadcast(lower), "_range")  # a row a range
    kept = passed.where("coalesce(greatest(_before, _lower) < _best, true)").select(F.col(cost).alias("_cost"), "_best")
    return points.join(kept, (F.col(cost) == F.col("_cost")) & (F.col(gain) == F.col("_best")), "left_semi")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of greatest order for each key, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, "_row.*").select(*df.columns)


def paired(runs: DataFrame, candidate: str, floor: str, keys: Sequence[str] = ("task_id", "repeat"), by: Sequence[str] = ("model",)) -> DataFrame:
    """The correctness difference of two providers on their common keys."""
    side = lambda p, name: runs.where(F.col("provider") == p).select(*by, *keys, F.col("correct").alias(name))
    return side(candidate, "a").join(side(floor, "b"), [*by, *keys]).select(*by, *keys, (F.col("a") - F.col("b")).alias("diff"))


def paired_summary(pairs: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"), F.count_if(F.col("diff") > 0).alias("wins"),
        F.count_if(F.col("diff") < 0).alias("losses"), F.count_if(F.col("diff") == 0).alias("ties"),
    )


def incomplete_cells(runs: DataFrame, group: Sequence[str] = ("task_id", "model", "repeat"), member: str = "provider") -> DataFrame:
    """Groups that lack some member: the remainder of a relational division."""
    wanted = runs.agg(F.count_distinct(member).alias("wanted"))
    have = runs.groupBy(*group).agg(F.count_distinct(member).alias("have"))
    return have.withColumn("wanted", wanted.scalar()).where("have < wanted")
