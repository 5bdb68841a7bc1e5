"""Percentile bootstrap intervals of a mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESAMPLES, CONFIDENCE, SEED = 10_000, 0.95, 0


def interval(values, resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = SEED) -> tuple[float, float]:
    """Bounds from numpy's default generator, drawn in blocks of bounded memory; (0, 0) without values."""
    import numpy as np

    x = np.asarray(values, float)
    if not len(x):
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    block = max(1, (1 << 22) // len(x))
    means = np.concatenate([x[rng.integers(0, len(x), (min(block, resamples - i), len(x)))].mean(axis=1) for i in range(0, resamples, block)])
    low, high = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(low), float(high)


def bootstrap_ci(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], **options) -> DataFrame:
    """ci_low and ci_high of each group's mean. A group is one sample and meets in one task."""
    schema = df.select(*by).schema.simpleString()[7:-1]
    names = [*by]

    def one(key, group):
        import pandas as pd

        ordered = group.sort_values(list(order))
        return pd.DataFrame([[*key, len(ordered), *interval(ordered[value].to_numpy(), **options)]], columns=[*names, "n", "ci_low", "ci_high"])

    typed = schema.replace(":", " ")
    return df.select(*dict.fromkeys([*by, *order, value])).groupBy(*by).applyInPandas(one, f"{typed}, n bigint, ci_low double, ci_high double")


def _draw(resample: Column, k: Column, n: Column) -> Column:
    """A place in 0 .. n - 1 from the hash of resample and position, the same in any engine."""
    digest = F.md5(F.concat_ws("-", resample.cast("string"), k.cast("string")).cast("binary"))
    return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("bigint") % n


def hashed_ci(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], resamples: int = 200, confidence: float = CONFIDENCE) -> DataFrame:
    """Like ``bootstrap_ci`` with hashed draws, as plain expressions that any SQL engine can repeat."""
    sample = df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v")))), lambda x: x["_v"]).alias("_x"))
    n = F.size("_x")
    mean = lambda b: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, k: s + F.get("_x", _draw(b, k, n).cast("int"))) / n
    means = sample.select(*by, F.size("_x").alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), mean)).alias("_m"))
    tail = (1 - confidence) / 2
    bounds = F.percentile("_m", F.array(F.lit(tail), F.lit(1 - tail)))
    return means.groupBy(*by, "n").agg(bounds.alias("_q")).select(*by, F.col("n").cast("bigint").alias("n"), F.get("_q", F.lit(0)).alias("ci_low"), F.get("_q", F.lit(1)).alias("ci_high"))
