"""Held-out splits and stratified samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import half_even

HELDOUT_FRACTION = 0.2
#: About so many keys of a table mark ranges, so that no task sorts a whole stratum.
MARKS = 4096
#: Parts that a stratum is dealt into to find its first items.
PARTS = 64


def assign_splits(items: DataFrame, strata: Sequence[str], key: str = "task_id", fraction: float = HELDOUT_FRACTION) -> DataFrame:
    """split of each item: the last round(fraction x size) of a stratum by key are held out, halves to even.

    Keys chosen by hash cut a stratum into ranges. An item's place is its place within its range after the sizes of the
    ranges above it, which are a small table.
    """
    every = items.agg(F.greatest(F.count(F.lit(1)) / MARKS, F.lit(1)).cast("bigint")).scalar()
    marks = items.where(F.pmod(F.xxhash64(key), every) == 0).groupBy(*strata).agg(F.collect_set(key).alias("_marks"))
    ranged = items.join(F.broadcast(marks), [*strata], "left")  # about MARKS keys
    ranged = ranged.withColumn("_range", F.coalesce(F.size(F.filter("_marks", lambda m: m > F.col(key))), F.lit(0))).drop("_marks")
    within = Window.partitionBy(*strata)
    above = F.sum("_n").over(within.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy(*strata, "_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*strata, "_range", F.coalesce(above, F.lit(0)).alias("_above"), half_even(F.sum("_n").over(within) * F.lit(fraction)).alias("_held"))
    place = F.col("_above") + F.row_number().over(Window.partitionBy(*strata, "_range").orderBy(F.desc(key)))
    placed = ranged.join(sizes, [*strata, "_range"]).withColumn("_back", place)
    return placed.withColumn("split", F.when(F.col("_back") <= F.col("_held"), "heldout").otherwise("public")).drop("_back", "_held", "_above", "_range")


def stratum_counts(assigned: DataFrame, strata: Sequence[str]) -> DataFrame:
    return assigned.groupBy(*strata).pivot("split", ["public", "heldout"]).count().fillna(0, ["public", "heldout"])


def largest_remainder(weights: DataFrame, total: int, weight: str = "weight", ties: Sequence[str] = ()) -> DataFrame:
    """slots: whole shares of ``total`` by weight; left-over slots go to the largest remainders.

    ``weights`` has one row a stratum, which is what bounds the ranking's single partition.
    """
    whole = weights.agg(F.sum(weight)).scalar()
    raw = F.col(weight) / whole * total
    base = weights.withColumn("_raw", F.coalesce(raw, F.lit(0.0))).withColumn("_floor", F.floor("_raw")).withColumn("_rest", F.col("_raw") - F.col("_floor"))
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), F.desc(weight), *ties))
    slots = F.col("_floor") + F.when((rank <= left) & (whole > 0), 1).otherwise(0)
    return base.withColumn("slots", slots.cast("bigint")).drop("_raw", "_floor", "_rest")


def stratified_sample(items: DataFrame, quotas: DataFrame, strata: Sequence[str], order: Column, key: str = "task_id", slots: str = "slots") -> DataFrame:
    """The first ``slots`` items of each stratum in a hashed order.

    A stratum is dealt into parts, of each of which only the first ``slots`` can matter: no task sorts a whole stratum.
    """
    near = items.join(quotas.select(*strata, slots), [*strata]).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    for by in ([*strata, "_part"], [*strata]):
        near = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, key))).where(F.col("_rank") <= F.col(slots))
    return near.drop("_rank", "_part", slots)
