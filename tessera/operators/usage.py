"""Usage logs: daily totals per model and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import as_count

TOKEN_COLUMNS = ("input_tokens", "output_tokens", "cache_read", "cache_creation", "total_tokens")


def with_total(log: DataFrame) -> DataFrame:
    """total_tokens: input and output, without cache."""
    return log.withColumn("total_tokens", as_count(F.col("input_tokens")) + as_count(F.col("output_tokens")))


def daily_totals(log: DataFrame) -> DataFrame:
    """Calls and tokens of each date by model, with a row of model null for all; missing models are 'unknown'."""
    clean = log.select("date", F.coalesce("model", F.lit("unknown")).alias("model"), *[as_count(F.col(c)).alias(c) for c in TOKEN_COLUMNS])
    rolled = clean.rollup("date", "model").agg(F.grouping("date").alias("_all"), F.grouping("model").alias("_day"), F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in TOKEN_COLUMNS])
    return rolled.where("_all = 0").select("date", F.when(F.col("_day") == 1, F.lit(None)).otherwise(F.col("model")).alias("model"), "calls", *TOKEN_COLUMNS)


def totals_for(log: DataFrame, date: str) -> DataFrame:
    return daily_totals(log.where(F.col("date") == F.lit(date).cast("date")))
