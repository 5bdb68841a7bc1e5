"""Scalar arithmetic with the conventions of the metric definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column) -> Column:
    """Round halves to even, as an integer."""
    return F.bround(value, 0).cast("bigint")


def per_correct(total: Column, correct: Column) -> Column:
    """total / correct; infinite where nothing is correct."""
    return F.coalesce(F.try_divide(total.cast("double"), correct.cast("double")), F.lit(float("inf")))


def amortized(tokens: Column, build: Column, volume: Column) -> Column:
    """Tokens with a build cost shared by ``volume`` queries; an infinite volume carries none."""
    share = F.when(volume == float("inf"), F.lit(0.0)).otherwise(build / volume)
    return F.when(volume > 0, tokens + share).otherwise(F.raise_error(F.lit("volume must be above 0")).cast("double"))


def required_sample(effect: float, z_alpha: float = 1.959963984540054, z_beta: float = 0.8416212335729143) -> float:
    """Paired sample size for a standardised effect at 5 % two-sided and a power of 0.80."""
    return ((z_alpha + z_beta) / effect) ** 2


def as_count(value: Column) -> Column:
    """A count that may be missing: null is 0."""
    return F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))


def percent(value: Column) -> Column:
    return F.concat(F.format_number(value * 100, 1), F.lit("%"))
