"""Judge calibration on nested votes: agreement, calibration error, diagnostics.

``audited`` rows have task_id, human (boolean) and votes: array<struct<correctness, completeness,
faithfulness: int, parse_error: boolean>>.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import DIMENSIONS, PASS_FLOOR

KAPPA_LEAST, ECE_MOST, BADGE_MOST, BINS = 0.60, 0.10, 0.05, 10


def vote_passes(vote: Column, floor: dict[str, int] = PASS_FLOOR) -> Column:
    out = ~F.coalesce(vote["parse_error"], F.lit(False))
    for dim, least in floor.items():
        out = out & (F.coalesce(vote[dim], F.lit(0)) >= least)
    return out


def majority(audited: DataFrame, floor: dict[str, int] = PASS_FLOOR) -> DataFrame:
    """pass_count, n_votes, judged (more than half pass) and confidence (share that pass) of each task."""
    passed = F.size(F.filter("votes", lambda v: vote_passes(v, floor)))
    n = F.size("votes")
    return audited.withColumn("pass_count", passed).withColumn("n_votes", n).withColumn("judged", F.col("pass_count") > F.floor(n / 2)).withColumn("confidence", F.col("pass_count") / F.col("n_votes"))


def confusion(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and the two error rates (null without cases)."""
    count = lambda cond: F.count_if(cond)
    human, judge = F.col("human"), F.col("judged")
    t = judged.groupBy(*by).agg(count(human & judge).alias("tp"), count(~human & judge).alias("fp"), count(human & ~judge).alias("fn"), count(~human & ~judge).alias("tn"))
    return t.select("*", F.try_divide(F.col("fn"), F.col("tp") + F.col("fn")).alias("fn_rate"), F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("fp_rate"))


def kappa(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa; 0 where chance agreement is complete."""
    t = judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("human") == F.col("judged")).cast("int")).alias("agreement"),
        F.avg(F.col("human").cast("int")).alias("_h"), F.avg(F.col("judged").cast("int")).alias("_j"),
    )
    chance = F.col("_h") * F.col("_j") + (1 - F.col("_h")) * (1 - F.col("_j"))
    value = F.when(F.abs(1 - chance) < 1e-12, F.lit(0.0)).otherwise((F.col("agreement") - chance) / (1 - chance))
    return t.select(*by, "n", "agreement", value.alias("kappa"))


def _binned(judged: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    place = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return judged.groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("human").cast("int")).alias("pass_rate"))


def calibration_bins(judged: DataFrame, bins: int = BINS) -> DataFrame:
    """Every bin with its size, mean confidence, human pass rate and share of the error; empty bins stay."""
    every = judged.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    total = judged.agg(F.count(F.lit(1))).scalar()
    out = every.join(_binned(judged, (), bins), "bin", "left").fillna(0, ["n"])
    return out.withColumn("weighted_gap", F.coalesce(F.col("n") / total * F.abs(F.col("mean_confidence") - F.col("pass_rate")), F.lit(0.0)))


def calibration_error(judged: DataFrame, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """Expected calibration error."""
    return _binned(judged, by, bins).groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("pass_rate"))) / F.sum("n")).alias("ece"))


def summary(judged: DataFrame, badge: float = 0.0) -> DataFrame:
    """One row: agreement, pass counts, kappa, calibration error and the verdicts on the thresholds."""
    counts = judged.agg(F.count_if("human").alias("human_pass"), F.count_if("judged").alias("judge_pass"))
    ece = calibration_error(judged).select("ece").scalar()
    row = kappa(judged).withColumn("ece", ece).withColumn("human_pass", counts.select("human_pass").scalar()).withColumn("judge_pass", counts.select("judge_pass").scalar())
    return row.select("n", "agreement", "kappa", "ece", "human_pass", "judge_pass", (F.col("kappa") >= KAPPA_LEAST).alias("kappa_ok"), (F.col("ece") <= ECE_MOST).alias("ece_ok"), F.lit(badge <= BADGE_MOST).alias("badge_ok"))


def dimension_scores(audited: DataFrame) -> DataFrame:
    """How often each score was given, by dimension and human label; votes that did not parse are left out."""
    votes = audited.select("human", F.explode("votes").alias("v")).where("NOT coalesce(v.parse_error, false)")
    long = votes.select("human", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col("v")[d].alias("score")) for d in DIMENSIONS])).alias("x"))
    return long.groupBy("human", F.col("x.dim").alias("dim"), F.col("x.score").alias("score")).agg(F.count(F.lit(1)).alias("n"))


def dimension_means(audited: DataFrame) -> DataFrame:
    return dimension_scores(audited).groupBy("human", "dim").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_score"), F.sum("n").alias("n"))


def floor_grid(audited: DataFrame, floors: Sequence[tuple[int, int, int]]) -> DataFrame:
    """kappa and calibration error had the votes been judged by other floors."""
    listed = F.explode(F.array(*[F.struct(*[F.lit(x).alias(d) for d, x in zip(DIMENSIONS, f, strict=True)]) for f in floors])).alias("least")
    each = audited.select("task_id", "human", "votes", listed)

    def passes(vote: Column) -> Column:
        out = ~F.coalesce(vote["parse_error"], F.lit(False))
        for d in DIMENSIONS:
            out = out & (F.coalesce(vote[d], F.lit(0)) >= F.col(f"least.{d}"))
        return out

    counted = each.withColumn("passed", F.size(F.filter("votes", passes)))
    judged = counted.select(
        F.concat_ws("/", *[F.col(f"least.{d}").cast("string") for d in DIMENSIONS]).alias("floor"), "human",
        (F.col("passed") > F.floor(F.size("votes") / 2)).alias("judged"), (F.col("passed") / F.size("votes")).alias("confidence"),
    )
    return kappa(judged, ["floor"]).join(calibration_error(judged, ["floor"]), "floor")


def latest_votes(audit: DataFrame, order: str) -> DataFrame:
    """The last audit row of each task."""
    return audit.groupBy("task_id").agg(F.max_by("votes", order).alias("votes"))


def voted(humans: DataFrame, audit: DataFrame) -> DataFrame:
    """Labelled tasks with their votes; a task without votes is left out."""
    return humans.join(audit.select("task_id", "votes"), "task_id")


def labelled(candidates: DataFrame, humans: DataFrame, audit: DataFrame) -> DataFrame:
    """Tasks that have a candidate, a human label and votes; an error if a common task has no votes."""
    common = candidates.select("task_id").join(humans, "task_id")
    joined = common.join(audit.select("task_id", "votes"), "task_id", "left")
    return joined.withColumn("votes", F.coalesce("votes", F.raise_error(F.concat(F.lit("no votes for "), "task_id")).cast(audit.schema["votes"].dataType)))
