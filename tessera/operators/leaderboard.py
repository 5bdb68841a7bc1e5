"""Leaderboard and the gap between public and held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import per_correct
from tessera.functions.text import short_model, task_family
from tessera.operators import bootstrap
from tessera.operators.metrics import frontier

CELL = ("provider", "model")
# The task families.
FAMILIES = ("needle", "swe_qa")


def with_split(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Runs of the manifest's tasks with family and split; public wins where a task is in both."""
    chosen = manifest.groupBy("task_id").agg(F.max(F.when(F.col("split") == "public", F.lit("public")).otherwise(F.lit("heldout"))).alias("split"))
    return runs.join(chosen, "task_id").withColumn("family", task_family(F.col("task_id")))


def cells(runs: DataFrame, interval=bootstrap.bootstrap_ci, **options) -> DataFrame:
    """A row for each provider and model: accuracy over records with the interval of the per-task accuracies, token cost at 1 and 10,000 queries, median tokens."""
    tasks = runs.groupBy(*CELL, "task_id").agg(F.avg("correct").alias("mean_correct"))
    ci = interval(tasks, "mean_correct", CELL, ["task_id"], **options).select(*CELL, "ci_low", "ci_high")
    each = runs.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct("task_id").alias("n_tasks"), F.sum("correct").alias("_ok"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("_t"), F.sum("build_tokens").alias("_b"),
        F.median((F.col("input_tokens") + F.col("output_tokens") + F.col("build_tokens")).cast("double")).alias("median_tokens"),
    )
    out = each.withColumn("accuracy", F.col("_ok") / F.col("n_cells")).join(ci, [*CELL])
    return out.select(*CELL, "n_cells", "n_tasks", "accuracy", "ci_low", "ci_high", per_correct(F.col("_t") + F.col("_b"), F.col("_ok")).alias("tpca_1"), per_correct(F.col("_t") + F.col("_b") / 10_000, F.col("_ok")).alias("tpca_10000"), "median_tokens")


def leaderboard(runs: DataFrame, **options) -> DataFrame:
    """Cells by falling accuracy; ``on_frontier`` marks those no other beats in accuracy and token cost at one query."""
    table = cells(runs, **options)
    best = frontier(table.where("accuracy > 0"), "tpca_1", "accuracy").select(*CELL, F.lit(True).alias("on_frontier"))
    joined = table.join(best, [*CELL], "left")
    return joined.select(*CELL, short_model(F.col("model")).alias("short_model"), *[c for c in table.columns if c not in CELL], F.coalesce("on_frontier", F.lit(False)).alias("on_frontier")).orderBy(F.desc("accuracy"), *CELL)


def by_family(runs: DataFrame, **options) -> DataFrame:
    """A leaderboard of its own, with its own frontier, for each task family of ``with_split``."""
    boards = [leaderboard(runs.where(F.col("family") == f), **options).select(F.lit(f).alias("family"), "*") for f in FAMILIES]
    return boards[0].unionByName(boards[1]).orderBy("family", F.desc("accuracy"), *CELL)


def heldout_gap(runs: DataFrame, interval=bootstrap.bootstrap_ci, **options) -> DataFrame:
    """Public minus held-out accuracy; flagged when it is over twice a public interval that has a width. A missing side counts 0."""
    side = lambda split: runs.where(F.col("split") == split)
    mean = lambda split, name: side(split).groupBy(*CELL).agg(F.avg("correct").alias(name))
    width = interval(side("public"), "correct", CELL, ["task_id", "repeat", "correct"], **options).select(*CELL, (F.col("ci_high") - F.col("ci_low")).alias("ci_width"))
    both = mean("public", "public").join(mean("heldout", "heldout"), [*CELL], "full_outer").join(width, [*CELL], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    gap = zero("public") - zero("heldout")
    return both.select(*CELL, zero("public").alias("public"), zero("heldout").alias("heldout"), gap.alias("gap"), zero("ci_width").alias("ci_width"), ((F.abs(gap) > 2 * zero("ci_width")) & (zero("ci_width") > 0)).alias("flagged"))


def to_markdown(board: DataFrame, title: str) -> str:
    """The rendered table; a leaderboard has a row for each method, so it is small."""
    lines = [f"# {title}", "", "| method | accuracy | 95% CI | TPCA(1) | TPCA(10000) | median tokens | cells | tasks |", "|---|---|---|---|---|---|---|---|"]
    for r in board.collect():
        star = " ★" if r["on_frontier"] else ""
        lines.append(f"| {r['provider']} × {r['short_model']}{star} | {r['accuracy']:.3f} | [{r['ci_low']:.3f}, {r['ci_high']:.3f}] | {r['tpca_1']:,.0f} | {r['tpca_10000']:,.0f} | {r['median_tokens']:,.0f} | {r['n_cells']} | {r['n_tasks']} |")
    return "\n".join(lines) + "\n"


def gap_markdown(gap: DataFrame, title: str) -> str:
    lines = [f"## {title}", "", "| method | public | held-out | Δ | flagged |", "|---|---|---|---|---|"]
    for r in gap.orderBy(*CELL).collect():
        lines.append(f"| {r['provider']} × {r['model'].split('.')[-1]} | {r['public']:.3f} | {r['heldout']:.3f} | {r['gap']:+.3f} | {'yes' if r['flagged'] else 'no'} |")
    return "\n".join(lines) + "\n"


def report(runs: DataFrame, **options) -> str:
    """The tables of every family and split that has runs, and the gaps between the splits."""
    parts = []
    for family in FAMILIES:
        of = runs.where(F.col("family") == family)
        for split in ("public", "heldout"):
            part = of.where(F.col("split") == split)
            parts.append(f"No records for {family} ({split}).\n" if part.isEmpty() else to_markdown(leaderboard(part, **options), f"{family} ({split})"))
        if not of.where(F.col("split") == "heldout").isEmpty():
            parts.append(gap_markdown(heldout_gap(of, **options), f"{family}: public and held-out"))
    return "\n".join(parts)


def reproduces(first: DataFrame, second: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Per provider: whether either run's mean lies in the other's interval and accuracies agree.

    Inputs have provider, mean, ci_low, ci_high, accuracy; a provider that the second run lacks fails.
    """
    b = second.select("provider", *[F.col(c).alias(f"{c}_b") for c in ("mean", "ci_low", "ci_high", "accuracy")])
    within = F.col("mean").between(F.col("ci_low_b"), F.col("ci_high_b")) & F.col("mean_b").between(F.col("ci_low"), F.col("ci_high"))
    close = F.abs(F.col("accuracy") - F.col("accuracy_b")) <= tolerance
    return first.join(b, "provider", "left").select("provider", "mean", "mean_b", "accuracy", "accuracy_b", F.coalesce(within & close, F.lit(False)).alias("passes"))
