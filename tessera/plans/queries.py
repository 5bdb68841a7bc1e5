"""The registered queries of the engine's own operators, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.numeric import required_sample
from tessera.operators import audit, bootstrap, calibration, judge, leaderboard, metrics, providers, retrieval, splits, store, usage
from tessera.plans import bridge
from tessera.plans.materialize import scratch_path
from tessera.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

QUESTION = "Which small red widget or blue ring of ECONOMY size is beside a bolt?"
INSTRUCTION = "Answer with the name only."
VOLUMES = "(VALUES (1.0::DOUBLE), (100.0), (10000.0)) vols(volume)"


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLE[build.__name__] = sql
        return build

    return register


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Metrics.


@query(f"""WITH {bridge.RUNS} SELECT provider, model, volume,
  round(CASE WHEN sum(correct) = 0 THEN 'infinity'::DOUBLE ELSE (sum(input_tokens + output_tokens) + sum(build_tokens) / volume) / sum(correct) END, 6) AS tpca
FROM runs, {VOLUMES} GROUP BY provider, model, volume""")
def tpca_curve(spark, sf_dir):
    return rounded(metrics.cost_curve(bridge.runs(spark, sf_dir)), 6, "tpca")


@query(f"""WITH {bridge.RUNS} SELECT provider, model, count(*) AS n_cells, count(DISTINCT task_id) AS n_tasks, sum(correct)::BIGINT AS n_correct,
  round(avg(correct), 9) AS accuracy FROM runs GROUP BY provider, model""")
def accuracy_by_method(spark, sf_dir):
    return rounded(metrics.accuracy(bridge.runs(spark, sf_dir)), 9, "accuracy")


@query(f"""WITH {bridge.RUNS} SELECT provider, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q25,
  round(quantile_cont(x, 0.75), 6) AS q75, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr
FROM (SELECT provider, (input_tokens + output_tokens + build_tokens)::DOUBLE AS x FROM runs) GROUP BY provider""")
def token_distribution(spark, sf_dir):
    return rounded(metrics.distribution(bridge.runs(spark, sf_dir), metrics.tokens_at(1.0), ["provider"]), 6, "mean", "median", "q25", "q75", "iqr")


@query(f"""WITH {bridge.RUNS} SELECT provider, point::INT AS point, round(pow(10.0, point * (4.5 / 29)), 4) AS volume,
  round((sum(input_tokens + output_tokens) + sum(build_tokens) / pow(10.0, point * (4.5 / 29))) / sum(correct), 4) AS tpca
FROM runs, range(30) p(point) GROUP BY provider, point""")
def amortization_curve(spark, sf_dir):
    return rounded(metrics.log_spaced_curve(bridge.runs(spark, sf_dir)), 4, "volume", "tpca")


_MEAN = """mean_rows AS (
  SELECT provider, model, volume, (sum(input_tokens + output_tokens) + sum(build_tokens) / volume) / count(*) AS mean_tokens, sum(correct)::DOUBLE / count(*) AS accuracy
  FROM runs, (VALUES (1.0::DOUBLE), (100.0), (10000.0)) vols(volume) GROUP BY provider, model, volume)"""


@query(f"""WITH {bridge.RUNS}, {_MEAN} SELECT provider, model, volume, target, round(CASE WHEN accuracy >= target THEN mean_tokens END, 6) AS tokens, round(accuracy, 9) AS acc_reached
FROM mean_rows, (VALUES (0.5::DOUBLE), (0.7), (0.9)) t(target)""")
def iso_accuracy(spark, sf_dir):
    return rounded(metrics.iso_accuracy(bridge.runs(spark, sf_dir)), 9, "acc_reached").withColumn("tokens", F.round("tokens", 6))


@query(f"""WITH {bridge.RUNS}, {_MEAN} SELECT provider, model, volume, budget, mean_tokens <= budget AS feasible, round(CASE WHEN mean_tokens <= budget THEN accuracy ELSE 0 END, 9) AS accuracy,
  round(mean_tokens, 6) AS mean_tokens FROM mean_rows, (VALUES (1000.0::DOUBLE), (10000.0), (100000.0)) t(budget)""")
def iso_budget(spark, sf_dir):
    return rounded(rounded(metrics.iso_budget(bridge.runs(spark, sf_dir)), 9, "accuracy"), 6, "mean_tokens")


@query(f"""WITH {bridge.RUNS}, points AS (
  SELECT provider, model, round((sum(input_tokens + output_tokens) + sum(build_tokens) / 100.0::DOUBLE) / count(*), 6) AS mean_tokens, round(avg(correct), 9) AS accuracy FROM runs GROUP BY provider, model)
SELECT * FROM points p WHERE NOT EXISTS (
  SELECT 1 FROM points q WHERE q.mean_tokens <= p.mean_tokens AND q.accuracy >= p.accuracy AND (q.mean_tokens < p.mean_tokens OR q.accuracy > p.accuracy))""")
def pareto_frontier(spark, sf_dir):
    points = metrics.totals(bridge.runs(spark, sf_dir)).select("provider", "model", F.round((F.col("tokens") + F.col("build") / 100.0) / F.col("n"), 6).alias("mean_tokens"), F.round(F.col("n_correct") / F.col("n"), 9).alias("accuracy"))
    return metrics.frontier(points, "mean_tokens", "accuracy")


_PAIRS = "pairs AS (SELECT a.model, a.task_id, a.repeat, a.correct - b.correct AS diff FROM runs a JOIN runs b USING (task_id, repeat, model) WHERE a.provider = 'bm25' AND b.provider = 'zero-context')"


@query(f"""WITH {bridge.RUNS}, {_PAIRS} SELECT model, count(*) AS n, round(avg(diff), 9) AS mean_diff, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses,
  count(*) FILTER (diff = 0) AS ties FROM pairs GROUP BY model""")
def paired_uplift(spark, sf_dir):
    return rounded(metrics.paired_summary(metrics.paired(bridge.runs(spark, sf_dir), "bm25", "zero-context")), 9, "mean_diff")


def _ci_sql(sample: str, by: str, order: str, value: str, resamples: int = 200) -> str:
    """SQL twin of ``hashed_ci``: CTEs up to ci_rows(by, n, ci_low, ci_high)."""
    return f"""
sample_rows AS (SELECT {by}, {value}::DOUBLE AS v, row_number() OVER (PARTITION BY {by} ORDER BY {order}, {value}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {sample}),
draws AS (SELECT b, k, ('0x' || substr(md5(b::VARCHAR || '-' || k::VARCHAR), 1, 8))::BIGINT AS h FROM range({resamples}) t(b), range((SELECT max(n) FROM sample_rows)) u(k)),
means AS (
  SELECT {by}, s.n, b, sum(s.v) / s.n AS m FROM (SELECT DISTINCT {by}, n FROM sample_rows) g JOIN draws d ON d.k < g.n
  JOIN sample_rows s USING ({by}) WHERE s.i = d.h % g.n GROUP BY {by}, s.n, b),
ci_rows AS (SELECT {by}, n, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM means GROUP BY {by}, n)"""


_TASK_MEANS = "task_means AS (SELECT provider, model, task_id, avg(correct) AS mean_correct FROM runs GROUP BY provider, model, task_id)"


@query(f"""WITH {bridge.RUNS}, {_TASK_MEANS}, {_ci_sql("task_means", "provider, model", "task_id", "mean_correct")}
SELECT provider, model, n, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci_rows""")
def bootstrap_ci_hashed(spark, sf_dir):
    means = bridge.runs(spark, sf_dir).groupBy("provider", "model", "task_id").agg(F.avg("correct").alias("mean_correct"))
    return rounded(bootstrap.hashed_ci(means, "mean_correct", ["provider", "model"], ["task_id"]), 6, "ci_low", "ci_high")


@query()
def bootstrap_ci(spark, sf_dir):
    means = bridge.runs(spark, sf_dir).groupBy("provider", "model", "task_id").agg(F.avg("correct").alias("mean_correct"))
    return bootstrap.bootstrap_ci(means, "mean_correct", ["provider", "model"], ["task_id"])


@query(f"""WITH {bridge.RUNS}, {_PAIRS}, {_ci_sql("pairs", "model", "task_id, repeat", "diff")}
SELECT model, ci.n, round(mean_diff, 9) AS mean_diff, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(ci_high, 6) <= 0.20 AS passes
FROM ci_rows ci JOIN (SELECT model, avg(diff) AS mean_diff FROM pairs GROUP BY model) USING (model)""")
def exit_gate(spark, sf_dir):
    """Paired uplift over the floor with its interval: passes while the upper bound is at most 0.20."""
    pairs = metrics.paired(bridge.runs(spark, sf_dir), "bm25", "zero-context")
    ci = rounded(bootstrap.hashed_ci(pairs, "diff", ["model"], ["task_id", "repeat"]), 6, "ci_low", "ci_high")
    return ci.join(pairs.groupBy("model").agg(F.round(F.avg("diff"), 9).alias("mean_diff")), "model").withColumn("passes", F.col("ci_high") <= 0.20)


@query(f"""WITH {bridge.RUNS} SELECT task_id, model, repeat, count(DISTINCT provider) AS have, (SELECT count(DISTINCT provider) FROM runs) AS wanted FROM runs
GROUP BY task_id, model, repeat HAVING have < wanted""")
def completeness_check(spark, sf_dir):
    return metrics.incomplete_cells(bridge.runs(spark, sf_dir))


@query(f"""WITH {bridge.RUNS}, {_ci_sql("runs", "provider, model", "task_id, repeat", "input_tokens + output_tokens")},
each AS (SELECT provider, model, avg((input_tokens + output_tokens)::DOUBLE) AS mean, avg(correct) AS accuracy FROM runs GROUP BY provider, model),
joined AS (SELECT * FROM each JOIN ci_rows USING (provider, model))
SELECT a.provider, round(a.mean, 6) AS mean, round(b.mean, 6) AS mean_b, round(a.accuracy, 9) AS accuracy, round(b.accuracy, 9) AS accuracy_b,
  coalesce(a.mean BETWEEN b.ci_low AND b.ci_high AND b.mean BETWEEN a.ci_low AND a.ci_high AND abs(a.accuracy - b.accuracy) <= 0.10, false) AS passes
FROM joined a LEFT JOIN joined b ON a.provider = b.provider AND b.model = 'vendor.large' WHERE a.model = 'vendor.small'""")
def repro_check(spark, sf_dir):
    runs = bridge.runs(spark, sf_dir).withColumn("t", F.col("input_tokens") + F.col("output_tokens"))
    ci = bootstrap.hashed_ci(runs, "t", ["provider", "model"], ["task_id", "repeat"])
    each = runs.groupBy("provider", "model").agg(F.avg("t").alias("mean"), F.avg("correct").alias("accuracy")).join(ci, ["provider", "model"])
    side = lambda m: each.where(F.col("model") == m).drop("model", "n")
    return rounded(rounded(leaderboard.reproduces(side("vendor.small"), side("vendor.large")), 6, "mean", "mean_b"), 9, "accuracy", "accuracy_b")


@query("SELECT round(pow((1.959963984540054 + 0.8416212335729143) / d, 2), 6) AS n, d AS effect FROM (VALUES (0.2::DOUBLE), (0.4), (0.8)) t(d)")
def power_calc(spark, sf_dir):
    return spark.createDataFrame([(round(required_sample(d), 6), d) for d in (0.2, 0.4, 0.8)], "n double, effect double")


# Store.


@query(f"WITH {bridge.RUNS} SELECT run_id, task_id, provider, model, repeat, ts FROM runs WHERE provider = 'bm25' AND model = 'vendor.small'")
def store_filter(spark, sf_dir):
    return store.select_runs(bridge.runs(spark, sf_dir), order="ts", provider="bm25", model="vendor.small", task_id=None).select("run_id", "task_id", "provider", "model", "repeat", "ts")


@query(f"WITH {bridge.RUNS} SELECT DISTINCT task_id, provider, model, repeat FROM runs WHERE model = 'vendor.large'")
def completed_keys(spark, sf_dir):
    return store.completed_keys(bridge.runs(spark, sf_dir), ["task_id", "provider", "model", "repeat"], model="vendor.large")


@query(f"WITH {bridge.RUNS} SELECT run_id, provider, model, repeat FROM runs WHERE provider IN ('bm25', 'idf-graph') AND model IN ('vendor.small') AND repeat < 3")
def resume_selection(spark, sf_dir):
    return store.resumable(bridge.runs(spark, sf_dir), ["bm25", "idf-graph"], ["vendor.small"], 3).select("run_id", "provider", "model", "repeat")


@query(f"WITH {bridge.RUNS} SELECT provider, model, count(*) AS n FROM runs WHERE NOT ((provider, model) = ('raw-dump', 'vendor.large')) GROUP BY provider, model")
def excluded_pairs(spark, sf_dir):
    return store.exclude_pairs(bridge.runs(spark, sf_dir), [("raw-dump", "vendor.large")]).groupBy("provider", "model").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {bridge.RUNS} SELECT run_id, task_id, provider, model, repeat, correct FROM runs WHERE ts >= '1997-01-01'")
def mirror_ingest(spark, sf_dir):
    """What a store brings that its mirror, here of the runs before 1997, does not have."""
    runs = bridge.runs(spark, sf_dir)
    return store.new_rows(runs.where("ts < '1997-01-01'"), runs.unionByName(runs)).select("run_id", "task_id", "provider", "model", "repeat", "correct")


_GRID = f"""grid AS (
  SELECT task_id, task_index, provider, model, repeat, 7 + repeat * (SELECT count(*) FROM task_rows) + task_index AS seed
  FROM task_rows, (VALUES {", ".join(f"('{p}')" for p in bridge.PROVIDERS)}) p(provider), (VALUES {", ".join(f"('{m}')" for m in bridge.MODELS)}) m(model), range(5) r(repeat))"""
_TASK_ROWS = "task_rows AS (SELECT 'needle-' || i::VARCHAR AS task_id, i AS task_index FROM range(200) t(i))"


def _grid(spark):
    tasks = spark.range(200).select(F.concat(F.lit("needle-"), F.col("id").cast("string")).alias("task_id"), F.col("id").alias("task_index"))
    grid = store.task_grid(tasks, bridge.PROVIDERS, bridge.MODELS, 5, base_seed=7)
    return grid.withColumn("repeat", F.col("repeat").cast("bigint"))


@query(f"""WITH {bridge.RUNS}, {_TASK_ROWS}, {_GRID} SELECT task_id, provider, model, repeat, seed FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.task_id = g.task_id AND r.provider = g.provider AND r.model = g.model AND r.repeat = g.repeat)""")
def pending_cells(spark, sf_dir):
    return store.pending(_grid(spark), bridge.runs(spark, sf_dir), ["task_id", "provider", "model", "repeat"]).select("task_id", "provider", "model", "repeat", "seed")


@query(f"""WITH {bridge.RUNS}, {_TASK_ROWS}, {_GRID} SELECT provider, count(*) AS skipped FROM grid g
WHERE EXISTS (SELECT 1 FROM runs r WHERE r.task_id = g.task_id AND r.provider = g.provider AND r.model = g.model AND r.repeat = g.repeat) GROUP BY provider""")
def skipped_cells(spark, sf_dir):
    skipped = store.skipped(_grid(spark), bridge.runs(spark, sf_dir), ["task_id", "provider", "model", "repeat"])
    return skipped.groupBy("provider").agg(F.count(F.lit(1)).alias("skipped"))


@query(f"""WITH prices(model, price_in, price_out) AS (VALUES ('vendor.small', 0.15::DOUBLE, 0.6::DOUBLE), ('vendor.large', 3.0, 15.0)),
{bridge.RUNS}, cells AS (SELECT provider, model, CASE WHEN repeat < 3 THEN 'first' ELSE 'second' END AS pass, count(*) AS cells, sum(input_tokens) / count(*) AS in_tokens, 50 AS out_tokens FROM runs GROUP BY ALL)
SELECT provider, model, pass, cells, round(cells * (in_tokens / 1e6 * price_in + out_tokens / 1e6 * price_out), 9) AS cost FROM cells JOIN prices USING (model)""")
def cost_projection(spark, sf_dir):
    prices = spark.createDataFrame([("vendor.small", 0.15, 0.6), ("vendor.large", 3.0, 15.0)], "model string, price_in double, price_out double")
    cells = bridge.runs(spark, sf_dir).groupBy("provider", "model", F.when(F.col("repeat") < 3, "first").otherwise("second").alias("pass")).agg(F.count(F.lit(1)).alias("cells"), (F.sum("input_tokens") / F.count(F.lit(1))).alias("in_tokens")).withColumn("out_tokens", F.lit(50))
    return rounded(store.projected_cost(cells, prices), 9, "cost")


# Splits and samples.

_SPLIT = f"""{bridge.TASKS}, assigned AS (
  SELECT task_id, lang, source, CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY task_id DESC) <= round_even(count(*) OVER (PARTITION BY lang, source) * 0.2::DOUBLE, 0) THEN 'heldout' ELSE 'public' END AS split FROM tasks)"""


@query(f"WITH {_SPLIT} SELECT task_id, lang, source, split FROM assigned")
def split_assign(spark, sf_dir):
    return splits.assign_splits(bridge.tasks(spark, sf_dir).drop("doc_id"), ["lang", "source"])


@query(f"WITH {_SPLIT} SELECT lang, source, count(*) FILTER (split = 'public') AS public, count(*) FILTER (split = 'heldout') AS heldout FROM assigned GROUP BY lang, source")
def stratum_counts(spark, sf_dir):
    return splits.stratum_counts(split_assign(spark, sf_dir), ["lang", "source"])


_QUOTA = f"""{bridge.TASKS}, weights AS (SELECT lang, source, count(*) AS weight FROM tasks GROUP BY lang, source),
raw_rows AS (SELECT *, weight::DOUBLE / (SELECT sum(weight) FROM weights) * 100 AS raw FROM weights),
quotas AS (SELECT lang, source, weight, (floor(raw) + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, weight DESC, lang, source) <= 100 - (SELECT sum(floor(raw)) FROM raw_rows) THEN 1 ELSE 0 END)::BIGINT AS slots FROM raw_rows)"""


@query(f"WITH {_QUOTA} SELECT * FROM quotas")
def largest_remainder(spark, sf_dir):
    weights = bridge.tasks(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("weight"))
    return splits.largest_remainder(weights, 100, ties=["lang", "source"])


@query(f"""WITH {_QUOTA} SELECT task_id, lang, source FROM tasks JOIN quotas USING (lang, source)
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY md5(task_id), task_id) <= any_value(slots) OVER (PARTITION BY lang, source)""")
def stratified_sample(spark, sf_dir):
    order = F.md5(F.col("task_id").cast("binary"))
    return splits.stratified_sample(bridge.tasks(spark, sf_dir).drop("doc_id"), largest_remainder(spark, sf_dir), ["lang", "source"], order)


_MANIFEST = "manifest AS (SELECT task_id, CASE WHEN ('0x' || substr(md5(task_id), 1, 2))::INT < 51 THEN 'heldout' ELSE 'public' END AS split FROM (SELECT DISTINCT task_id FROM runs))"


def _split_runs(spark, sf_dir):
    runs = bridge.runs(spark, sf_dir)
    byte = F.conv(F.substr(F.md5(F.col("task_id").cast("binary")), F.lit(1), F.lit(2)), 16, 10).cast("int")
    manifest = runs.select("task_id").distinct().withColumn("split", F.when(byte < 51, "heldout").otherwise("public"))
    return leaderboard.with_split(runs, manifest)


@query(f"""WITH {bridge.RUNS}, {_MANIFEST}, chosen AS (SELECT runs.* FROM runs JOIN manifest USING (task_id) WHERE split = 'public'),
task_means AS (SELECT provider, model, task_id, avg(correct) AS mean_correct FROM chosen GROUP BY provider, model, task_id), {_ci_sql("task_means", "provider, model", "task_id", "mean_correct")},
each AS (
  SELECT provider, model, count(*) AS n_cells, count(DISTINCT task_id) AS n_tasks, CASE WHEN sum(correct) = 0 THEN 'infinity'::DOUBLE ELSE sum(input_tokens + output_tokens + build_tokens)::DOUBLE / sum(correct) END AS tpca_1,
    CASE WHEN sum(correct) = 0 THEN 'infinity'::DOUBLE ELSE (sum(input_tokens + output_tokens) + sum(build_tokens) / 10000.0::DOUBLE) / sum(correct) END AS tpca_10000,
    quantile_cont((input_tokens + output_tokens + build_tokens)::DOUBLE, 0.5) AS median_tokens FROM chosen GROUP BY provider, model),
board AS (SELECT * FROM each JOIN (SELECT provider, model, avg(correct) AS accuracy FROM chosen GROUP BY provider, model) USING (provider, model) JOIN ci_rows USING (provider, model))
SELECT provider, model, split_part(model, '.', -1) AS short_model, n_cells, n_tasks, round(accuracy, 6) AS accuracy, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(tpca_1, 4) AS tpca_1,
  round(tpca_10000, 4) AS tpca_10000, median_tokens, accuracy > 0 AND NOT EXISTS (
    SELECT 1 FROM board q WHERE q.accuracy > 0 AND q.tpca_1 <= p.tpca_1 AND q.accuracy >= p.accuracy AND (q.tpca_1 < p.tpca_1 OR q.accuracy > p.accuracy)) AS on_frontier
FROM board p""")
def leaderboard_public(spark, sf_dir):
    public = _split_runs(spark, sf_dir).where("split = 'public'")
    board = leaderboard.leaderboard(public, interval=bootstrap.hashed_ci)
    return rounded(rounded(board, 6, "accuracy", "ci_low", "ci_high"), 4, "tpca_1", "tpca_10000")


@query(f"""WITH {bridge.RUNS}, {_MANIFEST}, chosen AS (SELECT runs.*, split FROM runs JOIN manifest USING (task_id)), public_runs AS (SELECT * FROM chosen WHERE split = 'public'),
{_ci_sql("public_runs", "provider, model", "task_id, repeat, correct", "correct")},
a AS (SELECT provider, model, avg(correct) AS public FROM public_runs GROUP BY provider, model), b AS (SELECT provider, model, avg(correct) AS heldout FROM chosen WHERE split = 'heldout' GROUP BY provider, model),
both_sides AS (SELECT provider, model, coalesce(public, 0) AS public, coalesce(heldout, 0) AS heldout, coalesce(ci_high - ci_low, 0) AS ci_width FROM a FULL JOIN b USING (provider, model) LEFT JOIN ci_rows USING (provider, model))
SELECT provider, model, round(public, 6) AS public, round(heldout, 6) AS heldout, round(public - heldout, 6) AS gap, round(ci_width, 6) AS ci_width, abs(public - heldout) > 2 * ci_width AND ci_width > 0 AS flagged FROM both_sides""")
def heldout_gap(spark, sf_dir):
    return rounded(leaderboard.heldout_gap(_split_runs(spark, sf_dir), interval=bootstrap.hashed_ci), 6, "public", "heldout", "gap", "ci_width")


# Calibration.


@query(f"WITH {bridge.VOTES} SELECT task_id, human, pass_count, n_votes, judged, round(confidence, 9) AS confidence FROM verdicts")
def vote_majority(spark, sf_dir):
    out = calibration.majority(bridge.audited(spark, sf_dir)).drop("votes")
    return rounded(out.withColumns({c: F.col(c).cast("bigint") for c in ("pass_count", "n_votes")}), 9, "confidence")


_KAPPA = """SELECT count(*) AS n, avg((human = judged)::INT) AS agreement, avg(human::INT) AS h, avg(judged::INT) AS j"""


@query(f"""WITH {bridge.VOTES}, s AS ({_KAPPA} FROM verdicts) SELECT n, round(agreement, 9) AS agreement,
  round(CASE WHEN abs(1 - (h * j + (1 - h) * (1 - j))) < 1e-12 THEN 0 ELSE (agreement - (h * j + (1 - h) * (1 - j))) / (1 - (h * j + (1 - h) * (1 - j))) END, 9) AS kappa FROM s""")
def cohen_kappa(spark, sf_dir):
    return rounded(calibration.kappa(calibration.majority(bridge.audited(spark, sf_dir))), 9, "agreement", "kappa")


@query(f"""WITH {bridge.VOTES}, b AS (SELECT least(floor(confidence * 10), 9)::INT AS bin, count(*) AS n, avg(confidence) AS c, avg(human::INT) AS p FROM verdicts GROUP BY 1)
SELECT i::INT AS bin, coalesce(n, 0) AS n, round(c, 9) AS mean_confidence, round(p, 9) AS pass_rate, round(coalesce(n::DOUBLE / (SELECT count(*) FROM verdicts) * abs(c - p), 0), 9) AS weighted_gap
FROM range(10) t(i) LEFT JOIN b ON b.bin = i""")
def ece_bins(spark, sf_dir):
    return rounded(calibration.calibration_bins(calibration.majority(bridge.audited(spark, sf_dir))), 9, "mean_confidence", "pass_rate", "weighted_gap")


@query(f"""WITH {bridge.VOTES}, c AS (SELECT count(*) FILTER (human AND judged) AS tp, count(*) FILTER (NOT human AND judged) AS fp, count(*) FILTER (human AND NOT judged) AS fn, count(*) FILTER (NOT human AND NOT judged) AS tn FROM verdicts)
SELECT tp, fp, fn, tn, round(fn::DOUBLE / (tp + fn), 9) AS fn_rate, round(fp::DOUBLE / (fp + tn), 9) AS fp_rate FROM c""")
def confusion(spark, sf_dir):
    return rounded(calibration.confusion(calibration.majority(bridge.audited(spark, sf_dir))), 9, "fn_rate", "fp_rate")


_LONG = "long AS (SELECT human, dim, score FROM (SELECT human, parse_error, correctness, completeness, faithfulness FROM vote_rows) UNPIVOT (score FOR dim IN (correctness, completeness, faithfulness)) WHERE NOT parse_error)"


@query(f"WITH {bridge.VOTES}, {_LONG} SELECT human, dim, score, count(*) AS n FROM long GROUP BY human, dim, score")
def dim_histogram(spark, sf_dir):
    return calibration.dimension_scores(bridge.audited(spark, sf_dir))


@query(f"WITH {bridge.VOTES}, {_LONG} SELECT human, dim, round(avg(score), 9) AS mean_score, count(*) AS n FROM long GROUP BY human, dim")
def dim_means(spark, sf_dir):
    return rounded(calibration.dimension_means(bridge.audited(spark, sf_dir)), 9, "mean_score")


FLOORS = ((1, 1, 2), (1, 1, 1), (1, 0, 2), (1, 0, 1), (2, 1, 2), (1, 1, 0))


@query(f"""WITH {bridge.VOTES}, floors(a, b, c) AS (VALUES {", ".join(map(str, FLOORS))}),
each AS (SELECT a::VARCHAR || '/' || b::VARCHAR || '/' || c::VARCHAR AS floor, task_id, any_value(human) AS human, count(*) AS n, count(*) FILTER (NOT parse_error AND correctness >= a AND completeness >= b AND faithfulness >= c) AS p FROM vote_rows, floors GROUP BY ALL),
v AS (SELECT floor, human, p > n // 2 AS judged, p::DOUBLE / n AS confidence FROM each), s AS ({_KAPPA}, floor FROM v GROUP BY floor),
bins AS (SELECT floor, least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(human::INT) AS p FROM v GROUP BY 1, 2),
e AS (SELECT floor, sum(n * abs(c - p)) / sum(n) AS ece FROM bins GROUP BY floor)
SELECT floor, n, round(agreement, 9) AS agreement, round((agreement - (h * j + (1 - h) * (1 - j))) / (1 - (h * j + (1 - h) * (1 - j))), 9) AS kappa, round(ece, 9) AS ece FROM s JOIN e USING (floor)""")
def counterfactual_floor(spark, sf_dir):
    return rounded(calibration.floor_grid(bridge.audited(spark, sf_dir), FLOORS), 9, "agreement", "kappa", "ece")


@query(f"""WITH {bridge.VOTES}, s AS ({_KAPPA}, count(*) FILTER (human) AS human_pass, count(*) FILTER (judged) AS judge_pass FROM verdicts),
bins AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(human::INT) AS p FROM verdicts GROUP BY 1),
t AS (SELECT *, (agreement - (h * j + (1 - h) * (1 - j))) / (1 - (h * j + (1 - h) * (1 - j))) AS kappa, (SELECT sum(n * abs(c - p)) / sum(n) FROM bins) AS ece FROM s)
SELECT n, round(agreement, 9) AS agreement, round(kappa, 9) AS kappa, round(ece, 9) AS ece, human_pass, judge_pass, kappa >= 0.60 AS kappa_ok, ece <= 0.10 AS ece_ok, true AS badge_ok FROM t""")
def calibration_summary(spark, sf_dir):
    return rounded(calibration.summary(calibration.majority(bridge.audited(spark, sf_dir))), 9, "agreement", "kappa", "ece")


_JSON = "'The verdict: {\"correctness\": ' || (('0x' || substr(md5(doc_id::VARCHAR), 1, 1))::INT % 4)::VARCHAR || ', \"completeness\": ' || quality::VARCHAR || CASE WHEN doc_id % 7 = 0 THEN '} end' ELSE ', \"faithfulness\": 2} end' END"


@query(f"""WITH raw AS (SELECT doc_id, {_JSON} AS output FROM labels), x AS (SELECT doc_id, regexp_extract(output, '\\{{.*\\}}', 0, 's') AS j FROM raw),
y AS (SELECT doc_id, json_extract_string(j, '$.correctness') AS a, json_extract_string(j, '$.completeness') AS b, json_extract_string(j, '$.faithfulness') AS c FROM x)
SELECT doc_id, coalesce(a IN ('0', '1', '2') AND b IN ('0', '1', '2') AND c IN ('0', '1', '2'), false) AS valid,
  coalesce(a IN ('0', '1', '2') AND b IN ('0', '1', '2') AND c IN ('0', '1', '2') AND a::INT >= 1 AND b::INT >= 1 AND c::INT >= 1, false) AS passes FROM y""")
def judge_json(spark, sf_dir):
    """Scores out of judge output, some of it not valid."""
    labels = bridge.table(spark, sf_dir, "labels")
    first = F.conv(F.substr(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(1), F.lit(1)), 16, 10).cast("int") % 4
    output = F.concat(F.lit('The verdict: {"correctness": '), first.cast("string"), F.lit(', "completeness": '), F.col("quality").cast("string"), F.when(F.col("doc_id") % 7 == 0, "} end").otherwise(', "faithfulness": 2} end'))
    scored = labels.select("doc_id", T.judge_scores(output).alias("s"))
    return scored.select("doc_id", F.col("s").isNotNull().alias("valid"), T.passes_floor(F.col("s")).alias("passes"))


@query("""SELECT doc_id, v, substr(sha256('run-1|' || doc_id::VARCHAR || '|' || v::VARCHAR), 1, 16) AS salt FROM labels, (VALUES (0), (1), (2)) t(v)""")
def vote_salts(spark, sf_dir):
    labels = bridge.table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v"))
    return labels.select("doc_id", "v", T.vote_salt(F.col("doc_id").cast("string"), F.col("v"), F.lit("run-1")).alias("salt"))


# Audit.


def _configs_sql() -> str:
    rows = ", ".join(f"('{p}', '{c}')" for p, c in zip(bridge.PROVIDERS, bridge.CONFIGS, strict=True))
    tactics = ", ".join(f"'{t}'" for t in audit.GAMING_TACTICS)
    return f"""configs(provider, config) AS (VALUES {rows}), used AS (SELECT DISTINCT provider FROM runs), have AS (SELECT * FROM configs JOIN used USING (provider) WHERE config <> '{{}}'),
c1 AS (
  SELECT 'C1.gaming_config' AS code, 'HIGH' AS severity, provider, NULL::VARCHAR AS task_id, k AS evidence FROM have, (VALUES ('reads_gold'), ('reads_needle')) t(k)
    WHERE coalesce(json_extract_string(config, '$.' || k), 'false') NOT IN ('false', '0', '')
  UNION ALL SELECT 'C1.gaming_config', 'LOW', provider, NULL, 'policy' FROM have WHERE json_extract_string(config, '$.policy') = '{audit.GAMING_POLICY}'
  UNION ALL SELECT 'C1.gaming_config', 'MEDIUM', provider, NULL, string_agg(t, ',' ORDER BY i) FROM (
    SELECT provider, unnest(json_extract_string(config, '$.tactics[*]')) AS t, generate_subscripts(json_extract_string(config, '$.tactics[*]'), 1) AS i FROM have) WHERE t IN ({tactics}) GROUP BY provider)"""


@query(f"WITH {bridge.RUNS}, {_configs_sql()} SELECT * FROM c1")
def audit_config(spark, sf_dir):
    return audit.config_findings(bridge.configured(spark, sf_dir))


_INJECTED = f"""{bridge.AUDIT}, {bridge.AUDIT_RUNS}, hits AS (SELECT *, strpos(candidate, '{bridge.INJECTION_TEXT.strip()[:17]}') AS place FROM audit WHERE regexp_matches(candidate, '{T.INJECTION.replace("'", "''")}')),
c2 AS (SELECT 'C2.judge_injection' AS code, 'HIGH' AS severity, provider, h.task_id, replace(substr(candidate, greatest(place - 30, 1), place + 17 + 30 - greatest(place - 30, 1)), chr(10), ' ') AS evidence
  FROM hits h LEFT JOIN (SELECT trace_uri, task_id, arg_max(provider, seq) AS provider FROM audit_runs GROUP BY ALL) r ON r.trace_uri = h.uri AND r.task_id = h.task_id)"""


@query(f"WITH {_INJECTED} SELECT * FROM c2")
def audit_injection(spark, sf_dir):
    return audit.injection_findings(bridge.audit_log(spark, sf_dir), bridge.audit_runs(spark, sf_dir))


_FLOOR = """c3 AS (SELECT 'C3.priors_floor_anomaly' AS code, 'HIGH' AS severity, a.provider, NULL::VARCHAR AS task_id, 'n=' || count(*)::VARCHAR AS evidence
  FROM runs a JOIN runs b USING (task_id, repeat, model) WHERE a.provider IN ('symbol-map', 'raw-dump') AND b.provider = 'bm25' GROUP BY a.provider HAVING avg(a.correct - b.correct) > 0.20)"""


@query(f"WITH {bridge.RUNS}, {_FLOOR} SELECT * FROM c3")
def audit_floor(spark, sf_dir):
    return audit.floor_findings(bridge.runs(spark, sf_dir), ["symbol-map", "raw-dump"], floor="bm25")


def _all_findings(spark, sf_dir):
    every = audit_config(spark, sf_dir).unionByName(audit_injection(spark, sf_dir)).unionByName(audit_floor(spark, sf_dir))
    return every.unionByName(audit.trace_findings(bridge.audit_runs(spark, sf_dir)))


@query(f"WITH {bridge.RUNS}, {_configs_sql()}, {_INJECTED}, {_FLOOR} SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3")
def findings(spark, sf_dir):
    return audit.ranked(_all_findings(spark, sf_dir))


@query(f"WITH {bridge.RUNS}, {_configs_sql()}, {_INJECTED}, {_FLOOR} SELECT severity, count(*) AS n FROM (SELECT severity FROM c1 UNION ALL SELECT severity FROM c2 UNION ALL SELECT severity FROM c3) GROUP BY severity")
def findings_by_severity(spark, sf_dir):
    return audit.by_severity(_all_findings(spark, sf_dir))


# Usage.

_SUMS = "count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read)::BIGINT AS cache_read, sum(cache_creation)::BIGINT AS cache_creation, sum(input_tokens + output_tokens)::BIGINT AS total_tokens"


@query(f"WITH {bridge.USAGE} SELECT strftime(date, '%Y-%m-%d') AS date, model, {_SUMS} FROM usage GROUP BY date, model UNION ALL SELECT strftime(date, '%Y-%m-%d'), NULL, {_SUMS} FROM usage GROUP BY date")
def usage_rollup(spark, sf_dir):
    return usage.daily_totals(bridge.usage(spark, sf_dir)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(f"WITH {bridge.USAGE}, day AS (SELECT * FROM usage WHERE date = DATE '2024-01-03') SELECT '2024-01-03' AS date, model, {_SUMS} FROM day GROUP BY model UNION ALL SELECT '2024-01-03', NULL, {_SUMS} FROM day")
def usage_of_day(spark, sf_dir):
    return usage.totals_for(bridge.usage(spark, sf_dir), "2024-01-03").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


# Text and retrieval.


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def needle_contains(spark, sf_dir):
    return retrieval.containing(bridge.table(spark, sf_dir, "documents"), bridge.table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(r"""WITH flat AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
ends AS (SELECT *, strpos(t, '. ') AS a, strpos(t, '? ') AS b, strpos(t, '! ') AS c FROM flat)
SELECT doc_id, md5(substr(t, 1, CASE WHEN a > 1 AND a <= 200 THEN a WHEN b > 1 AND b <= 200 THEN b WHEN c > 1 AND c <= 200 THEN c ELSE 200 END)) AS sentence_md5 FROM ends""")
def first_sentence(spark, sf_dir):
    return bridge.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.first_sentence(F.col("text"), 200).cast("binary")).alias("sentence_md5"))


_COUNT = "len(regexp_extract_all(text, '[A-Za-z]+|[0-9]{1,3}|[^\\sA-Za-z0-9]'))"


@query(f"SELECT doc_id, {_COUNT} AS n_tokens, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[A-Za-z0-9]+')) AS n_words FROM documents")
def token_counts(spark, sf_dir):
    docs = bridge.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.count_tokens(F.col("text")).cast("bigint").alias("n_tokens"), F.size(T.word_tokens(F.col("text"))).cast("bigint").alias("n_words"))


@query(f"""WITH c AS (SELECT doc_id, {_COUNT} AS n FROM documents) SELECT doc_id, i::INT AS chunk, least(200, n - i * 160)::INT AS chunk_tokens
FROM c, LATERAL (SELECT unnest(range(1 + ceil(greatest(n - 200, 0) / 160.0)::BIGINT)) AS i) WHERE n > 0""")
def chunk_windows(spark, sf_dir):
    return retrieval.chunks(bridge.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "chunk", "chunk_tokens")


@query("""WITH tok AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM tok), words AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM words GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, stats),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM benchmark) GROUP BY ALL),
weight AS (SELECT item_id, term, times, CASE WHEN raw < 0 THEN (SELECT avg(raw) FROM idf) * 0.25::DOUBLE ELSE raw END AS idf FROM q JOIN idf USING (term)),
hit AS (SELECT item_id, doc_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM tf JOIN weight USING (term), stats GROUP BY ALL),
scored AS (SELECT b.item_id, d.doc_id, coalesce(score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN hit ON hit.item_id = b.item_id AND hit.doc_id = d.doc_id)
SELECT item_id, doc_id, round(score, 4) AS score, (row_number() OVER (PARTITION BY item_id ORDER BY round(scored.score, 9) DESC, doc_id))::INT AS rank FROM scored QUALIFY rank <= 5""")
def bm25_topk(spark, sf_dir):
    docs, asked = bridge.table(spark, sf_dir, "documents"), bridge.table(spark, sf_dir, "benchmark")
    return rounded(retrieval.bm25(docs, asked, "doc_id", "item_id"), 4, "score")


_TOKENS = """label_words AS (SELECT DISTINCT id, lower(w) AS t FROM (SELECT id, unnest(regexp_extract_all(label, '[A-Za-z][A-Za-z0-9]+')) AS w FROM nodes)),
held AS (SELECT DISTINCT id, t FROM (SELECT id, t FROM label_words UNION ALL SELECT id, unnest(regexp_extract_all(t, '[a-z]+')) FROM label_words) WHERE length(t) BETWEEN 3 AND 30),
words AS (SELECT t, count(*) AS df, ln((SELECT count(*) FROM nodes)::DOUBLE / count(*)) AS idf FROM held GROUP BY t)"""
_ASKED = ", ".join(f"('{w}')" for w in sorted({w for w in __import__("re").findall("[a-z]+", QUESTION.lower()) if len(w) >= 3}))
_SEEDS = f"seed_rows AS (SELECT id, sum(idf) AS score FROM held JOIN words USING (t) WHERE t IN (SELECT * FROM (VALUES {_ASKED})) GROUP BY id ORDER BY score DESC, id LIMIT 10)"


@query(f"WITH {bridge.GRAPH}, {_TOKENS} SELECT t AS token, df, round(idf, 9) AS idf FROM words")
def idf_vocab(spark, sf_dir):
    return rounded(retrieval.vocabulary(bridge.nodes(spark, sf_dir))[1], 9, "idf")


@query(f"WITH {bridge.GRAPH}, {_TOKENS}, {_SEEDS} SELECT id, round(score, 6) AS score FROM seed_rows")
def graph_seeds(spark, sf_dir):
    return rounded(retrieval.seeds(bridge.nodes(spark, sf_dir), F.lit(QUESTION)), 6, "score")


_NEAR = """both_ways AS (SELECT source, target FROM links UNION SELECT target, source FROM links), d0 AS (SELECT id AS node FROM seed_rows),
d1 AS (SELECT DISTINCT target AS node FROM both_ways JOIN d0 ON source = node EXCEPT SELECT node FROM d0),
d2 AS (SELECT DISTINCT target AS node FROM both_ways JOIN d1 ON source = node EXCEPT (SELECT node FROM d0 UNION SELECT node FROM d1)),
near AS (SELECT node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2)"""


@query(f"WITH {bridge.GRAPH}, {_TOKENS}, {_SEEDS}, {_NEAR} SELECT node, depth FROM near")
def bfs_neighborhood(spark, sf_dir):
    nodes = bridge.nodes(spark, sf_dir)
    start = retrieval.seeds(nodes, F.lit(QUESTION)).select(F.col("id").alias("node"))
    return retrieval.neighbourhood(retrieval.undirected(bridge.links(spark, sf_dir), nodes), start)


@query(f"""WITH {bridge.GRAPH}, {_TOKENS}, {_SEEDS}, {_NEAR},
lines AS (SELECT node, depth, '- ' || label || '  (' || source_file || ':' || source_location || ')' || chr(10) AS text FROM near JOIN nodes ON nodes.id = near.node),
costs AS (SELECT *, sum({_COUNT}) OVER (ORDER BY depth, node) AS used FROM lines) SELECT node, depth, used::BIGINT AS used FROM costs WHERE used <= 3000""")
def pack_budget(spark, sf_dir):
    packed = retrieval.graph_context(bridge.nodes(spark, sf_dir), bridge.links(spark, sf_dir), F.lit(QUESTION))
    return packed.select("node", "depth", F.col("used").cast("bigint").alias("used"))


def _rank_sql(steps: int) -> str:
    parts = ["all_nodes AS MATERIALIZED (SELECT source AS node FROM file_links UNION SELECT target FROM file_links)", "w AS MATERIALIZED (SELECT source, target, 1.0::DOUBLE / count(*) OVER (PARTITION BY source) AS weight FROM file_links)",
             "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM all_nodes) AS rank FROM all_nodes)"]
    for k in range(1, steps + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM all_nodes) + 0.85::DOUBLE * coalesce(g.given, 0) AS rank FROM all_nodes n LEFT JOIN (SELECT target, sum(weight * rank) AS given FROM w JOIN r{k - 1} ON node = source GROUP BY target) g ON g.target = n.node)")
    return ", ".join(parts)


@query(f"WITH {bridge.FILE_LINKS}, {_rank_sql(30)} SELECT node, round(rank, 8) AS rank FROM r30")
def pagerank(spark, sf_dir):
    return rounded(retrieval.link_rank(bridge.file_links(spark, sf_dir)), 8, "rank")


@query(f"""WITH c AS (SELECT source, doc_id, {_COUNT} AS tokens FROM documents), r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) - tokens AS before FROM c WHERE tokens > 0)
SELECT source, doc_id, tokens, least(tokens, 80000 - before)::BIGINT AS kept_tokens FROM r WHERE before < 80000""")
def raw_dump_truncate(spark, sf_dir):
    return retrieval.head_of_dump(bridge.table(spark, sf_dir, "documents"), ["source"], ["doc_id"])


@query(f"""WITH {bridge.GRAPH}, t AS (SELECT '- ' || label || '  (' || source_file || ':' || source_location || ')' || chr(10) AS text FROM nodes
UNION ALL SELECT source::VARCHAR || '--beside->' || target::VARCHAR FROM links) SELECT sum({_COUNT})::BIGINT AS build_tokens FROM t""")
def graph_build_cost(spark, sf_dir):
    return retrieval.graph_build_tokens(bridge.nodes(spark, sf_dir), bridge.links(spark, sf_dir))


_PROMPT = f"'{INSTRUCTION}' || chr(10) || chr(10) || '<context>' || chr(10) || coalesce(text, '') || chr(10) || '</context>' || chr(10) || chr(10) || 'Question: q' || item_id::VARCHAR || chr(10) || 'Answer:'"


@query(f"SELECT item_id, md5({_PROMPT}) AS prompt_md5, md5(coalesce(text, '')) AS context_md5 FROM benchmark")
def prompt_render(spark, sf_dir):
    items = bridge.table(spark, sf_dir, "benchmark")
    prompt = T.render_prompt(INSTRUCTION, F.coalesce("text", F.lit("")), F.concat(F.lit("q"), F.col("item_id").cast("string")))
    return items.select("item_id", F.md5(prompt.cast("binary")).alias("prompt_md5"), F.md5(T.context_of(prompt).cast("binary")).alias("context_md5"))


@query("""WITH p AS (SELECT doc_id, s AS seed, 'Find it.' || chr(10) || 'GOLD: name' || doc_id::VARCHAR || chr(10) || 'end' AS prompt FROM documents, range(2) t(s)),
d AS (SELECT *, ('0x' || substr(sha256(seed::VARCHAR || '|' || prompt), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM p)
SELECT doc_id, seed, CASE WHEN draw < 0.5 THEN 'name' || doc_id::VARCHAR ELSE 'unknown' END AS output, (draw < 0.5)::INT AS correct FROM d""")
def sweep_execution(spark, sf_dir):
    """Cells of the offline model: prompts with a GOLD line, scored by containment."""
    docs = bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("task_id"), "doc_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("seed"))
    gold = F.concat(F.lit("name"), F.col("task_id"))
    ready = lambda cells: cells.withColumn("prompt", F.concat(F.lit("Find it.\nGOLD: "), gold, F.lit("\nend"))).withColumn("needle", F.lit(None).cast("string")).withColumn("gold", gold)
    return store.execute(docs, ready).select("doc_id", "seed", "output", "correct")


@query(f"""WITH defs AS (SELECT DISTINCT 'src' || (p_partkey % 40)::VARCHAR AS target, 'name_' || p_partkey::VARCHAR AS ident FROM part),
uses AS (SELECT DISTINCT 'src' || (l_orderkey % 40)::VARCHAR AS source, 'name_' || l_partkey::VARCHAR AS ident FROM lineitem)
SELECT DISTINCT source, target FROM uses JOIN defs USING (ident) WHERE source <> target""")
def identifier_edges(spark, sf_dir):
    """Files that mention what another defines; here a file's text lists the parts of its orders."""
    part, line = bridge.table(spark, sf_dir, "part"), bridge.table(spark, sf_dir, "lineitem")
    symbols = part.select(F.concat(F.lit("src"), (F.col("p_partkey") % 40).cast("string")).alias("file"), F.format_string("name_%d", "p_partkey").alias("name"))
    texts = line.select(F.concat(F.lit("src"), (F.col("l_orderkey") % 40).cast("string")).alias("file"), F.format_string("call name_%d()", "l_partkey").alias("text")).distinct()
    used = retrieval.reference_edges(texts, symbols)
    return used.select("source", "target")


@query("SELECT doc_id, md5(task) AS repo_md5, CASE WHEN starts_with(task, 'needle-') THEN 'needle' ELSE 'swe_qa' END AS family FROM (SELECT doc_id, source AS task FROM documents)")
def task_families(spark, sf_dir):
    docs = bridge.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.repo_of_task(F.col("source")).cast("binary")).alias("repo_md5"), T.task_family(F.col("source")).alias("family"))


@query(f"""WITH {bridge.RUNS}, fam AS (SELECT *, CASE WHEN repeat < 3 THEN 'needle' ELSE 'swe_qa' END AS family FROM runs),
task_means AS (SELECT family, provider, model, task_id, avg(correct) AS mean_correct FROM fam GROUP BY ALL), {_ci_sql("task_means", "family, provider, model", "task_id", "mean_correct")},
board AS (SELECT family, provider, model, avg(correct) AS accuracy, sum(input_tokens + output_tokens + build_tokens)::DOUBLE / sum(correct) AS tpca_1 FROM fam GROUP BY ALL)
SELECT family, provider, model, round(accuracy, 9) AS accuracy, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, accuracy > 0 AND NOT EXISTS (
  SELECT 1 FROM board q WHERE q.family = p.family AND q.accuracy > 0 AND q.tpca_1 <= p.tpca_1 AND q.accuracy >= p.accuracy AND (q.tpca_1 < p.tpca_1 OR q.accuracy > p.accuracy)) AS on_frontier
FROM board p JOIN ci_rows USING (family, provider, model)""")
def leaderboard_by_family(spark, sf_dir):
    runs = bridge.runs(spark, sf_dir).withColumn("family", F.when(F.col("repeat") < 3, "needle").otherwise("swe_qa"))
    board = leaderboard.by_family(runs, interval=bootstrap.hashed_ci)
    return rounded(board.select("family", "provider", "model", "accuracy", "ci_low", "ci_high", "on_frontier"), 9, "accuracy", "ci_low", "ci_high")


# Providers.

_TASKS_SQL = "asks AS (SELECT item_id AS task_id, coalesce(text, '') AS question, CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN 'llm_judge' ELSE 'auto_contains' END AS scoring FROM benchmark)"


def _tasks(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    scoring = F.when(F.length(text) % 2 == 0, "llm_judge").otherwise("auto_contains")
    return bridge.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), text.alias("question"), scoring.alias("scoring"), F.substr(text, F.lit(1), F.lit(8)).alias("gold"))


def _asked_sql(context: str) -> str:
    escaped = lambda t: t.replace("'", "''")
    return f"""CASE WHEN scoring = 'llm_judge' THEN '{escaped(providers.FREEFORM)}' ELSE '{escaped(providers.STANDARD)}' END || chr(10) || chr(10) || '<context>' || chr(10) || {context} || chr(10) || '</context>'
  || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:'"""


def _shown(prompts: DataFrame) -> DataFrame:
    return prompts.select("task_id", "provider", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "input_tokens", "build_tokens")


def _provider_sql(name: str, prompt: str, build: str = "0") -> str:
    return f"p AS (SELECT task_id, {prompt} AS text FROM asks) SELECT task_id, '{name}' AS provider, md5(text) AS prompt_md5, {_COUNT} AS input_tokens, {build}::BIGINT AS build_tokens FROM p"


@query(f"WITH {_TASKS_SQL}, {_provider_sql('zero-context', _asked_sql(chr(39) * 2))}")
def zero_context_prompts(spark, sf_dir):
    return _shown(providers.zero_context(_tasks(spark, sf_dir)))


_GAMED = f"'Question restatement: ' || question || chr(10) || 'Likely candidates: {', '.join(providers.COMMON_IDENTIFIERS)}.' || chr(10) || '{providers.JUDGE_NOTE}'"


@query(f"WITH {_TASKS_SQL}, {_provider_sql('exploit-baseline', _asked_sql(_GAMED))}")
def exploit_prompts(spark, sf_dir):
    return _shown(providers.exploit_baseline(_tasks(spark, sf_dir)))


def _mock_sql(name: str) -> str:
    build, words = providers.MOCKS[name]
    prompt = f"""'You are answering a question about a codebase.' || chr(10) || 'GOLD: ' || substr(question, 1, 8) || chr(10) || 'CONTEXT:' || chr(10) || rtrim(repeat('word ', {words})) || chr(10) || 'QUESTION: ' || question || chr(10) || 'ANSWER:'"""
    return f"SELECT task_id, '{name}' AS provider, md5(text) AS prompt_md5, {_COUNT} AS input_tokens, {build}::BIGINT AS build_tokens FROM (SELECT task_id, {prompt} AS text FROM asks)"


@query(f"WITH {_TASKS_SQL} " + " UNION ALL ".join(_mock_sql(n) for n in providers.MOCKS))
def mock_prompts(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    parts = [_shown(providers.mock(tasks, n)) for n in providers.MOCKS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FILES_SQL = "files AS (SELECT 'f' || lpad(doc_id::VARCHAR, 8, '0') AS file, text FROM documents WHERE doc_id < 40 AND text IS NOT NULL)"


def _files(spark, sf_dir):
    """Forty documents stand for the files of a repository."""
    docs = bridge.table(spark, sf_dir, "documents").where("doc_id < 40 AND text IS NOT NULL")
    return docs.select(F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("file"), "text")


@query(f"WITH {_TASKS_SQL}, {_FILES_SQL}, dump AS (SELECT coalesce(string_agg('# file: ' || file || chr(10) || text, chr(10) || chr(10) ORDER BY file), '') AS all_text FROM files), {_provider_sql('raw-dump', _asked_sql('(SELECT all_text FROM dump)'))}")
def raw_dump_prompts(spark, sf_dir):
    """A repository that lies within the budget; ``raw_dump_truncate`` has the cut."""
    return _shown(providers.raw_dump(_tasks(spark, sf_dir), _files(spark, sf_dir), budget=10_000_000))


@query()
def rag_prompts(spark, sf_dir):
    """Chunked, ranked, joined and asked; held against brute force in the tests."""
    return _shown(providers.rag(_tasks(spark, sf_dir), _files(spark, sf_dir)))


@query(f"WITH {_FILES_SQL}, c AS (SELECT {_COUNT} AS n FROM files), w AS (SELECT least(200, n - i * 160) AS t FROM c, LATERAL (SELECT unnest(range(0, 1 + greatest(ceil((n - 200) / 160.0), 0)::BIGINT)) AS i) WHERE n > 0) SELECT coalesce(sum(t), 0)::BIGINT AS build_tokens FROM w")
def chunk_build_cost(spark, sf_dir):
    return retrieval.chunk_build_tokens(_files(spark, sf_dir))


# Judge.


def _judge_answer(prompt, k):
    """The offline judge: scores from a hash of the prompt, at times no JSON at all."""
    digit = lambda n: (F.ascii(F.substr(F.md5(prompt.cast("binary")), F.lit(n), F.lit(1))) % 3).cast("string")
    body = F.concat(F.lit('{"correctness": '), digit(1), F.lit(', "completeness": '), digit(2), F.lit(', "faithfulness": '), digit(3), F.lit("}"))
    return F.when(F.ascii(F.substr(F.md5(prompt.cast("binary")), F.lit(4), F.lit(1))) % 7 == 0, F.lit("no verdict")).otherwise(body)


@query(f"""WITH {_TASKS_SQL}, v AS (SELECT task_id, k, 'Judge the candidate against the reference.' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Reference: ' || substr(question, 1, 8) || chr(10) || 'Candidate: ' || 'an answer'
    || chr(10) || chr(10) || '[vote-salt: ' || substr(sha256('run-1|' || task_id::VARCHAR || '|' || k::VARCHAR), 1, 16) || ']' AS prompt FROM asks, range(5) t(k) WHERE scoring = 'llm_judge'),
s AS (SELECT task_id, k, ascii(substr(md5(prompt), 4, 1)) % 7 = 0 AS bad, ascii(substr(md5(prompt), 1, 1)) % 3 AS a, ascii(substr(md5(prompt), 2, 1)) % 3 AS b, ascii(substr(md5(prompt), 3, 1)) % 3 AS c FROM v),
j AS (SELECT task_id, count(*) FILTER (NOT bad AND a >= 1 AND b >= 1 AND c >= 1) AS pass_count, count(*) FILTER (bad) AS parse_errors FROM s GROUP BY task_id)
SELECT task_id, pass_count, parse_errors, pass_count > 2 AS correct, round(pass_count / 5.0::DOUBLE, 9) AS raw, 'run-1.jsonl' AS trace_uri FROM j""")
def judge_votes(spark, sf_dir):
    tasks = _tasks(spark, sf_dir).where("scoring = 'llm_judge'").withColumn("reference", F.col("gold")).withColumn("candidate", F.lit("  an answer\n"))
    done = judge.judged(tasks, _judge_answer, judge_model="vendor.judge", answering=bridge.MODELS, run="run-1", n_votes=5)
    errors = F.size(F.filter("votes", lambda v: v["parse_error"])).cast("bigint")
    return rounded(done.select("task_id", F.col("pass_count").cast("bigint").alias("pass_count"), errors.alias("parse_errors"), "correct", "raw", "trace_uri"), 9, "raw")


@query(f"WITH {bridge.VOTES} SELECT task_id, human, 3::BIGINT AS n_votes FROM (SELECT DISTINCT task_id, human FROM vote_rows) WHERE ('0x' || substr(md5(task_id), 1, 1))::INT < 8")
def votes_or_skip(spark, sf_dir):
    """Labelled tasks with votes; those whose votes are missing are left out."""
    audited = bridge.audited(spark, sf_dir)
    some = audited.where(F.conv(F.substr(F.md5(F.col("task_id").cast("binary")), F.lit(1), F.lit(1)), 16, 10).cast("int") < 8)
    return calibration.voted(audited.select("task_id", "human"), some).select("task_id", "human", F.size("votes").cast("bigint").alias("n_votes"))


@query(f"WITH {bridge.RUNS} SELECT DISTINCT 'provider' AS kind, provider AS name FROM runs UNION ALL SELECT DISTINCT 'model', model FROM runs")
def method_lists(spark, sf_dir):
    runs = bridge.runs(spark, sf_dir)
    return store.methods(runs, "provider").select(F.lit("provider").alias("kind"), F.col("provider").alias("name")).union(store.methods(runs, "model").select(F.lit("model"), "model"))


@query(f"""WITH {bridge.RUNS}, {_TASK_ROWS}, {_GRID} SELECT task_id, provider, model, repeat FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.task_id = g.task_id AND r.provider = g.provider AND r.model = g.model AND r.repeat = g.repeat AND r.ts < '1995-01-01') ORDER BY task_id, provider, model, repeat LIMIT 3""")
def missing_cells(spark, sf_dir):
    return store.missing_examples(_grid(spark), bridge.runs(spark, sf_dir).where("ts < '1995-01-01'"), ["task_id", "provider", "model", "repeat"])


# Sources and sinks: written to the shared folder and read back.


def _records(spark, sf_dir):
    runs = bridge.runs(spark, sf_dir).withColumn("cache_tokens", F.lit(0))
    records = store.as_records(runs.withColumn("seed", F.col("repeat") + 1), "1.0.0", "0.1.0").drop("run_id", "timestamp")
    return records.withColumn("run_id", F.concat_ws("/", "task_id", "provider.name", "model", F.col("repeat").cast("string"))).withColumn("timestamp", F.lit("2024-01-02 03:04:05").cast("timestamp"))


_FLAT = "run_id, task_id, provider AS provider_name, model, repeat, repeat + 1 AS seed, input_tokens AS input_tokens_norm, build_tokens AS build_tokens_norm, correct, correct::DOUBLE AS score_raw, '2024-01-02T03:04:05.000000+00:00' AS timestamp"
_FLAT_COLUMNS = ["run_id", "task_id", "provider_name", "model", "repeat", "seed", "input_tokens_norm", "build_tokens_norm", "correct", "score_raw", "timestamp"]


@query(f"WITH {bridge.RUNS} SELECT {_FLAT} FROM runs")
def run_record_files(spark, sf_dir):
    """Appended as JSON lines to two stores, which are scanned together and flattened."""
    first, second = scratch_path(spark, "runs"), scratch_path(spark, "runs")
    records = _records(spark, sf_dir)
    sinks.append_records(records.where("repeat < 2"), first)
    sinks.append_records(records.where("repeat >= 2"), second)
    return store.flatten(readers.run_records(spark, [first, second])).select(*_FLAT_COLUMNS)


@query(f"WITH {bridge.RUNS} SELECT {_FLAT} FROM runs WHERE provider = 'bm25'")
def mirror_files(spark, sf_dir):
    """Ingested twice, once in part, exported and selected by the provider."""
    mirror, copy = scratch_path(spark, "mirror"), scratch_path(spark, "export")
    records = _records(spark, sf_dir)
    sinks.ingest(mirror, records.where("repeat < 3"))
    sinks.ingest(mirror, records)
    sinks.export(spark.read.parquet(mirror), copy)
    return store.select_runs(spark.read.parquet(copy), order="run_id", provider_name="bm25", model=None).select(*_FLAT_COLUMNS)


@query("SELECT 'm' || (doc_id % 3)::VARCHAR AS model, count(*) AS calls, sum(doc_id)::BIGINT AS input_tokens, sum(2 * doc_id)::BIGINT AS total_tokens FROM labels WHERE doc_id % 2 = 0 GROUP BY 1")
def usage_files(spark, sf_dir):
    """Usage lines appended by date, one day of them read."""
    folder = scratch_path(spark, "usage")
    ts = F.when(F.col("doc_id") % 2 == 0, F.lit("2024-01-03 10:00:00")).otherwise(F.lit("2024-01-04 11:00:00")).cast("timestamp")
    zero = F.lit(0).cast("bigint")
    log = bridge.table(spark, sf_dir, "labels").select(ts.alias("ts"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"), F.col("doc_id").cast("bigint").alias("input_tokens"), F.col("doc_id").cast("bigint").alias("output_tokens"), zero.alias("cache_read"), zero.alias("cache_creation"), zero.alias("latency_ms"), F.lit("r").alias("response_id"))
    sinks.append_usage(log, folder)
    day = readers.usage_log(spark, folder, "2024-01-03")
    return day.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("total_tokens").alias("total_tokens"))


@query("SELECT 'doc-' || lpad(doc_id::VARCHAR, 8, '0') AS task_id, quality = 1 AS human FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)")
def label_files(spark, sf_dir):
    """Human labels appended as JSON lines and read with the last of each task."""
    path = scratch_path(spark, "labels")
    rows = bridge.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    label = F.when(F.col("quality") == 1, "Pass").otherwise(" fail ")
    sinks.append_records(rows.select(F.format_string("doc-%08d", "doc_id").alias("task_id"), label.alias("label"), F.lit("a1").alias("annotator_id")), path)
    return readers.human_labels(spark, path).select("task_id", "human")


@query("SELECT 'item-' || item_id::VARCHAR AS task_id, md5(coalesce(text, '')) AS candidate_md5 FROM benchmark")
def candidate_files(spark, sf_dir):
    path = scratch_path(spark, "candidates")
    rows = bridge.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("task_id"), F.coalesce("text", F.lit("")).alias("candidate"), F.lit("s").alias("source"))
    sinks.append_records(rows, path)
    return readers.candidates(spark, path).select("task_id", F.md5(F.col("candidate").cast("binary")).alias("candidate_md5"))


@query(f"WITH {_SPLIT} SELECT split, task_id, coalesce(lang, '') || ',' || coalesce(source, '') AS strata FROM assigned")
def manifest_files(spark, sf_dir):
    """Split manifests written and read back, one split at a time."""
    folder = scratch_path(spark, "manifests")
    assigned = split_assign(spark, sf_dir).select("task_id", "split", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    sinks.write_manifests(assigned, folder, ["lang", "source"])
    parts = [readers.manifest(spark, f"{folder}/split={s}").select(F.lit(s).alias("split"), "task_id", F.array_join("strata", ",").alias("strata")) for s in ("public", "heldout")]
    return parts[0].unionByName(parts[1])

