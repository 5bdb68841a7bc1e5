"""The run-record store: keys, filters, idempotent ingest, sweep planning and execution."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell is run once: these columns name it.
CELL_KEY = ("task_id", "provider_name", "provider_version", "model", "repeat", "seed", "dataset_version", "harness_version")


def flatten(records: DataFrame) -> DataFrame:
    """Nested run records as flat rows: config as JSON of sorted keys, correct as 0 or 1, times as ISO text."""
    config = F.to_json("provider.config")
    names = ("input_tokens_norm", "output_tokens_norm", "cache_tokens_norm", "build_tokens_norm", "native_input", "native_output", "latency_ms", "trace_uri")
    return records.select(
        "run_id", "task_id", "dataset_version", "harness_version", F.col("provider.name").alias("provider_name"), F.col("provider.version").alias("provider_version"),
        config.alias("provider_config_json"), "model", "repeat", "seed", *[F.col(f"telemetry.{n}").alias(n) for n in names],
        F.col("score.correct").cast("int").alias("correct"), F.col("score.raw").alias("score_raw"), F.col("score.scorer").alias("scorer"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
    )


def select_runs(runs: DataFrame, order: str | None = "timestamp", **equals: object) -> DataFrame:
    """Rows that equal each value given; a value of None does not filter."""
    for column, value in equals.items():
        if value is not None:
            runs = runs.where(F.col(column) == F.lit(value))
    return runs.orderBy(order) if order else runs


def completed_keys(runs: DataFrame, keys: Sequence[str] = CELL_KEY, **equals: object) -> DataFrame:
    return select_runs(runs, order=None, **equals).select(*keys).distinct()


def resumable(runs: DataFrame, providers: Sequence[str], models: Sequence[str], repeats: int, **equals: object) -> DataFrame:
    """Rows of a sweep that is being resumed; an empty list of providers or models keeps all."""
    chosen = select_runs(runs, order=None, **equals).where(F.col("repeat") < repeats)
    for column, values in (("provider", providers), ("model", models)):
        if values:
            chosen = chosen.where(F.col(column).isin(*values))
    return chosen


def exclude_pairs(runs: DataFrame, pairs: Sequence[tuple[str, str]], columns: tuple[str, str] = ("provider", "model")) -> DataFrame:
    """Rows but those of a short list of pairs."""
    listed = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(columns, pair, strict=True)]) for pair in pairs])
    return runs.where(~F.array_contains(listed, F.struct(*columns)))


def new_rows(mirror: DataFrame, incoming: DataFrame, key: str = "run_id") -> DataFrame:
    """Incoming rows, once each, whose key the mirror does not have; rows are never updated."""
    return incoming.dropDuplicates([key]).join(mirror.select(key), key, "left_anti")


def task_grid(tasks: DataFrame, providers: Sequence[str], models: Sequence[str], repeats: int, base_seed: int = 0, index: str = "task_index", n_tasks: Column | None = None) -> DataFrame:
    """Every task with every provider, model and repeat, and the seed derived from its place."""
    count = n_tasks if n_tasks is not None else tasks.agg(F.count(F.lit(1))).scalar()
    each = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    grid = tasks.select("*", each("provider", providers)).select("*", each("model", models)).select("*", each("repeat", range(repeats)))
    return grid.withColumn("seed", (F.lit(base_seed) + F.col("repeat") * count + F.col(index)).cast("bigint"))


def pending(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells that are not completed; a key planned twice stays once."""
    return grid.dropDuplicates([*keys]).join(done.select(*keys), [*keys], "left_anti")


def skipped(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grid.join(done.select(*keys).distinct(), [*keys], "left_semi")


def mock_response(prompt: Column, seed: Column, rate: float = 0.5) -> Column:
    """The offline model: answers with the prompt's GOLD line for a hashed share ``rate`` of calls, else a stub."""
    from tessera.functions.text import gold_line

    digest = F.sha2(F.concat_ws("|", seed.cast("string"), prompt), 256)
    draw = F.conv(F.substr(digest, F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)
    return F.when(draw < rate, gold_line(prompt)).otherwise(F.lit("unknown"))


def execute(cells: DataFrame, context: Callable[[DataFrame], DataFrame], respond: Callable[[Column, Column], Column] = mock_response) -> DataFrame:
    """Run the pending cells: ``context`` adds prompt, needle, gold and build_tokens, one build shared by all cells of a task."""
    from tessera.functions.text import contains_answer, count_tokens

    asked = context(cells).withColumn("output", respond(F.col("prompt"), F.col("seed")))
    return (
        asked.withColumn("input_tokens", count_tokens(F.col("prompt")).cast("bigint"))
        .withColumn("output_tokens", count_tokens(F.col("output")).cast("bigint"))
        .withColumn("cache_tokens", F.lit(0).cast("bigint"))
        .withColumn("correct", contains_answer(F.col("output"), F.col("needle"), F.col("gold")).cast("int"))
    )


def sweep(tasks: DataFrame, done: DataFrame, context: Callable[[DataFrame], DataFrame], providers: Sequence[str], models: Sequence[str], repeats: int, keys: Sequence[str] = ("task_id", "provider", "model", "repeat")) -> DataFrame:
    """Plan, prune and run a sweep; returns the newly run cells only."""
    return execute(pending(task_grid(tasks, providers, models, repeats), done, keys), context)


def cell_count(n_tasks: int, providers: Sequence[str], models: Sequence[str], repeats: int) -> int:
    return n_tasks * len(providers) * len(models) * repeats


def as_records(executed: DataFrame, dataset_version: str, harness_version: str, scorer: str = "auto_contains") -> DataFrame:
    """Run cells as run records: an id of their own, the time, latency and the nested parts.

    Ids and times are new whenever the plan runs, so write the records before they are used twice.
    """
    of = lambda name, default: F.col(name) if name in executed.columns else F.lit(default)
    telemetry = F.struct(
        *[F.col(c).cast("bigint").alias(f"{c}_norm") for c in ("input_tokens", "output_tokens", "cache_tokens", "build_tokens")], of("native_input", 0).cast("bigint").alias("native_input"),
        of("native_output", 0).cast("bigint").alias("native_output"), of("latency_ms", 0).cast("bigint").alias("latency_ms"), of("trace_uri", "").alias("trace_uri"),
    )
    return executed.select(
        F.uuid().alias("run_id"), "task_id", F.lit(dataset_version).alias("dataset_version"), F.lit(harness_version).alias("harness_version"),
        F.struct(F.col("provider").alias("name"), of("provider_version", "0.1.0").alias("version"), F.parse_json(F.lit("{}")).alias("config")).alias("provider"),
        "model", F.col("repeat").cast("bigint").alias("repeat"), F.col("seed").cast("bigint").alias("seed"), telemetry.alias("telemetry"),
        F.struct((F.col("correct") == 1).alias("correct"), F.col("correct").cast("double").alias("raw"), F.lit(scorer).alias("scorer")).alias("score"), F.current_timestamp().alias("timestamp"),
    )


def methods(runs: DataFrame, column: str) -> DataFrame:
    """The distinct providers or models, in order."""
    return runs.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def missing_examples(grid: DataFrame, done: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """The first cells that a sweep lacks."""
    return pending(grid, done, keys).select(*keys).orderBy(*keys).limit(n)


def one_cell(runs: DataFrame, task_id: str) -> DataFrame:
    """The rows of one task; an error names what there is if it is unknown."""
    found = runs.where(F.col("task_id") == task_id)
    if found.isEmpty():
        known = [r["task_id"] for r in runs.select("task_id").distinct().orderBy("task_id").limit(5).collect()]
        raise KeyError(f"no task {task_id}; among the known are {known}")
    return found


def projected_cost(cells: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of planned cells (provider, model, pass, cells, in_tokens, out_tokens) at prices per million tokens."""
    cost = F.col("cells") * (F.col("in_tokens") / 1e6 * F.col("price_in") + F.col("out_tokens") / 1e6 * F.col("price_out"))
    return cells.join(prices, "model").groupBy("provider", "model", "pass").agg(F.sum("cells").alias("cells"), F.sum(cost).alias("cost"))
