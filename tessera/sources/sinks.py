"""Append-only sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.store import flatten, new_rows
from tessera.operators.usage import with_total
from tessera.sources.readers import path_exists


def append_records(records: DataFrame, path: str) -> None:
    """Run records, judge logs, candidates or labels as JSON lines."""
    records.write.mode("append").json(path)


def ingest(mirror_path: str, records: DataFrame) -> int:
    """Append to the mirror the records that it lacks, flattened; returns how many those are."""
    from tessera.plans.materialize import materialized

    spark, flat = records.sparkSession, flatten(records)
    mirror = spark.read.schema(flat.schema).parquet(mirror_path) if path_exists(spark, mirror_path) else flat.limit(0)
    fresh = materialized(new_rows(mirror, flat), "ingest")
    fresh.write.mode("append").parquet(mirror_path)
    return fresh.count()


def export(mirror: DataFrame, path: str) -> bool:
    """The mirror as Parquet; an empty one writes nothing."""
    if mirror.isEmpty():
        return False
    mirror.write.mode("overwrite").parquet(path)
    return True


def append_usage(log: DataFrame, folder: str) -> None:
    """Usage lines by UTC date, with their totals."""
    with_total(log).withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").json(folder)


def write_manifests(assigned: DataFrame, folder: str, strata: list[str]) -> dict[str, int]:
    """A tab-separated file of task and strata for each split; returns the counts."""
    rows = assigned.select("split", "task_id", F.array_join(F.array(*[F.col(s).cast("string") for s in strata]), ",").alias("strata"))
    rows.write.mode("overwrite").partitionBy("split").option("sep", "\t").csv(folder)
    return {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}


def write_sample(sample: DataFrame, path: str, header: tuple[str, ...] = ()) -> None:
    """JSON lines after comment lines: a sample is small, so it is one file."""
    spark = sample.sparkSession
    lines = spark.createDataFrame([(k, f"# {x}") for k, x in enumerate(header)], "place bigint, value string")
    body = sample.select(F.lit(len(header)).cast("bigint").alias("place"), F.to_json(F.struct("*")).alias("value"))
    lines.unionByName(body).coalesce(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)


def report_json(summary: DataFrame, path: str) -> None:
    """One row as a JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)
