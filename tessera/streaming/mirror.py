"""Optional extra: keep the mirror up to date from a stream of run records."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.sources import schemas, sinks


def follow(spark: SparkSession, records_path: str, mirror_path: str, checkpoint: str) -> StreamingQuery:
    """Ingest new files of a store as they come; a batch that is run again adds nothing, as ingest is idempotent by run_id."""
    stream = spark.readStream.schema(schemas.RUN_RECORD).json(records_path)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: sinks.ingest(mirror_path, batch)).start()
