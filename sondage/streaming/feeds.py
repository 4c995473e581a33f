"""Feeds: job events and page runs as files that arrive, with state kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sondage.operators.state import upsert


def stream(spark: SparkSession, path: str, schema: StructType, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def deduplicated(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once; state is forgotten once the watermark passes it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def latest_state(events: DataFrame, by: str, at: str, tie: str, value: str) -> DataFrame:
    """Per key the number of events, the last time, and the value of the last event."""
    return events.groupBy(by).agg(F.count("*").alias("n_events"), F.max(at).alias("last_at"), F.max_by(value, F.struct(at, tie)).alias("last_value"))


def run_to_end(rows: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Takes all that has arrived, in as many batches as it comes, and returns the resulting table, which lies in ``folder`` beside
    the checkpoint: a batch that runs again replaces its own files, and no row passes through the driver."""
    spark, schema, done = rows.sparkSession, rows.schema, []

    def write(batch: DataFrame, epoch: int) -> None:
        path = f"{folder}/batch-{epoch:08d}"
        batch.write.mode("overwrite").parquet(path)
        done.append(path)

    query = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    kept = done[-1:] if mode == "complete" else done
    return spark.read.schema(schema).parquet(*kept) if kept else spark.createDataFrame([], schema)


def upsert_to(rows: DataFrame, path: str, keys: list[str], checkpoint: str) -> None:
    """Keyed upserts into a folder of versions: each batch writes a new version from the last one, so a batch that runs again
    writes the same version."""
    spark = rows.sparkSession
    schema = rows.schema

    def write(batch: DataFrame, epoch: int) -> None:
        old = spark.read.schema(schema).parquet(f"{path}/v{epoch - 1}") if epoch else spark.createDataFrame([], schema)
        upsert(old, batch.dropDuplicates(keys), keys).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
