"""Incremental ingestion: new documents in, their units out, with the same operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.units import units


def stream_units(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> DataFrame:
    """Reads the documents that have arrived in ``folder`` as a stream and appends their units to ``out``.

    Documents are split one by one, so the stream keeps no state; offsets are kept in ``checkpoint``, so that a restart
    repeats nothing."""
    docs = spark.readStream.schema(schema).parquet(folder)
    query = units(docs.select("doc_id", "text")).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are left out of a stream's result."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")
