"""Incremental ingest: only files that an earlier run hasn't seen, by Structured Streaming over the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Appends what is new under source to out and returns when there is nothing more; the checkpoint remembers what was seen."""
    stream = spark.readStream.format(fmt).schema(schema).load(source)
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def one_report_a_key(reports: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """An extension for streams: the first report of each key within a watermark."""
    return reports.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
