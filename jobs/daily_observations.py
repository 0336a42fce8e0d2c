"""Job 1, incremental: reports as they arrive become daily figures of every station.

    python -m jobs.daily_observations --source FOLDER --out FOLDER --checkpoint FOLDER [--config jobs/daily_observations.json]

Structured Streaming takes the files that no earlier run has taken (availableNow; the checkpoint is the mark) and ends. Each batch

* lays its reports down under out/observations, by day and batch, and those without a station or a time under out/rejected, by reason and batch;
* makes the days anew that it touches, from all reports of those days, under out/daily: late files mend days of earlier runs;
* leaves its numbers under out/runs, by batch.

All writes replace partitions (dynamic overwrite) and depend on the batch alone: a batch that failed half-way is taken again under its number and
leaves what it would have left at once. A run without new files changes nothing. Only days that a batch touches are read again, by partition.

A row of out/daily holds, for a day, station and kind: reports (each id once), hours with one, lowest, highest and mean value, where an hour's value is its
first report's, and the band of hours. FOLDER of the source may be a pattern of paths. Missing and NaN values count as reports without value. Config: the source's format and schema (columns that aren't named aren't
read), SQL expressions for report_id, station, kind, at and value, and the number of files a batch takes.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.operators.audit import DAY_BINS, banded

log = logging.getLogger("daily_observations")

REPORT = "report_id string, station string, kind string, at timestamp, value double, hour int"
OBSERVATIONS = f"{REPORT}, day string, batch long"
REJECTED = f"{REPORT}, reason string, batch long"
DAILY = "station string, kind string, n_reports long, n_hours long, low double, high double, mean double, band string, day string"


def reports(batch: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The reports of a batch under the job's names, with their hour, day, and the reason to reject them, if any."""
    named = batch.select(*[F.expr(columns[c]).cast(t).alias(c) for c, t in (x.split() for x in REPORT.split(", ")) if c != "hour"])
    reason = F.when(F.col("station").isNull(), "missing-station").when(F.col("at").isNull(), "missing-time")
    return named.withColumns({"value": F.nanvl("value", F.lit(None).cast("double")), "hour": F.hour("at"), "day": F.date_format("at", "yyyy-MM-dd"), "reason": reason})


def daily_figures(observations: DataFrame) -> DataFrame:
    """A row for every day, station and kind: one exchange deals them out, and all counts and figures keep to it."""
    dealt = observations.repartition("day", "station", "kind")
    hours = dealt.groupBy("day", "station", "kind", "hour").agg(
        F.count_distinct("report_id").alias("n"), F.min(F.struct("at", "report_id", "value")).alias("first")
    )
    figures = hours.groupBy("day", "station", "kind").agg(
        F.sum("n").alias("n_reports"), F.count(F.lit(1)).alias("n_hours"), F.min("first.value").alias("low"), F.max("first.value").alias("high"), F.avg("first.value").alias("mean")
    )
    return figures.withColumn("band", banded(F.col("n_hours"), DAY_BINS, "20-24"))


def put(rows: DataFrame, path: str, *by: str, fmt: str = "parquet") -> None:
    """Replaces the partitions that rows fall into; partitions of any size are evened out over tasks."""
    even = rows.hint("rebalance", *[F.col(c) for c in by])
    even.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).save(path)


def take(batch: DataFrame, number: int, out: str, columns: dict[str, str]) -> dict[str, int]:
    """Takes in one batch and returns its numbers."""
    spark = batch.sparkSession
    found = reports(batch, columns).withColumn("batch", F.lit(number).cast("long"))
    put(found.where("reason IS NULL").drop("reason"), f"{out}/observations", "day", "batch")
    put(found.where("reason IS NOT NULL").drop("day"), f"{out}/rejected", "reason", "batch")
    observations = spark.read.schema(OBSERVATIONS).parquet(f"{out}/observations")
    mine = observations.where(F.col("batch") == number)
    days = mine.select("day").distinct()
    put(daily_figures(observations.join(days, "day", "left_semi")), f"{out}/daily", "day")
    rejected = spark.read.schema(REJECTED).parquet(f"{out}/rejected").where(F.col("batch") == number)
    numbers = {"batch": number, "n_accepted": mine.count(), "n_rejected": rejected.count(), "n_days": days.count()}
    put(spark.createDataFrame([tuple(numbers.values())], "batch long, n_accepted long, n_rejected long, n_days long"), f"{out}/runs", "batch", fmt="json")
    log.info("batch %(batch)d: %(n_accepted)d reports read and written, %(n_rejected)d rejected, %(n_days)d days made anew", numbers)
    return numbers


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict) -> list[dict[str, int]]:
    """Takes in what is new under source and returns the numbers of each batch; nothing new, no batch."""
    done: list[dict[str, int]] = []
    log.info("reading new files of %s", source)
    stream = spark.readStream.format(config["format"]).schema(config["schema"]).option("maxFilesPerTrigger", config["max_files_per_trigger"]).load(source)
    writer = stream.writeStream.foreachBatch(lambda batch, number: done.append(take(batch, number, out, config["columns"])))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("%d batches, %d reports, written to %s", len(done), sum(n["n_accepted"] + n["n_rejected"] for n in done), out)
    return done


def main() -> None:
    parser = argparse.ArgumentParser(description="Daily figures of observations from files as they arrive.")
    for name in ("source", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=f"{__file__.removesuffix('.py')}.json")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config) as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("daily_observations").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.source, args.out, args.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
