"""Station timelines: gap- and era-aware segments, survivorship."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(years: DataFrame, station: str = "station", year: str = "year", aws: str | None = None) -> DataFrame:
    """(station, segment, start_year, end_year, break_reason, era, n_segments, first_year, last_year).

    A segment begins at a gap, or where automatic recording begins within a run. A gap names the reason where both fall
    on one year. Equal rows count once, rows without a year don't; aws: column with the year from which recording is automatic (null: unknown).
    """
    rows = years.where(F.col(year).isNotNull()).select(F.col(station).alias("station"), F.col(year).alias("year"), (F.col(aws) if aws else F.lit(None)).cast("bigint").alias("aws")).distinct()
    w = Window.partitionBy("station").orderBy("year")
    lagged = rows.withColumn("before", F.lag("year").over(w))
    reason = F.when(F.col("before").isNull(), "open").when(F.col("year") != F.col("before") + 1, "resumed-after-gap").when(F.col("year") == F.col("aws"), "aws-transition")
    marked = lagged.withColumn("reason", reason).withColumn("segment", (F.sum(F.when(F.col("reason").isNotNull(), 1).otherwise(0)).over(w) - 1).cast("int"))
    era = F.when(F.col("aws").isNull(), "unknown").when(F.col("start_year") >= F.col("aws"), "aws").otherwise("manual")
    station_w = Window.partitionBy("station")
    return (
        marked.groupBy("station", "segment")
        .agg(F.min("year").alias("start_year"), F.max("year").alias("end_year"), F.max("reason").alias("break_reason"), F.max("aws").alias("aws"))
        .withColumns({
            "era": era,
            "n_segments": F.count(F.lit(1)).over(station_w),
            "first_year": F.min("start_year").over(station_w),
            "last_year": F.max("end_year").over(station_w),
        })
        .drop("aws")
    )


def survivorship(spans: DataFrame, first: str, last: str, open_from: int, width: int = 10) -> DataFrame:
    """(opened_in, opened, still_open, closed) by the period in which a station opened."""
    period = (F.floor(F.col(first) / width) * width).cast("int").alias("opened_in")
    still = F.col(last) >= open_from
    return spans.groupBy(period).agg(F.count(F.lit(1)).alias("opened"), F.count_if(still).alias("still_open"), F.count_if(~still).alias("closed"))
