"""Joins in time that Spark has no operator for: as of a moment, within a span, matched from either side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.session import shared_dir


#: Rows of one key, of both sides, that one task sorts; beyond them keys are dealt by ranges of time.
ONE_TASK_ROWS = 2_000_000
#: Tables of what a range starts with of up to this many rows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 50_000


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, values: list[str]) -> DataFrame:
    """left with values of the last row of right, of the same by, at or before its time; null if none.

    Both sides go through one exchange and one sort by time; right rows come first at equal times, and of several the last by values. Where
    a key has more rows than one task should sort, rows are dealt by key and time, and each range starts with the last row of those before it.
    """
    row = F.struct(*left.columns)
    l = left.select(F.col(by).alias("__by"), F.col(time).alias("__time"), F.lit(1).alias("__side"), row.alias("__row"), F.lit(None).alias("__values"))
    r = right.select(F.col(by).alias("__by"), F.col(time).alias("__time"), F.lit(0).alias("__side"), F.lit(None).alias("__row"), F.struct(*values).alias("__values"))
    both = l.unionByName(r)
    most = both.groupBy("__by").count().agg(F.max("count")).first()[0] or 0
    last = F.last("__values", ignorenulls=True)
    in_time = lambda *keys: Window.partitionBy(*keys).orderBy("__time", "__side", "__values").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if most <= ONE_TASK_ROWS:
        seen = both.withColumn("__last", last.over(in_time("__by")))
    else:
        shared_dir(left.sparkSession)
        laid = both.repartitionByRange("__by", "__time", "__side").withColumn("__part", F.spark_partition_id()).checkpoint()
        ends = laid.groupBy("__by", "__part").agg(F.max_by("__values", F.when(F.col("__side") == 0, F.struct("__time", "__values"))).alias("__end"))
        before = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = ends.withColumn("__start", F.last("__end", ignorenulls=True).over(before)).where("__start IS NOT NULL").select(F.col("__by").alias("__k"), F.col("__part").alias("__p"), "__start").checkpoint()
        starts = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
        inside = laid.withColumn("__inside", last.over(in_time("__part", "__by")))
        seen = inside.join(starts, F.col("__by").eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")), "left").withColumn("__last", F.coalesce("__inside", "__start"))
    return seen.where("__side = 1").select("__row.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def within_spans(points: DataFrame, spans: DataFrame, by: str, time: str, start: str, end: str, width: int) -> DataFrame:
    """points beside the spans of the same by with start <= time < end (numbers), through an equi-join on slots of a width.

    A span is repeated for every slot that it touches, so the width should be near a usual span. Spans without both ends, and points
    without a time, meet nothing; an infinite end is an error, as it touches slots without end.
    """
    ends = F.when((F.abs(F.col(start)) < float("inf")) & (F.abs(F.col(end)) < float("inf")), F.floor(F.col(end) / width)).otherwise(F.raise_error(F.lit("a span has no end")))
    p = points.withColumn("__slot", F.floor(F.col(time) / width))
    s = spans.where((F.col(start) < F.col(end)) & ~F.isnan(F.col(end).cast("double"))).withColumn("__slot", F.explode(F.sequence(F.floor(F.col(start) / width), ends)))
    return p.join(s, [by, "__slot"]).where((F.col(start) <= F.col(time)) & (F.col(time) < F.col(end))).drop("__slot")
