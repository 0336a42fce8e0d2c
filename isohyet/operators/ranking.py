"""Ranks over whole tables that no single task sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.operators.entity import cut_off


#: Rows that one task may sort.
ONE_TASK_ROWS = 200_000


def ranked(rows: DataFrame, order: list, by: str | None = None, name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in order, within each value of by if given.

    A range exchange deals rows to tasks; each numbers its own, and what earlier tasks hold is added. Where ranges fall is of no
    account to the result. Tables counted to have ONE_TASK_ROWS at most are sorted as they are. order must tell all rows apart.
    """
    if rows.select(F.lit(1)).limit(ONE_TASK_ROWS + 1).count() <= ONE_TASK_ROWS:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*[by] if by else []).orderBy(*order)).cast("long"))
    laid = rows.repartitionByRange(*([by] if by else []), *order).withColumn("__part", F.spark_partition_id())
    laid, _ = cut_off(laid)
    group = [by] if by else []
    counts = laid.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__held"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__held").over(before), F.lit(0))).select(F.col("__part").alias("__p"), *[F.col(c).alias("__by") for c in group], "__before")
    on = (F.col("__part") == F.col("__p")) & (F.col(by).eqNullSafe(F.col("__by")) if by else F.lit(True))
    local = F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order))
    placed = laid.withColumn("__local", local).join(offsets, on)
    return placed.withColumn(name, F.col("__before") + F.col("__local")).drop("__part", "__p", "__by", "__before", "__local")
