"""Scene composites: exact medians per pixel over the clearest scenes on one grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_scenes(scenes: DataFrame, by: str, order: list, n: int = 8, grid: str | None = None) -> DataFrame:
    """The first n scenes of each group in order, of those on the same grid as the very first."""
    w = Window.partitionBy(by).orderBy(*order)
    if grid:
        scenes = scenes.withColumn("__grid", F.first(grid).over(w)).where(F.col(grid) == F.col("__grid")).drop("__grid")
    return scenes.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def median_composite(pixels: DataFrame, by: list[str], values: list[str], clear: str) -> DataFrame:
    """(by, n_clear, <value>_median): exact medians over clear observations, null where none is clear."""
    return pixels.groupBy(*by).agg(
        F.count_if(clear).alias("n_clear"), *[F.percentile(F.when(F.col(clear), F.col(v)), 0.5).alias(f"{v}_median") for v in values]
    )
