"""The tables that the registered queries read, and station-like columns derived from their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(key: str) -> Column:
    return 50 + (F.col(key) * 37 % 900) / F.lit(100.0)


def lon(key: str) -> Column:
    return -6 + (F.col(key) * 53 % 800) / F.lit(100.0)


def cycled(key: str, values: list[str | None]) -> Column:
    """values[key % len(values)]."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def sql_cycled(key: str, values: list[str | None]) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "'||chr(10)||'") + "'" for v in values)
    return f"(list_value({listed}))[({key} % {len(values)}) + 1]"


def rounded(c: Column, places: int) -> Column:
    """c rounded as the SQL does: the product by a power of ten to its nearest whole number, not the decimal digits of c."""
    return F.round(c * 10.0**places) / 10.0**places


SQL_LAT = "(50 + ({0} * 37 % 900) / 100.0::DOUBLE)"
SQL_LON = "(-6 + ({0} * 53 % 800) / 100.0::DOUBLE)"
SQL_KM = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2), 1.0)))"
