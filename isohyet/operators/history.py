"""Station histories: from capability files, data years and annual headers to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions.coerce import decimal_places
from isohyet.functions.geo import coordinate_precision_m
from isohyet.operators import timeline

#: Domains of automatic recording; metres from which a location is coarse.
AUTOMATIC_DOMAINS = ("AWSHRLY",)
COARSE_M = 100.0


def automatic_from(rows: Column) -> Column:
    """The first year of a row of an automatic domain; null if none."""
    automatic = F.filter(rows, lambda r: r["met_domain_name"].isin(*AUTOMATIC_DOMAINS))
    return F.array_min(F.transform(automatic, lambda r: r["first_year"]))


def moved(capabilities: DataFrame, headers: DataFrame) -> DataFrame:
    """(src_id, coordinate_moved_within_id): whether an annual header names other coordinates or another height, or none."""
    own = capabilities.select("src_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "height_m")
    h = headers.select(F.col("src_id").alias("h_id"), *[F.col(c).alias(f"h_{c}") for c in ("lat", "lon", "height_m")])
    same = F.lit(True)
    for c in ("lat", "lon", "height_m"):
        same = same & F.col(c).eqNullSafe(F.col(f"h_{c}"))
    differs = F.col("h_id").isNotNull() & ~same
    return own.join(h, F.col("src_id") == F.col("h_id"), "left").groupBy("src_id").agg(F.bool_or(differs).alias("coordinate_moved_within_id"))


def spans(capabilities: DataFrame, years: DataFrame) -> DataFrame:
    """(src_id, first_year, last_year): of the data, else of the capability file's dates."""
    seen = years.groupBy(F.col("src_id").alias("y_id")).agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    dated = lambda c: F.substring(c, 1, 4).try_cast("int")
    return capabilities.join(seen, F.col("src_id") == F.col("y_id"), "left").select("src_id", F.coalesce("lo", dated("valid_from")).alias("first_year"), F.coalesce("hi", dated("valid_to")).alias("last_year"))


def station_history(capabilities: DataFrame, years: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """A row for every segment of a station: capabilities as parsed, years (src_id, year), headers (src_id, lat, lon, height_m).

    Stations without data years have no segment; spans() still knows them.
    """
    caps = capabilities.withColumn("aws_from_year", automatic_from(F.col("rows")))
    dated = years.join(caps.select("src_id", "aws_from_year"), "src_id")
    segs = timeline.segments(dated, "src_id", "year", "aws_from_year").withColumnRenamed("station", "src_id")
    places = [decimal_places(F.col(c)) for c in ("lat", "lon")]
    lat = F.col("lat").cast("double")
    out = segs.join(caps.drop("rows", "path"), "src_id").withColumn("precision", coordinate_precision_m(lat, *places))
    if headers is not None:
        out = out.join(moved(capabilities, headers), "src_id")
    else:
        out = out.withColumn("coordinate_moved_within_id", F.lit(False))
    return out.select(
        "src_id", "name", "county", "segment", "start_year", "end_year", "break_reason", "era", lat.alias("lat"), F.col("lon").cast("double").alias("lon"), "height_m",
        places[0].alias("lat_dp"), places[1].alias("lon_dp"), F.round("precision", 1).alias("coordinate_precision_m"), (F.col("precision") > COARSE_M).alias("coarse_location_flag"),
        "aws_from_year", F.col("aws_from_year").isNull().alias("instrument_history_unknown"), "coordinate_moved_within_id",
        F.col("first_year").alias("station_first_year"), F.col("last_year").alias("station_last_year"), "n_segments", F.col("version").alias("collection_version"),
    )
