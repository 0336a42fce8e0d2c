"""Sinks: county Parquet under a layout, run record, provenance sidecar, checksum manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_A_FILE = 1_000_000


def observation_path(out: str, dataset: str) -> str:
    return f"{out}/obs/{dataset}"


def derived_path(out: str, table: str) -> str:
    return f"{out}/derived/{table}"


def write_counties(rows: DataFrame, out: str, dataset: str) -> str:
    """zstd Parquet by county; a county without rows leaves nothing. One shuffle lays rows out by county and station."""
    path = observation_path(out, dataset)
    laid = rows.repartition("county", "station_file_name").sortWithinPartitions("county", "station_file_name")
    laid.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("county").parquet(path)
    return path


def write_details(details: DataFrame, path: str) -> None:
    """The findings of a run as JSON lines, a folder for every county."""
    details.repartition("county", "file").write.mode("overwrite").partitionBy("county").json(path)


def write_record(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").text(path)


def write_provenance(rows: DataFrame, path: str, releases: list[str], units: dict[str, str], widened: dict) -> None:
    """The metadata that a file's key-value pairs can't carry, beside it."""
    spark = rows.sparkSession
    text = json.dumps({"releases": ";".join(releases), "units": units, "generator": "isohyet"} | ({"widenings": sorted(widened)} if widened else {}), sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def manifest(files: DataFrame) -> DataFrame:
    """(digest, name) of a binaryFile scan, by name."""
    return files.select(F.sha2("content", 256).alias("digest"), F.element_at(F.split("path", "/"), -1).alias("name")).orderBy("name")


def verify(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, status) for files and manifest entries that don't agree: missing, unlisted or changed."""
    here = manifest(files).select(F.col("name").alias("h_name"), F.col("digest").alias("h_digest"))
    both = expected.join(here, F.col("name") == F.col("h_name"), "full_outer")
    status = F.when(F.col("h_name").isNull(), "missing").when(F.col("name").isNull(), "unlisted").when(F.col("digest") != F.col("h_digest"), "changed")
    return both.select(F.coalesce("name", "h_name").alias("name"), status.alias("status")).where("status is not null")
