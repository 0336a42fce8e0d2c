"""A Spark data source that writes observations as one Parquet file a county, with the dataset's metadata in the files.

Tasks write under a temporary folder, each attempt under names of its own, and tell the driver what they wrote; the driver gives the files of the
tasks that succeeded their names, county by county, and removes the rest. A job that fails leaves nothing but what was there before. A county
of more than ROWS_A_FILE rows, or one that was dealt to several tasks, has numbered files. Files go through pyarrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from isohyet.session import ship_package
from isohyet.sources.selfdesc import DatasetSchema
from isohyet.sources.sinks import ROWS_A_FILE, observation_path

TEMPORARY = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    #: (county, temporary name, rows)
    files: list[tuple[str, str, int]]


class CountyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.metadata = {k.encode(): v.encode() for k, v in json.loads(options.get("metadata", "{}")).items()}
        self.rows_a_file = int(options.get("rows_a_file", ROWS_A_FILE))
        self.run = uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of a task, in order of county."""
        store, root = self._open()
        folder, files, writer = f"{root}/{TEMPORARY}/{self.run}", [], None
        store.create_dir(folder)

        def close() -> None:
            nonlocal writer
            if writer is not None:
                writer.close()
                files.append((county, name, held))
                writer = None

        county, name, held = None, "", 0
        for batch in iterator:
            schema = pa.schema([f.with_nullable(True) for f in sorted(batch.schema, key=lambda f: f.name)], self.metadata)
            counties = batch.column("county").to_pylist()
            start = 0
            while start < len(counties):
                end = start
                while end < len(counties) and counties[end] == counties[start] and end - start < self.rows_a_file:
                    end += 1
                if counties[start] != county or held + end - start > self.rows_a_file:
                    close()
                if writer is None:
                    county, name, held = counties[start], f"{uuid.uuid4().hex}.parquet", 0
                    writer = parquet.ParquetWriter(f"{folder}/{name}", schema, filesystem=store, compression="zstd", coerce_timestamps="ms", allow_truncated_timestamps=True)
                writer.write_batch(batch.slice(start, end - start).select(schema.names).cast(schema))
                held, start = held + end - start, end
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Publishes what the tasks wrote; an overwrite then removes files that the new run has not replaced."""
        store, root = self._open()
        by_county = defaultdict(list)
        for message in messages:
            for county, name, rows in message.files if message else []:
                by_county[county or "unknown"].append((-rows, name))
        before = {x.base_name for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.File}
        published = set()
        for county, files in sorted(by_county.items()):
            for nth, (_, name) in enumerate(sorted(files)):
                final = f"{county}.parquet" if len(files) == 1 else f"{county}-{nth + 1:04d}.parquet"
                if not self.overwrite and final in before:
                    final = final.replace(".parquet", f"-{self.run}.parquet")
                store.move(f"{root}/{TEMPORARY}/{self.run}/{name}", f"{root}/{final}")
                published.add(final)
        if self.overwrite:
            for gone in sorted(n for n in before - published if n.endswith(".parquet")):
                store.delete_file(f"{root}/{gone}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{TEMPORARY}/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{TEMPORARY}/{self.run}")
        left = store.get_file_info(fs.FileSelector(f"{root}/{TEMPORARY}", allow_not_found=True))
        if not left and store.get_file_info(f"{root}/{TEMPORARY}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{TEMPORARY}")


class CountyFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "county_files"

    def writer(self, schema, overwrite: bool) -> CountyWriter:
        return CountyWriter(self.options, overwrite)


def metadata(schema: DatasetSchema) -> dict[str, str]:
    """What the files tell of their dataset; widenings name a station of either type."""
    told = {"releases": ";".join(schema.releases), "units": json.dumps(schema.units, sort_keys=True), "generator": "isohyet"}
    return told | ({"widenings": json.dumps({c: list(s) for c, s in sorted(schema.widened.items())})} if schema.widened else {})


def write_county_files(rows: DataFrame, out: str, dataset: str, schema: DatasetSchema, rows_a_file: int = ROWS_A_FILE) -> str:
    """Writes rows (county among their columns) anew, a file for every county; rows are dealt by county, hot ones to several tasks."""
    spark, path = rows.sparkSession, observation_path(out, dataset)
    ship_package(spark)
    spark.dataSource.register(CountyFiles)
    laid = rows.hint("rebalance", F.col("county")).sortWithinPartitions("county", "station_file_name")
    write = laid.write.format("county_files").mode("overwrite").option("metadata", json.dumps(metadata(schema))).option("rows_a_file", rows_a_file)
    write.save(path)
    return path
