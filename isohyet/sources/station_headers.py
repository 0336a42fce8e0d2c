"""Spark data sources of the headers of files: of self-describing files up to their column row, of others so many lines; what follows isn't read.

    spark.dataSource.register(StationHeaders)
    spark.read.format("station_headers").option("qc_version", 1).load(raw)

Files are <raw>/<county>/<id_name>/qc-version-<n>/*.csv, on any file system that pyarrow knows. A partition is a bundle of files. Options county and years
(separated by commas) keep other folders and names from being listed or opened. So do filters on county, station and year (equality and IN), with the option
plan_filters where spark.sql.python.filterPushdown.enabled is on (Spark refuses a reader that takes filters where it is off). headers() sees to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from isohyet.session import ship_package

SCHEMA = "path string, county string, station string, year string, src_id bigint, header array<string>, columns array<string>, error string, bytes_read bigint"
#: Bytes that one read takes: a header of 300 lines has some 12 KB.
CHUNK = 16 << 10
#: Files of a partition.
BUNDLE = 200
PLANNED = ("county", "station", "year")


class Bundle(InputPartition):
    def __init__(self, files: list[tuple[str, str, str, str]]):
        self.files = files


def _mark(text: str) -> int:
    """Where the column row ends, -1 if the text may not hold it yet."""
    found = re.search(r"^ *data *\n", text, re.M)
    return text.find("\n", found.end()) if found else -1


def read_header(stream) -> tuple[str, int]:
    """(text up to the end of the column row, bytes read); all of a file without one."""
    raw = b""
    while chunk := stream.read(CHUNK):
        raw += chunk
        # a chunk may end within a character: what follows the last line end waits
        text = raw[: raw.rfind(b"\n") + 1].decode().replace("\r", "")
        end = _mark(text)
        if end >= 0:
            return text[:end], len(raw)
    return raw.decode(errors="replace").replace("\r", ""), len(raw)


def judged(text: str, src_id: int | None) -> tuple[list[str] | None, list[str] | None, str | None]:
    """(header lines, columns, error) of what was read, by the rules of selfdesc.split_files()."""
    lines = [x.strip(" ") for x in text.split("\n")]
    at = lines.index("data") if "data" in lines else None
    header = None if at is None else [x for x in lines[:at] if x]
    columns = None if at is None or at + 1 >= len(lines) else [x.strip(" ") for x in lines[at + 1].split(",")]
    if src_id is None:
        return header, columns, "no station number in the folder's name"
    if header is None:
        return None, None, "no 'data' line"
    if columns is None or columns[0] == "":
        return header, columns, "no column row"
    return header, columns, "header line of fewer than three parts" if any(x.count(",") < 2 for x in header) else None


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.raw, self.qc = options["path"], options.get("qc_version", "1")
        self.wanted: dict[str, set[str]] = {}
        for option, column in (("county", "county"), ("years", "year")):
            if options.get(option):
                self._want(column, set(options[option].split(",")))

    def _want(self, column: str, values: set[str]) -> None:
        self.wanted[column] = self.wanted.get(column, values) & values

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.raw) if "://" in self.raw else (fs.LocalFileSystem(), self.raw)

    def _names(self, store: fs.FileSystem, folder: str, kind: fs.FileType) -> list[str]:
        return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == kind)

    def partitions(self) -> Sequence[InputPartition]:
        store, root = self._open()
        keep = lambda column, names: [n for n in names if column not in self.wanted or n in self.wanted[column]]
        files = []
        for county in keep("county", self._names(store, root, fs.FileType.Directory)):
            for station in keep("station", self._names(store, f"{root}/{county}", fs.FileType.Directory)):
                folder = f"{root}/{county}/{station}/qc-version-{self.qc}"
                named = [(n, year_of(n)) for n in self._names(store, folder, fs.FileType.File) if n.endswith(".csv")]
                files += [(f"{folder}/{n}", county, station, y) for n, y in named if "year" not in self.wanted or y in self.wanted["year"]]
        return [Bundle(files[i : i + BUNDLE]) for i in range(0, len(files), BUNDLE)] or [Bundle([])]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        store, _ = self._open()
        rows = []
        for path, county, station, year in partition.files:
            number = re.match("[0-9]+", station)
            src_id = int(number[0]) if number else None
            with store.open_input_stream(path, buffer_size=None) as stream:
                text, size = read_header(stream)
            header, columns, error = judged(text, src_id)
            rows.append({"path": path, "county": county, "station": station, "year": year, "src_id": src_id, "header": header, "columns": columns, "error": error, "bytes_read": size})
        kinds = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, kinds[t]) for n, t in (x.split() for x in SCHEMA.split(", "))]))


class PlanningReader(HeaderReader):
    """Plans with the query's filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in PLANNED and isinstance(f.value, str):
                self._want(f.attribute[0], {f.value})
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in PLANNED and all(isinstance(v, str) for v in f.value):
                self._want(f.attribute[0], set(f.value))
            else:
                yield f


def year_of(name: str) -> str:
    found = re.search(r"_([0-9]{4})\.csv$", name)
    return found[1] if found else ""


class StationHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "station_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeaderReader:
        return (PlanningReader if self.options.get("plan_filters") == "true" else HeaderReader)(self.options)


def headers(spark: SparkSession, raw: str, county: str | None = None, qc_version: int = 1, years: list[int] | None = None) -> DataFrame:
    """(path, county, station, year, src_id, header, columns, error, bytes_read) of the files under raw, for selfdesc.dataset_schema() and headers()."""
    ship_package(spark)
    spark.dataSource.register(StationHeaders)
    planned = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    read = spark.read.format("station_headers").option("qc_version", qc_version).option("plan_filters", planned)
    if county is not None:
        read = read.option("county", county)
    if years is not None:
        read = read.option("years", ",".join(map(str, years)))
    return read.load(raw)


class FirstLinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.lines, self.suffix = options["path"], int(options.get("lines", 40)), options.get("suffix", "")

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))

    def partitions(self) -> Sequence[InputPartition]:
        store, root = self._open()
        one = store.get_file_info(root)
        found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith(self.suffix) and not x.base_name.startswith(("_", ".")))
        return [Bundle([(f, "", "", "") for f in files[i : i + BUNDLE]]) for i in range(0, len(files), BUNDLE)] or [Bundle([])]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        store, _ = self._open()
        rows = []
        for path, *_ in partition.files:
            with store.open_input_stream(path, buffer_size=None) as stream:
                raw = b""
                while raw.count(b"\n") < self.lines and (chunk := stream.read(CHUNK)):
                    raw += chunk
            kept = b"\n".join(raw.split(b"\n", self.lines)[: self.lines])
            rows.append({"path": path, "value": kept.decode(errors="replace"), "bytes_read": len(raw)})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("value", pa.string()), ("bytes_read", pa.int64())]))


class FirstLines(DataSource):
    """The first lines of every file under a folder: reads no further."""

    @classmethod
    def name(cls) -> str:
        return "first_lines"

    def schema(self) -> str:
        return "path string, value string, bytes_read bigint"

    def reader(self, schema) -> FirstLinesReader:
        return FirstLinesReader(self.options)


def first_lines(spark: SparkSession, folder: str, lines: int, suffix: str = ".csv") -> DataFrame:
    """(path, value, bytes_read): the first lines of the files under a folder, or of one file."""
    ship_package(spark)
    spark.dataSource.register(FirstLines)
    return spark.read.format("first_lines").option("lines", lines).option("suffix", suffix).load(folder)
