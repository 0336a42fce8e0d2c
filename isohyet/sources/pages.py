"""A streaming Spark data source of pages that follow each other, resumed where the last run ended.

    spark.dataSource.register(Pages)
    spark.readStream.format("pages").option("pages_a_batch", 10).load(folder)

A page is the folder <folder>/page=<n>, n from 1, of files of JSON lines, on any file system that pyarrow knows. A line {"next": ...} says that another
page follows; a page without one, or without any line, is the last there is so far. What the stream has taken is in its checkpoint: a run that was stopped
after page n goes on with page n + 1, and a last page that has grown a {"next": ...} meanwhile is not read again. The driver follows the pages as far as they
go and keeps nothing of them; a batch is all that were found, read by tasks of pages_a_batch pages each. PageReader is the plain way, a batch
of pages_a_batch pages through the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from isohyet.session import ship_package

SCHEMA = "page bigint, nth int, value string"
PAGES_A_BATCH = 20
#: Pages that the driver looks at side by side.
AHEAD = 32


class PageReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], int(options.get("pages_a_batch", PAGES_A_BATCH))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))

    def _texts(self, n: int) -> Iterator[bytes]:
        """The files of a page, none if it isn't there yet."""
        store, root = self._open()
        files = store.get_file_info(fs.FileSelector(f"{root}/page={n}", allow_not_found=True))
        for name in sorted(f.path for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))):
            with store.open_input_stream(name) as f:
                yield f.read()

    def page(self, n: int) -> list[str] | None:
        """The lines of a page, None if it isn't there yet."""
        texts = list(self._texts(n))
        return [x for t in texts for x in t.decode().split("\n") if x.strip()] if texts else None

    def told(self, n: int) -> tuple[bool, bool]:
        """Whether a page has any line, and whether one says that another page follows; only lines that may say so are parsed."""
        filled = more = False
        for text in self._texts(n):
            filled = filled or bool(text.strip())
            if not more and any(mark in text for mark in MARKS):
                more = any(follows(x.decode()) for x in text.split(b"\n") if any(mark in x for mark in MARKS))
        return filled, more

    def initialOffset(self) -> dict:
        return {"page": 0}

    def _rows(self, n: int, lines: list[str]) -> Iterator[tuple[int, int, str]]:
        return ((n, i, x) for i, x in enumerate(x for x in lines if not follows(x)))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at, rows = start["page"], []
        # the page before said whether another follows; the first is there or isn't
        more = at == 0 or any(map(follows, self.page(at) or []))
        while more and at - start["page"] < self.most:
            lines = self.page(at + 1)
            if not lines:
                break
            at += 1
            rows += self._rows(at, lines)
            more = any(map(follows, lines))
        return iter(rows), {"page": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for n in range(start["page"] + 1, end["page"] + 1):
            yield from self._rows(n, self.page(n) or [])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class PageRange(InputPartition):
    first: int
    last: int


class PageStream(DataSourceStreamReader):
    """As many pages as follow each other, read by tasks."""

    def __init__(self, options: dict[str, str]):
        self.pages, self.at = PageReader(options), 0

    def initialOffset(self) -> dict:
        return self.pages.initialOffset()

    def latestOffset(self) -> dict:
        """The last page that can be reached from the last one taken."""
        at = self.at
        # the page before said whether another follows; the first is there or isn't
        more = at == 0 or self.pages.told(at)[1]
        with ThreadPoolExecutor(AHEAD) as pool:
            while more:
                for filled, follows_ in pool.map(self.pages.told, range(at + 1, at + 1 + AHEAD)):
                    more = more and filled
                    if not more:
                        break
                    at, more = at + 1, follows_
        return {"page": at}

    def partitions(self, start: dict, end: dict) -> Sequence[PageRange]:
        # a run that goes on is told where by an empty range
        self.at = end["page"]
        return [PageRange(n, min(n + self.pages.most - 1, end["page"])) for n in range(start["page"] + 1, end["page"] + 1, self.pages.most)]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        for n in range(partition.first, partition.last + 1):
            rows = list(self.pages._rows(n, self.pages.page(n) or []))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["page", "nth", "value"])


#: What a line that says that another page follows must hold: the word, or an escape that may stand for a letter of it.
MARKS = (b"next", b"\\u")


def follows(line: str) -> bool:
    """Whether the line says that another page follows."""
    value = json.loads(line)
    return isinstance(value, dict) and set(value) == {"next"} and value["next"] is not None


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


def fetch_new(spark: SparkSession, folder: str, out: str, checkpoint: str, pages_a_batch: int = PAGES_A_BATCH) -> None:
    """Appends the elements of pages that no earlier run has taken to out, (page, nth, value) as Parquet, and returns when no page follows.

    A run of the stream takes the pages that are there when it begins: runs follow until one finds nothing.
    """
    ship_package(spark)
    spark.dataSource.register(Pages)
    stream = spark.readStream.format("pages").option("pages_a_batch", pages_a_batch).load(folder)
    taken = True
    while taken:
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
        taken = any(p.numInputRows for p in query.recentProgress)


def fetched(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(out)
