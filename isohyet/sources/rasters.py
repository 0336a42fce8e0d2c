"""A Spark data source of the cells of tiled rasters: only the tiles that meet a window are read.

    spark.dataSource.register(RasterCells)
    spark.read.format("raster_cells").option("window", "west,south,east,north").option("grid", "x0,y0,cell").load(folder)

Files are TIFF (classic or big, tiles or strips, without compression or deflated, integers also with horizontal differences), plain or alone in a zip, on any
file system that pyarrow knows. Planning reads the files' tag directories and makes partitions of the tiles that meet the window; tasks read and decode them
with NumPy. Plain files are read by ranges, a zipped one as a whole. Cells are numbered on one grid for all files, (x0, y0) being its upper left corner: files of
a mosaic fit together by row and column, and one that doesn't lie on the grid is an error. Without a grid, each file's own is taken.

The option overview (from 1) takes the file's smaller image of that number instead: fewer bytes for coarser cells.

A row is a cell of one band: path, band from 1, row and col of the grid, x and y of its middle, value, null where the file says that it has none.
Cells of the window that no file holds have no row: complete_grid() or a join on (row, col) tells them.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from isohyet.session import ship_package

SCHEMA = "path string, band int, row bigint, col bigint, x double, y double, value double"
#: Tiles of a partition.
TILES = 32
#: Tags of a TIFF directory, sizes and codes of its field types.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strip_offsets", 277: "samples", 278: "strip_rows", 279: "strip_counts", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_counts", 339: "kind", 33550: "scale", 33922: "tie", 42113: "nodata"}
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
DEFLATE = (8, 32946)


@dataclass
class Raster:
    """What a file's directory says."""

    order: str
    width: int
    height: int
    samples: int
    planar: bool
    dtype: str
    compression: int
    predictor: int
    tile: tuple[int, int]
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    cell: tuple[float, float]
    corner: tuple[float, float]
    nodata: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.tile[1])

    def tiles_within(self, window: tuple[float, float, float, float] | None) -> list[tuple[int, int]]:
        """(row, column) of the tiles that meet the window."""
        down = -(-self.height // self.tile[0])
        if window is None:
            return [(i, j) for i in range(down) for j in range(self.across)]
        west, south, east, north = window
        x0, y0 = self.corner
        wide, high = self.tile[1] * self.cell[0], self.tile[0] * self.cell[1]
        columns = range(max(0, int((west - x0) // wide)), min(self.across - 1, int(np.ceil((east - x0) / wide)) - 1) + 1)
        rows = range(max(0, int((y0 - north) // high)), min(down - 1, int(np.ceil((y0 - south) / high)) - 1) + 1)
        return [(i, j) for i in rows for j in columns]


def _fields(read, order: str, big: bool, at: int) -> tuple[dict[str, tuple], int]:
    """The tags of the directory at a place, and the place of the next one (0: none)."""
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", read(at, 8 if big else 2))[0]
    size, start, inline = (20, at + 8, 8) if big else (12, at + 2, 4)
    raw, found = read(start, n * size + inline), {}
    for i in range(n):
        entry = raw[i * size : (i + 1) * size]
        tag, kind = struct.unpack(f"{order}HH", entry[:4])
        if tag not in TAGS or kind not in TYPES:
            continue
        count = struct.unpack(f"{order}{'Q' if big else 'I'}", entry[4 : size - inline])[0]
        form = f"{order}{count}{TYPES[kind]}"
        value = entry[size - inline :]
        if struct.calcsize(form) > inline:
            value = read(struct.unpack(f"{order}{'Q' if big else 'I'}", value)[0], struct.calcsize(form))
        found[TAGS[tag]] = struct.unpack(form, value[: struct.calcsize(form)])
    return found, struct.unpack(f"{order}{'Q' if big else 'I'}", raw[n * size :])[0]


def directory(read, overview: int = 0) -> Raster:
    """What a file's first directory says, or that of its nth overview; read(offset, size) gives the file's bytes.

    An overview lies where the first image lies, in fewer and larger cells.
    """
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    first, at = _fields(read, order, big, at)
    found = first
    for nth in range(overview):
        if not at:
            raise ValueError(f"there are {nth} overviews only")
        found, at = _fields(read, order, big, at)
    one = lambda name, default=None: found[name][0] if name in found else default
    kind = {1: "u", 2: "i", 3: "f"}[one("kind", 1)]
    tiled = "tile_offsets" in found
    (i, j, _, x, y, _), (dx, dy, *_) = first["tie"][:6], first["scale"]
    corner, wider, higher = (x - i * dx, y + j * dy), first["width"][0] / one("width"), first["height"][0] / one("height")
    nodata = one("nodata", first.get("nodata", (b"",))[0]).rstrip(b"\0 ").decode()
    return Raster(
        order, one("width"), one("height"), one("samples", 1), one("planar", 1) == 2, f"{kind}{one('bits', 8) // 8}", one("compression", 1), one("predictor", 1),
        (one("tile_height"), one("tile_width")) if tiled else (min(one("strip_rows", one("height")), one("height")), one("width")),
        found["tile_offsets" if tiled else "strip_offsets"], found["tile_counts" if tiled else "strip_counts"], (dx * wider, dy * higher), corner, float(nodata) if nodata else None,
    )


def decoded(raster: Raster, data: bytes) -> np.ndarray:
    """(rows, columns, samples in the tile) of a tile's bytes; a last strip has fewer rows."""
    if raster.compression in DEFLATE:
        data = zlib.decompress(data)
    elif raster.compression != 1:
        raise ValueError(f"compression {raster.compression} isn't read")
    depth = 1 if raster.planar else raster.samples
    values = np.frombuffer(data, np.dtype(raster.dtype).newbyteorder(raster.order)).astype(raster.dtype).reshape(-1, raster.tile[1], depth)
    if raster.predictor == 2 and raster.dtype[0] != "f":
        values = np.cumsum(values, axis=1, dtype=raster.dtype)
    elif raster.predictor != 1:
        raise ValueError(f"predictor {raster.predictor} of {raster.dtype} isn't read")
    return values


class Tiles(InputPartition):
    def __init__(self, path: str, tiles: list[tuple[int, int]]):
        self.path, self.tiles = path, tiles


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        numbers = lambda name: tuple(map(float, options[name].split(","))) if options.get(name) else None
        self.window, self.grid = numbers("window"), numbers("grid")
        self.overview = int(options.get("overview", 0))
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))

    def _reader(self, store: fs.FileSystem, path: str):
        """read(offset, size) of a raster; that of a zip's only TIFF reads from memory."""
        file = store.open_input_file(path)
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BufferedReader(file)) as z:
                (name,) = [n for n in z.namelist() if n.lower().endswith((".tif", ".tiff"))]
                whole = z.read(name)
            return lambda at, size: whole[at : at + size]
        return lambda at, size: file.read_at(size, at)

    def _first_cell(self, raster: Raster, path: str) -> tuple[int, int]:
        """(row, column) on the grid of the file's first cell."""
        if self.grid is None:
            return 0, 0
        x0, y0, cell = self.grid
        column, row = (raster.corner[0] - x0) / cell, (y0 - raster.corner[1]) / cell
        if max(abs(raster.cell[0] - cell), abs(raster.cell[1] - cell)) > 1e-9 * cell or max(abs(column - round(column)), abs(row - round(row))) > 1e-6:
            raise ValueError(f"{path} doesn't lie on the grid")
        return round(row), round(column)

    def partitions(self) -> Sequence[InputPartition]:
        store, root = self._store()
        one = store.get_file_info(root)
        files = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        made: list[InputPartition] = []
        for path in sorted(f.path for f in files if f.path.lower().endswith((".tif", ".tiff", ".zip"))):
            raster = directory(self._reader(store, path), self.overview)
            self._first_cell(raster, path)
            tiles = raster.tiles_within(self.window)
            made += [Tiles(path, tiles[i : i + TILES]) for i in range(0, len(tiles), TILES)]
        return made or [Tiles("", [])]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        if not partition.tiles:
            return
        store, _ = self._store()
        read = self._reader(store, partition.path)
        raster = directory(read, self.overview)
        for i, j in partition.tiles:
            yield from self._cells(raster, read, partition.path, i, j)

    def _cells(self, raster: Raster, read, path: str, i: int, j: int) -> Iterator[pa.RecordBatch]:
        high, wide = raster.tile
        down = -(-raster.height // high)
        row, col = np.meshgrid(np.arange(i * high, min((i + 1) * high, raster.height)), np.arange(j * wide, min((j + 1) * wide, raster.width)), indexing="ij")
        x, y = raster.corner[0] + (col + 0.5) * raster.cell[0], raster.corner[1] - (row + 0.5) * raster.cell[1]
        inside = np.ones(row.shape, bool)
        if self.window is not None:
            west, south, east, north = self.window
            inside = (x + raster.cell[0] / 2 > west) & (x - raster.cell[0] / 2 < east) & (y + raster.cell[1] / 2 > south) & (y - raster.cell[1] / 2 < north)
        first_row, first_col = self._first_cell(raster, path)
        n = int(inside.sum())
        for band in self.bands or range(1, raster.samples + 1):
            at = i * raster.across + j + ((band - 1) * down * raster.across if raster.planar else 0)
            if raster.counts[at] == 0:  # a tile that isn't stored holds nothing
                values = np.full(row.shape, np.nan)
            else:
                whole = decoded(raster, read(raster.offsets[at], raster.counts[at]))
                values = whole[: row.shape[0], : row.shape[1], 0 if raster.planar else band - 1].astype(float)
            missing = np.isnan(values) | (values == raster.nodata if raster.nodata is not None else False)
            yield pa.RecordBatch.from_pydict({
                "path": pa.repeat(path, n), "band": np.full(n, band, np.int32), "row": (row + first_row)[inside].astype(np.int64), "col": (col + first_col)[inside].astype(np.int64),
                "x": x[inside], "y": y[inside], "value": pa.array(values[inside], mask=np.broadcast_to(missing, values.shape)[inside]),
            })


class RasterCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)


def raster_cells(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None, grid: tuple[float, float, float] | None = None, bands: list[int] | None = None, overview: int = 0) -> DataFrame:
    """(path, band, row, col, x, y, value) of the cells of the rasters under path, or of one of their overviews, that meet a window (west, south, east, north)."""
    ship_package(spark)
    spark.dataSource.register(RasterCells)
    read = spark.read.format("raster_cells").option("overview", overview)
    for name, value in (("window", window), ("grid", grid), ("bands", bands)):
        if value is not None:
            read = read.option(name, ",".join(map(repr, value)))
    return read.load(path)
