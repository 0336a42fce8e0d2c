import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import rings
from isohyet.sources import rasters


def tiff(values, corner=(0.0, 0.0), cell=10.0, tile=(16, 16), deflate=True, differences=True, planar=False, order="<", big=False, strips=False, nodata=None, hole=None, behind=b""):
    """Bytes of a TIFF of values (bands, rows, columns); behind another file's bytes, an image as its overview."""
    bands, height, width = values.shape
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    high, wide = (tile[0], width) if strips else tile
    blocks = []
    for band in range(bands) if planar else [None]:
        for i in range(0, height, high):
            for j in range(0, width, wide):
                part = (values[band : band + 1] if planar else values)[:, i : i + high, j : j + wide].transpose(1, 2, 0)
                if not strips:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if differences:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                data = part.astype(part.dtype.newbyteorder(order)).tobytes()
                blocks.append(b"" if hole == len(blocks) else zlib.compress(data) if deflate else data)
    form, word = ("Q", 8) if big else ("I", 4)
    start = len(behind) or (16 if big else 8)
    at = start + np.cumsum([0, *map(len, blocks)])
    names = ("strip_offsets", "strip_counts") if strips else ("tile_offsets", "tile_counts")
    fields = {
        "width": ("I", [width]), "height": ("I", [height]), "bits": ("H", [values.dtype.itemsize * 8] * bands), "compression": ("H", [8 if deflate else 1]), "samples": ("H", [bands]), "planar": ("H", [2 if planar else 1]),
        "predictor": ("H", [2 if differences else 1]), names[0]: (form, at[:-1].tolist()), names[1]: (form, [len(b) for b in blocks]), "kind": ("H", [kind] * bands), "scale": ("d", [cell, cell, 0.0]), "tie": ("d", [0.0, 0.0, 0.0, *corner, 0.0]),
    } | ({"strip_rows": ("I", [high])} if strips else {"tile_width": ("I", [wide]), "tile_height": ("I", [high])}) | ({"nodata": ("s", [f"{nodata}\0".encode()])} if nodata is not None else {})
    code, number = {v: k for k, v in rasters.TYPES.items()}, {v: k for k, v in rasters.TAGS.items()}
    first = int(at[-1])
    extra_at, extra, entries = first + (8 if big else 2) + len(fields) * (20 if big else 12) + word, b"", b""
    for name in sorted(fields, key=number.__getitem__):
        kind, held = fields[name]
        data, count = (held[0], len(held[0])) if kind == "s" else (struct.pack(f"{order}{len(held)}{kind}", *held), len(held))
        if len(data) > word:
            data, extra = struct.pack(f"{order}{form}", extra_at + len(extra)), extra + data
        entries += struct.pack(f"{order}HH{form}", number[name], code[kind], count) + data.ljust(word, b"\0")
    head = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, first) if big else struct.pack(f"{order}HI", 42, first))
    return (behind or head) + b"".join(blocks) + struct.pack(f"{order}{'Q' if big else 'H'}", len(fields)) + entries + b"\0" * word + extra


def image(bands=1, height=50, width=70, dtype="u2", seed=1):
    return np.random.default_rng(seed).integers(0, 250, (bands, height, width)).astype(dtype)


def array_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.band - 1, r.row, r.col] = np.nan if r.value is None else r.value
    return out


@pytest.mark.parametrize("how", [
    {}, {"differences": False}, {"deflate": False}, {"order": ">"}, {"big": True}, {"planar": True, "bands": 3}, {"bands": 4}, {"strips": True}, {"strips": True, "deflate": False, "big": True, "order": ">"}, {"dtype": "u1"}, {"dtype": "f4", "differences": False}, {"dtype": "i4", "tile": (32, 16)},
])
def test_every_layout(spark, tmp_path, how):
    values = image(**{k: how.pop(k) for k in ("bands", "dtype") if k in how})
    (tmp_path / "a.tif").write_bytes(tiff(values, (1_000.0, 2_000.0), **how))
    cells = rasters.raster_cells(spark, str(tmp_path))
    assert cells.count() == values.size and (array_of(cells, values.shape) == values).all()
    r = cells.where("row = 3 AND col = 5").first()
    assert (r.x, r.y) == (1_055.0, 1_965.0)


class Watched:
    def __init__(self, reader):
        self.plain, self.reads = reader._reader, []

    def __call__(self, store, path):
        read = self.plain(store, path)

        def watched(at, size):
            self.reads.append((at, size))
            return read(at, size)

        return watched


def test_only_tiles_within_the_window_are_read(tmp_path):
    values = image(4, 160, 160)
    (tmp_path / "a.tif").write_bytes(tiff(values))
    reader = rasters.RasterReader({"path": str(tmp_path), "window": "330,-900,500,-640", "bands": "2,4"})
    watch = Watched(reader)
    reader._reader = watch
    raster = rasters.directory(watch.plain(*[reader._store()[0], str(tmp_path / "a.tif")]))
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    rows = [r for b in batches for r in b.to_pylist()]
    assert {(r["row"], r["col"]) for r in rows} == {(i, j) for i in range(64, 90) for j in range(33, 50)} and {r["band"] for r in rows} == {2, 4}
    assert all(values[r["band"] - 1, r["row"], r["col"]] == r["value"] for r in rows)
    touched = {raster.offsets.index(at) for at, size in watch.reads if at in raster.offsets and size in raster.counts}
    assert touched == {i * 10 + j for i in (4, 5) for j in (2, 3)}


def test_a_zipped_mosaic_gives_ring_weights_their_cells(spark, tmp_path):
    """Two files side by side on one grid, one of them zipped: numbered as one, with nodata and a tile that isn't stored; what no file covers has no row."""
    values = image(1, 64, 96)
    values[0, 10, 20] = 255
    (tmp_path / "west.tif").write_bytes(tiff(values[:, :, :48], (500.0, 900.0), nodata=255))
    with zipfile.ZipFile(tmp_path / "east.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("east.tif", tiff(values[:, :, 48:], (980.0, 900.0), nodata=255, hole=11))
        z.writestr("readme.txt", "x")
    cells = rasters.raster_cells(spark, str(tmp_path), grid=(0.0, 1_000.0, 10.0))
    got = array_of(cells, (1, 74, 146))[:, 10:, 50:]
    want = values.astype(float)
    want[0, 10, 20] = np.nan
    want[0, 48:, 80:96] = np.nan
    assert np.array_equal(got, want, equal_nan=True) and cells.count() == values.size
    # built-up cells of a ring of 100 m around a place, by the weights of the ring's cells
    stations = spark.createDataFrame([(1, 980.0 - 0, 700.0)], "src_id int, x double, y double")
    # rows of weights count upwards from y = 0, those of the raster downwards from y = 1000
    weights = rings.cell_weights(stations, [100.0], 10.0).withColumn("row", 99 - F.col("row"))
    joined = weights.join(cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value"), ["row", "col"])
    total = joined.agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum("w").alias("w")).first()
    assert total.w == pytest.approx(np.pi * 100)
    assert total.s == pytest.approx(sum(r.w * values[0, r.row - 10, r.col - 50] for r in weights.collect()))


def test_what_does_not_fit_is_an_error(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(image(), (503.0, 900.0)))
    with pytest.raises(Exception, match="doesn't lie on the grid"):
        rasters.raster_cells(spark, str(tmp_path), grid=(0.0, 1_000.0, 10.0)).count()
    (tmp_path / "b.tif").write_bytes(b"none of it")
    with pytest.raises(Exception, match="not a TIFF"):
        rasters.raster_cells(spark, str(tmp_path / "b.tif")).count()
    assert rasters.raster_cells(spark, str(tmp_path / "nowhere")).count() == 0
    assert rasters.raster_cells(spark, str(tmp_path / "a.tif"), window=(9e6, 0.0, 9.1e6, 10.0)).count() == 0


@pytest.mark.parametrize("big", [False, True])
def test_overviews(spark, tmp_path, big):
    """A file with an image of half the width and height behind it: its cells are twice as wide, lie in the same place and are read from its tiles alone."""
    values = image(2, 64, 96)
    small = values[:, ::2, ::2]
    plain = tiff(values, (100.0, 900.0), big=big, nodata=7)
    both = bytearray(tiff(small, (0.0, 0.0), big=big, behind=plain))
    # the first directory's pointer to the next one
    form, count = ("<Q", 20) if big else ("<I", 12)
    first = struct.unpack(form, plain[8:16] if big else plain[4:8])[0]
    n = struct.unpack("<Q" if big else "<H", plain[first : first + (8 if big else 2)])[0]
    alone = tiff(small, (0.0, 0.0), big=big)
    second = len(plain) + struct.unpack(form, alone[8:16] if big else alone[4:8])[0] - (16 if big else 8)
    at = first + (8 if big else 2) + n * count
    both[at : at + struct.calcsize(form)] = struct.pack(form, second)
    (tmp_path / "a.tif").write_bytes(bytes(both))
    want = np.where(small == 7, np.nan, small.astype(float))
    cells = rasters.raster_cells(spark, str(tmp_path), overview=1)
    assert np.array_equal(array_of(cells, small.shape), want, equal_nan=True)
    assert tuple(cells.where("row = 1 AND col = 2 AND band = 1").select("x", "y").first()) == (150.0, 870.0)
    assert rasters.raster_cells(spark, str(tmp_path)).count() == values.size
    with pytest.raises(Exception, match="1 overviews only"):
        rasters.raster_cells(spark, str(tmp_path), overview=2).count()
