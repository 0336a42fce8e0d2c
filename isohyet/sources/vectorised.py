"""Self-describing files in Arrow: typed columns and the causes of nulls from one pass over the files' bodies.

The same grammar and the same typing as selfdesc and functions.coerce, for files of many rows and columns; files come through Spark's
reader (selfdesc.scan), their schema from a header scan (station_headers) or from selfdesc.dataset_schema. Files of the same columns are read
together, many small ones as one table. A column is cast as a whole; only columns that hold a token which a plain cast refuses are looked at token by
token, each different token once. What a token gives doesn't depend on the others.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from isohyet.functions.coerce import NUMBER
from isohyet.session import ship_package
from isohyet.sources.selfdesc import ATTRIBUTION, SQL_TYPE, DatasetSchema

_DATA, _END = re.compile(r"^ *data *$", re.M), re.compile(r"^ *end data *$", re.M)
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"
#: Characters of files that are held and read at once.
CHUNK = 1 << 23
_ARROW = {"int": pa.int64(), "float": pa.float32(), "time": pa.timestamp("us", "UTC"), "char": pa.string()}


def _lenient_int(token: str) -> int | None:
    if re.fullmatch(r"[+-]?[0-9]+", token) and -(2**63) <= int(token) < 2**63:
        return int(token)
    number = float(token) if re.match(NUMBER, token) else math.inf
    return int(number) if -(2.0**63) <= number < 2.0**63 and number == math.floor(number) else None


def _finite_float(token: str) -> float | None:
    if not re.match(NUMBER, token):
        return None
    value = pa.scalar(token).cast(pa.float32()).as_py() if token[0] != "+" else pa.scalar(token[1:]).cast(pa.float32()).as_py()
    return value if math.isfinite(value) else None


def _by_token(tokens: pa.Array, parse: Callable, kind: pa.DataType) -> pa.Array:
    """Each different token parsed once."""
    coded = tokens.dictionary_encode()
    return pa.array([None if t is None else parse(t) for t in coded.dictionary.to_pylist()], kind).take(coded.indices)


def typed(tokens: pa.Array, kind: str) -> pa.Array:
    """Values of trimmed tokens, missing ones null already; null where a token has none."""
    if kind == "char":
        return tokens
    if kind == "time":
        plain = pc.if_else(pc.match_substring_regex(tokens, _TIME), tokens, pa.scalar(None, pa.string()))
        values = pc.strptime(plain, "%Y-%m-%d %H:%M:%S", "us", error_is_null=True)
        # a day or second that doesn't exist would roll over
        same = lambda part, start: pc.equal(part(values), pc.utf8_slice_codeunits(plain, start, start + 2).cast(pa.int64()))
        exists = pc.and_(same(pc.day, 8), same(pc.second, 17))
        return pc.if_else(exists, values, pa.scalar(None, values.type)).cast(_ARROW["time"])
    try:
        values = tokens.cast(_ARROW[kind])
        # a cast to integers takes hexadecimal forms
        if kind == "int" and not pc.any(pc.match_substring(tokens, "x", ignore_case=True), min_count=0).as_py():
            return values
        if kind == "float" and pc.all(pc.is_finite(values), min_count=0).as_py():
            return values
    except pa.ArrowInvalid:
        pass
    return _by_token(tokens, _lenient_int if kind == "int" else _finite_float, _ARROW[kind])


def _trimmed(tokens: pa.Array) -> pa.Array:
    return pc.utf8_trim(tokens, " ")


@lru_cache(maxsize=256)
def _header(head: str) -> tuple[bool, str | None, dict[str, str]]:
    """(whether a line has too few parts, release, declared types) of header lines; files of a dataset share most of them."""
    parts = [x.split(",", 2) for x in (x.strip(" ") for x in head.split("\n")) if x]
    if any(len(p) < 3 for p in parts):
        return True, None, {}
    release, declared = None, {}
    for key, column, value in ([x.strip(" ") for x in p] for p in parts):
        if key == "collection_version_number" and column == "G":
            release = value
        elif key == "type":
            declared[column] = value
    return False, release, declared


class Body:
    """A file's lines of values, n of them, with what its header says of them, or the error that stands against it."""

    def __init__(self, text: str, src_id: int | None, county: str | None = None, name: str | None = None):
        self.src_id, self.county, self.name = src_id, county, name
        self.error, self.release, self.declared, self.lines, self.n = None, None, {}, "", 0
        text = text.replace("\r", "")
        start = _DATA.search(text)
        rest = text[start.end() + 1 :] if start else ""
        names_line, _, body = rest.partition("\n")
        self.names = tuple(x.strip(" ") for x in names_line.strip(" ").split(","))
        # the end mark ends the body wherever it stands behind the column row
        stop = _END.search(body)
        bad, self.release, self.declared = _header(text[: start.start()] if start else "")
        if src_id is None:
            self.error = "no station number in the folder's name"
        elif start is None:
            self.error = "no 'data' line"
        elif not rest or self.names[0] == "":
            self.error = "no column row"
        elif bad:
            self.error = "header line of fewer than three parts"
        elif stop is None and not _END.search(text):
            self.error = "no 'end data' line"
        elif len(set(self.names)) < len(self.names):
            self.error = "a column is named twice"
        elif stop:
            self.lines = re.sub(r"\n{2,}", "\n", re.sub(r"^ +$", "", body[: stop.start()], flags=re.M)).strip("\n")
            self.n = self.lines.count("\n") + 1 if self.lines else 0


class Chunk:
    """Files of the same columns, their lines read as one table of raw tokens."""

    def __init__(self, bodies: list[Body], columns: pa.Table):
        self.bodies, self.columns = bodies, columns
        #: the file of each row
        self.of = np.repeat(np.arange(len(bodies)), [b.n for b in bodies])

    def repeated(self, values: list, kind: pa.DataType) -> pa.Array:
        """A value of each file, for each of its rows."""
        return pa.array(values, kind).take(pa.array(self.of))

    def counted(self, mask: pa.Array) -> list[int]:
        """How many rows of each file are marked."""
        marked = pc.fill_null(mask, False).to_numpy(zero_copy_only=False)
        return np.bincount(self.of[marked], minlength=len(self.bodies)).tolist()

    def values(self, name: str, kind: str, widened: bool = False) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        """(values, na, empty, coerced) of a column; a widened one is read by the files' own type first."""
        column = self.columns.column(name)
        tokens = _trimmed(column.chunk(0) if column.num_chunks else pa.array([], pa.string()))
        na, empty = pc.equal(tokens, "NA"), pc.equal(tokens, "")
        present = pc.if_else(pc.or_(na, empty), pa.scalar(None, pa.string()), tokens)
        own = "int" if widened and self.bodies[0].declared.get(name) == "int" else kind
        out = typed(present, own)
        if own != kind:
            out = out.cast(_ARROW[kind], safe=False)
        return out, na, empty, pc.and_(pc.is_null(out), pc.is_valid(present))


def _read(bodies: list[Body]) -> Iterator[Chunk]:
    """The table of files of the same columns; where a row has another number of fields, halves are read until its file stands alone and gets the error."""
    names, n = bodies[0].names, sum(b.n for b in bodies)
    if not n:
        yield Chunk(bodies, pa.table({c: pa.array([], pa.string()) for c in names}))
        return
    # a leading empty line, which the reader skips, keeps it from taking a mark of the byte order off the first value
    text = "\n" + "\n".join(b.lines for b in bodies if b.n) + "\n"
    try:
        columns = csv.read_csv(
            pa.BufferReader(text.encode()), csv.ReadOptions(column_names=list(names), use_threads=False, block_size=1 << 30), csv.ParseOptions(quote_char=False),
            csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
        ).combine_chunks()
        if columns.num_rows != n:
            raise ValueError(f"{columns.num_rows} rows of {n} lines")
        yield Chunk(bodies, columns)
    except pa.ArrowInvalid:
        if len(bodies) == 1:
            bodies[0].error = "row of another number of fields"
            return
        half = len(bodies) // 2
        yield from _read(bodies[:half])
        yield from _read(bodies[half:])


def _chunks(bodies: Iterator[Body], widened: set[str], failed: list[Body]) -> Iterator[Chunk]:
    """Files without error, some CHUNK characters at once, those of the same columns (and of the same own types, where the dataset widens) together; others go to failed."""
    held, size = defaultdict(list), 0

    def read() -> Iterator[Chunk]:
        for group in held.values():
            yield from _read(group)
            failed.extend(b for b in group if b.error)
        held.clear()

    for body in bodies:
        if body.error:
            failed.append(body)
            continue
        held[body.names, tuple(c for c in sorted(widened) if body.declared.get(c) == "int")].append(body)
        size += len(body.lines)
        if size >= CHUNK:
            yield from read()
            size = 0
    yield from read()


def _files(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def rows(files: DataFrame, schema: DatasetSchema) -> DataFrame:
    """selfdesc.typed_rows() of files (path, county, station, src_id, text) that have no error: one pass, no shuffle."""
    ship_package(files.sparkSession)
    columns = [(c, t) for c, t in sorted(schema.types.items()) if c not in ATTRIBUTION]
    widened = set(schema.widened)
    versions = len(schema.releases) > 1
    base = [T.StructField("src_id", T.LongType()), T.StructField("county", T.StringType()), T.StructField("station_file_name", T.StringType())] + [T.StructField("collection_version", T.StringType())] * versions
    out = T.StructType([*base, *(T.StructField(c, T._parse_datatype_string(SQL_TYPE[t])) for c, t in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = (Body(text or "", src_id, county, station) for src_id, county, station, text in _files(b, "src_id", "county", "station", "text"))
            for chunk in _chunks(bodies, widened, []):
                n = chunk.columns.num_rows
                if not n:
                    continue
                made = [chunk.repeated([getattr(x, f) for x in chunk.bodies], kind) for f, kind in [("src_id", pa.int64()), ("county", pa.string()), ("name", pa.string())] + [("release", pa.string())] * versions]
                made += [chunk.values(c, t, c in widened)[0] if c in chunk.columns.column_names else pa.nulls(n, _ARROW[t]) for c, t in columns]
                yield pa.RecordBatch.from_arrays(made, out.names)

    return files.select("src_id", "county", "station", "text").mapInArrow(run, out)


TALLIES = "county string, path string, rows long, error string, col string, na long, empty long, coerced long, mismatched long"


def tallies(files: DataFrame, schema: DatasetSchema) -> DataFrame:
    """A row for every column of every file, with the causes of its nulls and rows that name another station; one without column for a file with an error."""
    ship_package(files.sparkSession)
    types, widened = dict(schema.types), set(schema.widened)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in TALLIES.split(", ")]
        kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in TALLIES.split(", ")]

        def made(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            failed: list[Body] = []
            bodies = (Body(text or "", src_id, county, path) for path, src_id, county, text in _files(b, "path", "src_id", "county", "text"))
            for chunk in _chunks(bodies, widened, failed):
                k = len(chunk.bodies)
                files_ = [[x.county for x in chunk.bodies], [x.name for x in chunk.bodies], [x.n for x in chunk.bodies], [None] * k]
                for c in chunk.columns.column_names:
                    values, *causes = chunk.values(c, types.get(c, "char"), c in widened)
                    other = [0] * k
                    if c == "src_id":
                        own = chunk.repeated([x.src_id for x in chunk.bodies], pa.int64())
                        other = chunk.counted(pc.not_equal(values if types.get(c) == "int" else typed(values, "int"), own))
                    yield made([*files_, [c] * k, *map(chunk.counted, causes), other])
            yield made([[x.county for x in failed], [x.name for x in failed], [None] * len(failed), [x.error for x in failed], *[[None] * len(failed)] * 5])

    return files.select("path", "src_id", "county", "text").mapInArrow(run, TALLIES)
