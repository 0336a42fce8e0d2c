"""Self-describing text files: header grammar, dataset-wide schema, typed rows, run record.

A file is header lines 'key,column,value', a line 'data', a line of column names, rows, and a line 'end data'. Files are read whole
(a file is one station and year, some hundred kilobytes) and taken apart by array functions, so that nothing depends on the order of
lines across tasks. Bad files carry an error and are left out; a conflict of types stops the run before anything is written.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.coerce import cause, resolved_type, value
from isohyet.session import shared_dir

SQL_TYPE = {"int": "bigint", "float": "float", "time": "timestamp", "char": "string"}
ATTRIBUTION = ("src_id", "county", "station_file_name")


def scan(spark: SparkSession, raw: str, county: str | None = None, qc_version: int = 1) -> DataFrame:
    """(path, county, station, year, text) of the files <raw>/<county>/<id_name>/qc-version-<n>/*.csv."""
    glob = f"{raw}/{county or '*'}/*/qc-version-{qc_version}"
    files = spark.read.option("pathGlobFilter", "*.csv").text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    part = lambda i: F.element_at(F.split("path", "/"), -i)
    return files.select("path", part(4).alias("county"), part(3).alias("station"), F.regexp_extract("path", r"_([0-9]{4})\.csv$", 1).alias("year"), "text").withColumn(
        "src_id", F.nullif(F.regexp_extract("station", "^([0-9]+)", 1), F.lit("")).cast("bigint")
    )


def _once(rows: DataFrame, *made: Column) -> DataFrame:
    """rows with columns made, each computed once: what a generator gives isn't inlined in the filters and columns that use it."""
    return rows.select(*rows.columns, F.inline(F.array(F.struct(*made))))


def split_files(files: DataFrame) -> DataFrame:
    """Adds header (array of lines), columns, rows (array of lines) and error.

    Lines are made once a file, by functions that Spark compiles; functions of single lines, which it doesn't, are few and split none of them.
    """
    kept = [c for c in files.columns if c != "text"]
    lines = F.transform(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1), lambda x: F.trim(x))
    line, at, end = F.col("__line"), F.col("__at"), F.col("__end")
    filled = lambda a: F.array_remove(a, "")
    placed = _once(_once(files, lines.alias("__line")), F.array_position(line, "data").alias("__at"), F.array_position(line, "end data").alias("__end"))
    names = F.transform(F.split(F.get(line, at.cast("int")), ","), lambda x: F.trim(x))
    body = F.slice(line, at + 2, F.greatest(end - at - 2, F.lit(0)))
    parts = F.struct(F.when(at > 0, filled(F.slice(line, 1, at - 1))).alias("header"), F.when(at > 0, names).alias("columns"), F.when((at > 0) & (end > at), filled(body)).alias("rows"))
    taken = placed.select(*kept, "__at", "__end", F.inline(F.array(parts)))
    n = F.size("columns")
    # a line of fewer than n commas is what stands before its nth
    fewer = lambda x, n: F.call_function("substring_index", x, F.lit(","), n) == x
    bad_header = F.exists("header", lambda x: fewer(x, F.lit(2)))
    bad_row = F.exists("rows", lambda x: ~fewer(x, n) | fewer(x, n - 1))
    error = (
        F.when(F.col("src_id").isNull(), "no station number in the folder's name").when(at == 0, "no 'data' line").when(F.col("columns").isNull() | (F.get("columns", F.lit(0)) == ""), "no column row")
        .when(bad_header, "header line of fewer than three parts").when(end == 0, "no 'end data' line").when(F.size(F.array_distinct("columns")) < n, "a column is named twice").when(bad_row, "row of another number of fields")
    )
    return taken.select(*kept, "header", "columns", "rows", error.alias("error"))


def headers(parsed: DataFrame) -> DataFrame:
    """(path, key, col, value): the header lines of good files, in order (nth)."""
    parts = F.split("line", ",", 3)
    return parsed.where("error is null").select("path", "county", "station", F.posexplode("header").alias("nth", "line")).select(
        "path", "county", "station", "nth", F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("col"), F.trim(parts[2]).alias("value")
    )


def column_types(parsed: DataFrame) -> DataFrame:
    """(path, station, col, type, declared, unit) for each column of each good file."""
    h = headers(parsed)
    declared = h.where("key = 'type'").groupBy("path", "col").agg(F.max_by("value", "nth").alias("declared"))
    times = h.where("key = 'coordinate_variable' and value like 't%'").select("path", "col").distinct().withColumn("is_time", F.lit(True))
    units = h.where("key = 'long_name'").groupBy("path", "col").agg(F.max_by("value", "nth").alias("long_name")).withColumn("unit", F.trim(F.element_at(F.split("long_name", ","), -1))).drop("long_name")
    cols = parsed.where("error is null").select("path", "county", "station", F.explode("columns").alias("col"))
    joined = cols.join(declared, ["path", "col"], "left").join(times, ["path", "col"], "left").join(units, ["path", "col"], "left")
    return joined.select(
        "path", "county", "station", "col", resolved_type(F.col("declared"), F.coalesce("is_time", F.lit(False)), F.col("col")).alias("type"), F.col("declared").isNotNull().alias("declared"), "unit"
    )


@dataclass
class DatasetSchema:
    types: dict[str, str]
    widened: dict[str, tuple[str, str]] = field(default_factory=dict)
    units: dict[str, str] = field(default_factory=dict)
    releases: list[str] = field(default_factory=list)


def union_types(types: DataFrame) -> DataFrame:
    """(col, types, type, stations): the union over files; int and float widen to float, other mixtures leave type null."""
    seen = types.groupBy("col").agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.min_by("unit", "path").alias("unit"),
        F.array_sort(F.array(F.min_by("station", F.struct("type", "path")), F.max_by("station", F.struct("type", "path")))).alias("stations"),
    )
    return seen.withColumn("type", F.when(F.size("types") == 1, F.get("types", F.lit(0))).when(F.array_join("types", ",") == "float,int", "float"))


#: Keys of the header lines that the schema is made of.
SCHEMA_KEYS = ("type", "coordinate_variable", "long_name", "collection_version_number")


def header_kinds(parsed: DataFrame) -> DataFrame:
    """Of good files with the same columns and the same lines on them, the first and the last by path: what stands for all of them in the schema.

    (path, county, station, header, columns, error), off its lineage, as several tables are made from it.
    """
    told = F.filter("header", lambda x: F.trim(F.substring_index(x, ",", 1)).isin(*SCHEMA_KEYS))
    file = F.struct("path", "county", "station")
    # beside a collected set, paths are compared in a hash table; by themselves they would have all files sorted
    kinds = parsed.where("error is null").groupBy(told.alias("header"), "columns").agg(F.min(file).alias("first"), F.max(file).alias("last"), F.collect_set(F.lit(1)).alias("any"))
    shared_dir(parsed.sparkSession)
    ends = kinds.checkpoint().select(F.explode(F.array_distinct(F.array("first", "last"))).alias("f"), "header", "columns")
    return ends.select("f.*", "header", "columns", F.lit(None).cast("string").alias("error"))


def dataset_schema(parsed: DataFrame) -> DatasetSchema:
    """The frozen schema of all good files; a conflict raises before anything is written. Columns are few: they come to the driver."""
    parsed = header_kinds(parsed)
    rows = union_types(column_types(parsed)).orderBy("col").collect()
    for r in rows:
        if r.type is None:
            raise ValueError(f"column {r.col} has types {', '.join(r.types)} at stations {r.stations[0]} and {r.stations[1]}")
    releases = [r[0] for r in headers(parsed).where("key = 'collection_version_number' and col = 'G'").select("value").distinct().orderBy("value").collect()]
    return DatasetSchema(
        {r.col: r.type for r in rows}, {r.col: tuple(r.stations) for r in rows if len(r.types) > 1}, {r.col: r.unit for r in rows if r.unit}, releases
    )


def _own_ints(schema: DatasetSchema | None) -> Column:
    """Of the columns that the dataset widens, those that a file declares as integers: their tokens are read as such, and then widened."""
    part = lambda line, i: F.trim(F.split(line, ",", 3)[i])
    declared = lambda c: part(F.try_element_at(F.filter("header", lambda x: (part(x, 0) == "type") & (part(x, 1) == c)), F.lit(-1)), 2)
    widened = sorted(schema.widened) if schema else []
    return F.filter(F.array(*map(F.lit, widened)), lambda c: declared(c) == "int") if widened else F.array().cast("array<string>")


def tokens(parsed: DataFrame, schema: DatasetSchema | None = None) -> DataFrame:
    """(path, county, station, src_id, own_ints, row, cells): cells maps names to raw tokens."""
    good = parsed.where("error is null").select("path", "county", "station", "src_id", "columns", _own_ints(schema).alias("own_ints"), F.posexplode("rows").alias("row", "line"))
    cells = F.map_from_arrays("columns", F.split("line", ",", -1))
    return good.select("path", "county", "station", "src_id", "own_ints", "row", cells.alias("cells"))


def typed_rows(parsed: DataFrame, schema: DatasetSchema) -> DataFrame:
    """Rows under the dataset schema, columns by name, absent ones null; attribution columns replace those in the file.

    A column that the dataset widens is read by the file's own type first: a fraction in a file of integers has no value.
    """
    release = headers(parsed).where("key = 'collection_version_number' and col = 'G'").groupBy(F.col("path").alias("r_path")).agg(F.max_by("value", "nth").alias("collection_version"))
    rows = tokens(parsed, schema)

    def typed(c: str, kind: str) -> Column:
        token = F.try_element_at("cells", F.lit(c))
        out = value(token, kind).cast(SQL_TYPE[kind])
        return F.when(F.array_contains("own_ints", c), value(token, "int").cast("float")).otherwise(out) if c in schema.widened else out

    cols = [typed(c, t).alias(c, metadata={"unit": schema.units[c]} if c in schema.units else {}) for c, t in sorted(schema.types.items()) if c not in ATTRIBUTION]
    base = [F.col("src_id"), F.col("county"), F.col("station").alias("station_file_name")]
    if len(schema.releases) > 1:
        return rows.join(release, rows["path"] == release["r_path"], "left").select(*base, "collection_version", *cols)
    return rows.select(*base, *cols)


def cell_causes(parsed: DataFrame, schema: DatasetSchema) -> DataFrame:
    """(county, path, col, cause, mismatched) for every cell of every good file: why it has no value, and whether it names another station."""
    lines = parsed.where("error is null").select("path", "county", "src_id", "columns", _own_ints(schema).alias("own_ints"), F.explode("rows").alias("line"))
    cells = lines.select("county", "path", "src_id", "own_ints", F.inline(F.arrays_zip("columns", F.split("line", ",", -1).alias("token"))).alias("col", "token"))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(schema.types.items()) for x in kv]), F.col("col"))
    typed = cells.withColumn("kind", F.when(F.array_contains("own_ints", F.col("col")), "int").otherwise(kind) if schema.widened else kind)
    why = F.lit(None).cast("string")
    for kind in SQL_TYPE:
        why = F.when(F.col("kind") == kind, cause(F.col("token"), kind)).otherwise(why)
    other = (F.col("col") == "src_id") & (value(F.col("token"), "int") != F.col("src_id"))
    return _once(typed.select("county", "path", "col", "token", "kind", "src_id"), why.alias("cause"), F.coalesce(other, F.lit(False)).alias("mismatched")).drop("token", "kind", "src_id")


def _tallied(cells: DataFrame) -> DataFrame:
    return cells.groupBy("county", "path", "col").agg(*[F.count_if(F.col("cause") == c).alias(c) for c in ("na", "empty", "coerced")], F.count_if("mismatched").alias("mismatched"))


def cell_tallies(parsed: DataFrame, schema: DatasetSchema) -> DataFrame:
    """(county, path, col, na, empty, coerced, mismatched) for every column of every good file, from one pass over the cells."""
    return _tallied(cell_causes(parsed, schema))


def cause_counts(parsed: DataFrame, schema: DatasetSchema) -> DataFrame:
    """(path, col, na, empty, coerced) for columns with any."""
    return cell_tallies(parsed, schema).where("na + empty + coerced > 0").select("path", "col", "na", "empty", "coerced")


def src_id_mismatches(parsed: DataFrame) -> DataFrame:
    """(path, n): rows whose own station number differs from the folder's."""
    own = value(F.try_element_at("cells", F.lit("src_id")), "int")
    return tokens(parsed).where(own != F.col("src_id")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def utc_now() -> str:
    """The moment as an ISO stamp in UTC."""
    return datetime.now(UTC).isoformat(timespec="seconds")


def run_details(parsed: DataFrame, schema: DatasetSchema) -> DataFrame:
    """(county, kind, file, column, count, error): an entry for every finding of the run, as many as there are; sinks write them by county."""
    entry = lambda kind, column, n: F.when(n > 0, F.struct(F.lit(kind).alias("kind"), column.alias("column"), n.alias("count")))
    found = [entry("coercion", F.col("col"), F.col("coerced")), entry("empty_field", F.col("col"), F.col("empty")), entry("src_id_mismatch", F.lit(None).cast("string"), F.col("mismatched"))]
    # cells that nothing stands against aren't shuffled
    of_cells = _tallied(cell_causes(parsed, schema).where("mismatched or cause in ('empty', 'coerced')")).select("county", F.col("path").alias("file"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    declared = F.transform(F.filter("header", lambda x: x.startswith("type,")), lambda x: F.trim(F.split(x, ",", 3)[1]))
    # the exploded array is no column of its own: as one, it would be computed anew in the filter that Spark puts before
    undeclared = F.explode(F.when(F.col("error").isNull(), F.array_except("columns", declared)))
    files = parsed.select("county", F.col("path").alias("file"), "header", "columns", "error")
    none = F.lit(None)
    return (
        of_cells.select("county", "x.kind", "file", "x.column", "x.count", none.cast("string").alias("error"))
        .unionByName(files.select("county", F.lit("undeclared_fallback").alias("kind"), "file", undeclared.alias("column"), none.cast("bigint").alias("count"), none.cast("string").alias("error")))
        .unionByName(files.where("error is not null").select("county", F.lit("failure").alias("kind"), "file", none.cast("string").alias("column"), none.cast("bigint").alias("count"), "error"))
    )


def run_record(parsed: DataFrame, details: DataFrame, schema: DatasetSchema, dataset: str, qc_version: int, raw: str, started: str | None = None, finished: str | None = None) -> DataFrame:
    """One row, record: the run's audit as JSON, with totals by county and by kind of finding; run_details() has the findings themselves.

    started and finished, where given, are stamps of the run; utc_now() makes them.
    """
    per_county = parsed.groupBy("county").agg(F.count_if(F.col("error").isNull()).alias("ok"), F.sum(F.coalesce(F.when(F.col("error").isNull(), F.size("rows")), F.lit(0))).alias("rows"))
    counts = per_county.agg(
        F.sum("ok").alias("files_parsed"), F.sum("rows").alias("total_rows"), F.count_if(F.col("ok") > 0).alias("counties_written"),
        F.array_sort(F.collect_list(F.when(F.col("ok") == 0, F.col("county")))).alias("counties_skipped_all_failed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("ok") > 0, F.struct("county", "rows"))))).alias("rows_per_county"),
    )
    kinds = ("coercion", "empty_field", "undeclared_fallback", "src_id_mismatch", "failure")
    is_ = lambda k: F.col("kind") == k
    found = details.agg(F.struct(*[F.struct(F.count_if(is_(k)).alias("entries"), F.coalesce(F.sum(F.when(is_(k), F.coalesce("count", F.lit(1)))), F.lit(0)).alias("values")).alias(k) for k in kinds]).alias("findings"))
    fixed = [F.lit(dataset).alias("dataset"), F.lit(qc_version).alias("qc_version"), F.lit(raw).alias("raw_dir"), F.array(*map(F.lit, schema.releases)).cast("array<string>").alias("releases"), F.lit(len(schema.types)).alias("schema_columns"), F.array(*map(F.lit, sorted(schema.widened))).cast("array<string>").alias("schema_widenings")]
    stamps = [F.lit(v).alias(n) for n, v in (("started", started), ("finished", finished)) if v is not None]
    return counts.join(found).select(F.to_json(F.struct(*fixed, *stamps, *counts.columns, "findings")).alias("record"))
