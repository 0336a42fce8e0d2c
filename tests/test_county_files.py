import json

import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from isohyet.sources import county_files, selfdesc, vectorised
from tests.test_selfdesc import tree

SCHEMA = selfdesc.DatasetSchema({"temp": "float"}, {"temp": ("00012_a", "00020_b")}, {"temp": "degC"}, ["1", "2"])


def names(path):
    return sorted(p.name for p in path.iterdir())


def rows_of(spark, n, counties=3):
    return spark.range(n).selectExpr(f"concat('c', if(id % 5 < 3, 0, id % {counties})) AS county", "concat(lpad(id % 7, 5, '0'), '_s') AS station_file_name", "id AS src_id", "cast(id AS float) AS temp", "timestamp_seconds(id) AS ob_time")


def test_files_of_a_parse(spark, tmp_path):
    """A file a county, columns by name, the dataset's metadata in each, times in milliseconds."""
    tree(tmp_path / "raw", release="2")
    files = selfdesc.scan(spark, str(tmp_path / "raw"))
    schema = selfdesc.dataset_schema(selfdesc.split_files(files))
    rows = vectorised.rows(files, schema)
    path = county_files.write_county_files(rows, str(tmp_path / "out"), "hourly", schema)
    assert path == f"{tmp_path}/out/obs/hourly" and names(tmp_path / "out/obs/hourly") == ["ayr.parquet", "bute.parquet"]
    file = parquet.ParquetFile(f"{path}/bute.parquet")
    told = file.schema_arrow.metadata
    assert (told[b"releases"], json.loads(told[b"units"]), json.loads(told[b"widenings"])) == (b"1;2", {"temp": "degC"}, {"temp": ["00012_a", "00020_b"]})
    assert file.schema_arrow.names == sorted(rows.columns) and str(file.schema_arrow.field("ob_time").type) == "timestamp[ms, tz=UTC]" and file.metadata.row_group(0).column(0).compression == "ZSTD"
    assert sorted(map(repr, spark.read.parquet(path).select(rows.columns).collect())) == sorted(map(repr, rows.collect()))


def test_hot_counties_are_numbered_and_reruns_replace(spark, tmp_path):
    out = tmp_path / "out/obs/hourly"
    county_files.write_county_files(rows_of(spark, 1_000), str(tmp_path / "out"), "hourly", SCHEMA, rows_a_file=200)
    first = names(out)
    assert {"c1.parquet", "c2.parquet"} <= set(first) and [n for n in first if n.startswith("c0")] == [f"c0-{i:04d}.parquet" for i in range(1, len(first) - 1)] and len(first) >= 6
    assert all(parquet.read_metadata(out / n).num_rows <= 200 for n in first) and spark.read.parquet(str(out)).count() == 1_000
    county_files.write_county_files(rows_of(spark, 60, 2), str(tmp_path / "out"), "hourly", SCHEMA)
    assert names(out) == ["c0.parquet", "c1.parquet"] and spark.read.parquet(str(out)).count() == 60
    county_files.write_county_files(rows_of(spark, 0), str(tmp_path / "out"), "hourly", SCHEMA)
    assert names(out) == []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out/obs/hourly"
    county_files.write_county_files(rows_of(spark, 100), str(tmp_path / "out"), "hourly", SCHEMA)
    before = {n: (out / n).read_bytes() for n in names(out)}
    broken = rows_of(spark, 5_000).withColumn("temp", F.when(F.col("src_id") == 4_999, F.raise_error(F.lit("broken row"))).otherwise(F.col("temp")))
    with pytest.raises(Exception, match="broken row"):
        county_files.write_county_files(broken, str(tmp_path / "out"), "hourly", SCHEMA, rows_a_file=50)
    assert {n: (out / n).read_bytes() for n in names(out)} == before


def test_only_what_succeeded_is_published(tmp_path):
    """A task's second attempt counts, the first one's files go; an appended run leaves the files that are there."""
    import pyarrow as pa

    batch = lambda *counties: iter([pa.record_batch({"county": list(counties), "v": list(range(len(counties)))})])
    writer = county_files.CountyWriter({"path": str(tmp_path), "metadata": '{"a": "b"}'}, overwrite=True)
    writer.write(batch("x", "x", "y"))
    writer.commit([writer.write(batch("x", "x", "y")), None, writer.write(batch("y", None))])
    assert names(tmp_path) == ["unknown.parquet", "x.parquet", "y-0001.parquet", "y-0002.parquet"] and parquet.read_table(tmp_path / "x.parquet").num_rows == 2
    more = county_files.CountyWriter({"path": str(tmp_path)}, overwrite=False)
    more.commit([more.write(batch("x"))])
    assert len(names(tmp_path)) == 5 and sum(parquet.read_metadata(tmp_path / n).num_rows for n in names(tmp_path)) == 6
    gone = county_files.CountyWriter({"path": str(tmp_path)}, overwrite=True)
    gone.abort([gone.write(batch("z")), None])
    assert len(names(tmp_path)) == 5
