"""Header scans and vectorised bodies against the plain way, bytes read, filters planned with."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from isohyet.sources import selfdesc, station_headers, vectorised
from tests.test_selfdesc import BODY, HEAD, tree, write

TOKENS = [
    "", "NA", " NA ", "5", " 7 ", "+5", "-0", "007", "300.0", "300.5", "-9223372036854775808", "9223372036854775807", "9223372036854775808", "9223372036854775808.0", "1e3", "1E30", "-1e30", ".5", "5.", "+.5e1", "1e-400", "1e39", "3.4e38", "inf", "-inf",
    "NaN", "nan", "0x1p3", "1_000", "5f", "5d", "/", "&", "abc", "1995-01-01 00:00:00", "1995-1-1 0:0:0", "1995-02-30 00:00:00", "1995-01-01 24:00:00", "1995-01-01 00:00:60", "2023-02-29 00:00:00", "2024-02-29 23:59:59", "1995-01-01", "0.1", "16777217", "123456789.123", "١", " 5",
]


def both(spark, raw):
    files = selfdesc.scan(spark, str(raw)).cache()
    parsed = selfdesc.split_files(files)
    return files, parsed, selfdesc.dataset_schema(parsed)


def test_every_token_as_the_plain_way(spark, tmp_path):
    """Each token in an int, a float, a time and a text column, alone among tokens that a cast takes and among those that it refuses."""
    head = "Conventions,G,BADC-CSV\ncollection_version_number,G,1\ntype,a,int\ntype,b,float\ntype,c,char\ncoordinate_variable,c,t\ntype,src_id,int\n"
    for i, token in enumerate(TOKENS):
        lines = "\n".join(f"{x},{x},{x},{x},{x}" for x in ("1", token, "2"))
        write(tmp_path, "ayr", f"{i:05d}_a", 1995, head + "data\na,b,c,src_id,text\n" + lines + "\nend data\n")
    write(tmp_path, "bute", "00099_all", 1996, head + "data\na,b,c,src_id,text\n" + "\n".join(f"{x},{x},{x},{x},{x}" for x in TOKENS) + "\nend data\n")
    files, parsed, schema = both(spark, tmp_path)
    key = lambda r: repr(r)
    plain, fast = selfdesc.typed_rows(parsed, schema), vectorised.rows(files, schema)
    assert fast.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(key, fast.collect())) == sorted(map(key, plain.collect()))
    columns = ["county", "path", "col", "na", "empty", "coerced", "mismatched"]
    assert sorted(map(key, vectorised.tallies(files, schema).select(columns).collect())) == sorted(map(key, selfdesc.cell_tallies(parsed, schema).select(columns).collect()))


def test_whole_trees_and_errors_as_the_plain_way(spark, tmp_path):
    tree(tmp_path, release="2")
    good = HEAD.format(v="1", t="int")
    write(tmp_path, "dyfed", "nameless", 1999, good + BODY.format(rows="1999-01-01 00:00:00,1,5,0,NA"))
    write(tmp_path, "dyfed", "00040_d", 1999, good)
    write(tmp_path, "dyfed", "00041_d", 1999, good + "data\n")
    write(tmp_path, "dyfed", "00042_d", 1999, good + BODY.format(rows="1999-01-01 00:00:00,1,5,0"))
    write(tmp_path, "dyfed", "00043_d", 1999, good.replace("\n", "\r\n") + BODY.format(rows=' 1999-01-01 00:00:00 ,43, 5 ,"0,NA\n   \n1999-01-01 01:00:00,43,NA,,é"').replace("\n", "\r\n"))
    write(tmp_path, "dyfed", "00044_d", 1999, good + "data\nob_time,src_id\nend data\n")
    files, parsed, schema = both(spark, tmp_path)
    assert sorted(map(repr, vectorised.rows(files, schema).collect())) == sorted(map(repr, selfdesc.typed_rows(parsed, schema).collect()))
    errors = {r.path: r.error for r in parsed.where("error IS NOT NULL").collect()}
    assert {r.path: r.error for r in vectorised.tallies(files, schema).where("error IS NOT NULL").select("path", "error").collect()} == errors and len(errors) == 6
    heads = {"file:" + r.path: (r.header, r.columns, r.error) for r in station_headers.headers(spark, str(tmp_path)).collect()}
    late = ("no 'end data' line", "row of another number of fields")
    for r in parsed.collect():
        assert heads[r.path] == (r.header, r.columns, None if r.error in late else r.error), r.path
    # a file that ends too soon has a sound header, which counts for the schema
    assert selfdesc.dataset_schema(station_headers.headers(spark, str(tmp_path))) == schema


def big_tree(root, files=6):
    rng = random.Random(3)
    for i in range(files):
        rows = "\n".join(f"1995-01-01 00:00:00,{i},{rng.random()},0,NA" for _ in range(12_000))
        write(root, f"county-{i % 3}", f"{i:05d}_x", 1990 + i % 2, HEAD.format(v="1", t="float") + BODY.format(rows=rows))


def test_headers_read_a_small_part(spark, tmp_path):
    big_tree(tmp_path)
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.csv"))
    scan = station_headers.headers(spark, str(tmp_path))
    assert scan.count() == 6 and scan.agg(F.sum("bytes_read")).first()[0] < 0.05 * size


class Counting:
    """A file system that counts what is listed, opened and read."""

    def __init__(self, store):
        self.store, self.listed, self.opened, self.bytes = store, [], [], 0

    def get_file_info(self, selector):
        self.listed.append(selector.base_dir)
        return self.store.get_file_info(selector)

    def open_input_stream(self, path, **how):
        self.opened.append(path)
        stream, counting = self.store.open_input_stream(path, **how), self

        class Stream:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                stream.close()

            def read(self, n):
                data = stream.read(n)
                counting.bytes += len(data)
                return data

        return Stream()


def test_filters_are_planned_with(tmp_path, monkeypatch):
    """Counties and years that filters rule out are neither listed nor opened; other filters are left to Spark."""
    big_tree(tmp_path)
    reader = station_headers.PlanningReader({"path": str(tmp_path)})
    store = Counting(reader._open()[0])
    monkeypatch.setattr(reader, "_open", lambda: (store, str(tmp_path)))
    left = list(reader.pushFilters([EqualTo(("county",), "county-1"), In(("year",), ("1990", "1995")), GreaterThan(("src_id",), 3), EqualTo(("error",), "x")]))
    assert left == [GreaterThan(("src_id",), 3), EqualTo(("error",), "x")]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["station"] for r in rows] == ["00004_x"] and store.opened == [rows[0]["path"]]
    assert not any("county-0" in x or "county-2" in x for x in store.listed)
    assert store.bytes == rows[0]["bytes_read"] < 0.05 * 12_000 * 40


def test_options_and_pushdown_through_spark(spark, tmp_path):
    big_tree(tmp_path)
    assert {r.station for r in station_headers.headers(spark, str(tmp_path), county="county-2", years=[1991]).collect()} == {"00005_x"}
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = station_headers.headers(spark, str(tmp_path)).where("county = 'county-0' AND year IN ('1991', '1993')")
        assert {r.station for r in got.collect()} == {"00003_x"}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert station_headers.headers(spark, f"{tmp_path}/nowhere").count() == 0


def test_a_header_longer_than_a_read(spark, tmp_path, monkeypatch):
    head = HEAD.format(v="1", t="int") + "".join(f"comments,G,größe {i}\n" for i in range(3_000))
    write(tmp_path, "ayr", "00012_a", 1995, head + BODY.format(rows="1995-01-01 00:00:00,12,5,09,NA\n" * 40_000))
    (r,) = station_headers.headers(spark, str(tmp_path)).collect()
    assert r.error is None and len(r.header) == 3_008 and r.columns[-1] == "mystery" and len(head) < r.bytes_read < len(head.encode()) + 2 * station_headers.CHUNK
    assert json.dumps(r.header[-1], ensure_ascii=False) == '"comments,G,größe 2999"'


@pytest.mark.parametrize("token", ["1", "x"])
def test_no_rows_and_missing_columns(spark, tmp_path, token):
    write(tmp_path, "ayr", "00012_a", 1995, HEAD.format(v="1", t="int") + BODY.format(rows=""))
    write(tmp_path, "ayr", "00013_a", 1995, HEAD.format(v="1", t="int") + f"data\nsrc_id\n{token}\nend data\n")
    files, parsed, schema = both(spark, tmp_path)
    assert sorted(map(repr, vectorised.rows(files, schema).collect())) == sorted(map(repr, selfdesc.typed_rows(parsed, schema).collect()))


def test_integers_of_a_widened_column(spark, tmp_path):
    """A file that declares integers is read as such before it is widened: a fraction has no value there, and is counted."""
    head = "Conventions,G,BADC-CSV\ncollection_version_number,G,1\ntype,src_id,int\n type , x , {t} \n"
    body = "data\nsrc_id,x\n" + "".join(f"1,{t}\n" for t in ("5", "300.5", "16777217", "9223372036854775807", "1e3", "inf", "NA")) + "end data\n"
    for i, t in enumerate(("int", "float")):
        write(tmp_path, "ayr", f"{i:05d}_a", 1995, head.format(t=t) + body)
    files, parsed, schema = both(spark, tmp_path)
    assert schema.types["x"] == "float" and set(schema.widened) == {"x"}
    for rows in (selfdesc.typed_rows(parsed, schema), vectorised.rows(files, schema)):
        got = {s: sorted(r.x for r in rows.where(F.col("src_id") == s).collect() if r.x is not None) for s in (0, 1)}
        assert got == {0: [5.0, 1000.0, 16777216.0, 9.223372036854775807e18], 1: [5.0, 300.5, 1000.0, 16777216.0, 9.223372036854775807e18]}
    for t in (selfdesc.cell_tallies(parsed, schema), vectorised.tallies(files, schema)):
        assert sorted(r.coerced for r in t.where("col = 'x'").collect()) == [1, 2]


def test_first_lines_of_annual_files(spark, tmp_path):
    """40 lines are read of files of 20,000: what parse_annual_headers finds in whole texts."""
    from isohyet.sources import inventory

    for i in range(3):
        head = f"midas_station_id,G,0047{i}\nlocation,G,51.{i}07,-0.36\nheight,G,12{i},m\ndata\n" if i else "comments,G,x\n" * 60 + "midas_station_id,G,9\n"
        folder = tmp_path / f"county/{i}"
        folder.mkdir(parents=True)
        (folder / f"x_199{i}.csv").write_text(head + "1,2,3\n" * 20_000)
        (folder / "notes.txt").write_text("midas_station_id,G,0\n")
    whole = spark.read.text(f"{tmp_path}/county/*/*.csv", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    key = lambda rows: sorted(rows, key=repr)
    got = inventory.annual_headers(spark, f"{tmp_path}/county")
    assert key(tuple(r)[1:] for r in got.collect()) == key(tuple(r)[1:] for r in inventory.parse_annual_headers(whole).collect())
    heads = station_headers.first_lines(spark, str(tmp_path), 40)
    assert heads.count() == 3 and heads.agg(F.max("bytes_read")).first()[0] <= station_headers.CHUNK


def small_files(spark, n, header=lambda i: "", row=lambda i: f"{i},5"):
    head = "Conventions,G,BADC-CSV\ncollection_version_number,G,1\ntype,src_id,int\ntype,x,int\nlong_name,x,a depth,m\n"
    files = [(f"f{i:03d}", f"c{i % 3}", f"{i:05d}_s", i, head + header(i) + f"data\nsrc_id,x\n{row(i)}\nend data\n") for i in range(n)]
    return spark.createDataFrame(files, "path string, county string, station string, src_id long, text string").coalesce(1)


def test_small_files_are_read_together(monkeypatch):
    """One table of a hundred files; a file with a bad row costs some halvings and takes no other file with it, and no token depends on its neighbours."""
    reads, plain = [], vectorised.csv.read_csv
    monkeypatch.setattr(vectorised.csv, "read_csv", lambda *a, **k: reads.append(1) or plain(*a, **k))
    text = "type,x,int\ndata\nsrc_id,x\n{}\nend data\n".replace("type,x,int", "type,x,int")
    values = ["5", "0x10", "﻿5", "1,2", "", "NA", "x", "\n\n7\n   \n8"]
    bodies = [vectorised.Body(text.replace("src_id,x\n", "src_id,x\n").format("\n".join(f"{i},{v}" for v in values[i % 8].strip().split())) if i % 8 == 7 else text.format(f"{i},{values[i % 8]}"), i) for i in range(80)]
    failed = []
    chunks = list(vectorised._chunks(iter(bodies), set(), failed))
    assert [b.src_id for b in failed] == list(range(3, 80, 8)) and {b.error for b in failed} == {"row of another number of fields"}
    got = {}
    for chunk in chunks:
        for of, v in zip(chunk.of, chunk.values("x", "int")[0].to_pylist(), strict=True):
            got.setdefault(chunk.bodies[of].src_id, []).append(v)
    want = [[5], [None], [None], None, [None], [None], [None], [7, 8]]
    assert got == {i: want[i % 8] for i in range(80) if i % 8 != 3}
    reads.clear()
    (chunk,) = vectorised._chunks(iter([vectorised.Body(text.format(f"{i},{i}"), i) for i in range(100)]), set(), [])
    assert len(reads) == 1 and chunk.columns.num_rows == 100


def test_schema_is_made_of_kinds_of_headers(spark):
    """Files that differ in what isn't of the schema are of one kind: two of them stand for a hundred."""
    parsed = selfdesc.split_files(small_files(spark, 100, lambda i: f"comments,G,file {i}\n" + ("type,x,float\nlong_name,x,a depth,ft\n" if i in (40, 60) else "")))
    assert sorted(r.path for r in selfdesc.header_kinds(parsed).collect()) == ["f000", "f040", "f060", "f099"]
    schema = selfdesc.dataset_schema(parsed)
    assert (schema.types["x"], schema.widened["x"], schema.units["x"], schema.releases) == ("float", ("00040_s", "00099_s"), "m", ["1"])
