import json

import pytest
from pyspark.sql import functions as F

from isohyet.functions import coerce
from isohyet.sources import inventory, selfdesc, sinks

HEAD = "Conventions,G,BADC-CSV\ncollection_version_number,G,{v}\ntype,src_id,int\ntype,temp,{t}\nlong_name,temp,air temperature,degC\ntype,ob_time,char\ncoordinate_variable,ob_time,t\ntype,temp_q,int\n"
BODY = "data\nob_time,src_id,temp,temp_q,mystery\n{rows}\n\nend data\n"


def write(root, county, station, year, text):
    d = root / county / station / "qc-version-1"
    d.mkdir(parents=True, exist_ok=True)
    (d / f"x_{year}.csv").write_text(text)


def tree(root, second="float", release="1"):
    write(root, "ayr", "00012_a", 1995, HEAD.format(v="1", t="int") + BODY.format(rows="1995-01-01 00:00:00,12,5,09,NA\n1995-01-01 01:00:00,13,x,,m"))
    write(root, "bute", "00020_b", 1996, HEAD.format(v=release, t=second) + BODY.format(rows="1996-01-01 00:00:00,20,5.5,0,NA"))
    write(root, "bute", "00020_b", 1997, HEAD.format(v="1", t="int") + "no commas\n" + BODY.format(rows="1997-01-01 00:00:00,20,5,0,NA"))
    write(root, "caith", "00030_c", 1997, HEAD.format(v="1", t="int") + BODY.format(rows="1997-01-01 00:00:00,30,5,0,NA").replace("end data\n", ""))
    return selfdesc.split_files


def test_parse_end_to_end(spark, tmp_path):
    tree(tmp_path / "raw", release="2")
    parsed = selfdesc.split_files(selfdesc.scan(spark, str(tmp_path / "raw"))).cache()
    errors = {r.year + r.county: r.error for r in parsed.collect()}
    assert errors["1995ayr"] is None and errors["1996bute"] is None and "three parts" in errors["1997bute"] and "end data" in errors["1997caith"]
    schema = selfdesc.dataset_schema(parsed)
    assert schema.types == {"ob_time": "time", "src_id": "int", "temp": "float", "temp_q": "char", "mystery": "char"}
    assert schema.widened == {"temp": ("00012_a", "00020_b")} and schema.units == {"temp": "degC"} and schema.releases == ["1", "2"]
    rows = selfdesc.typed_rows(parsed, schema)
    got = sorted(((r.src_id, r.collection_version, r.temp, r.temp_q, r.mystery, r.ob_time.timestamp()) for r in rows.collect()), key=repr)
    assert [g[:5] for g in got] == [(12, "1", 5.0, "09", None), (12, "1", None, None, "m"), (20, "2", 5.5, "0", None)]
    assert {g[2] for g in got} == {5.0, None, 5.5} and 788918400.0 in {g[5] for g in got}
    path = sinks.write_counties(rows, str(tmp_path / "out"), "hourly")
    back = spark.read.parquet(path)
    assert back.count() == 3 and {r.county for r in back.select("county").distinct().collect()} == {"ayr", "bute"}
    details = selfdesc.run_details(parsed, schema)
    record = json.loads(selfdesc.run_record(parsed, details, schema, "hourly", 1, "raw").first().record)
    assert record["files_parsed"] == 2 and record["total_rows"] == 3 and record["counties_skipped_all_failed"] == ["caith"] and record["rows_per_county"] == {"ayr": 2, "bute": 1}
    sinks.write_details(details, str(tmp_path / "details"))
    found = [(r.county, r.kind, r.column, r["count"]) for r in spark.read.json(str(tmp_path / "details")).collect()]
    assert [x[2:] for x in found if x[1] == "coercion"] == [("temp", 1)] and [x[2:] for x in found if x[1] == "empty_field"] == [("temp_q", 1)]
    assert sum(x[1] == "failure" for x in found) == 2 and [x[3] for x in found if x[1] == "src_id_mismatch"] == [1] and {x[2] for x in found if x[1] == "undeclared_fallback"} == {"mystery"}
    assert record["findings"]["coercion"] == {"entries": 1, "values": 1} and record["findings"]["failure"]["entries"] == 2


def test_conflict_names_column_and_stations(spark, tmp_path):
    tree(tmp_path, second="char")
    with pytest.raises(ValueError, match="temp.*00012_a.*00020_b|temp.*00020_b.*00012_a"):
        selfdesc.dataset_schema(selfdesc.split_files(selfdesc.scan(spark, str(tmp_path))))


def test_fetch_list_manifest_and_capability(spark, tmp_path):
    listing = spark.createDataFrame([("b", 5, "ayr"), ("a", 3, "ayr"), ("c", 1, "bute")], "path string, size long, county string")
    local = spark.createDataFrame([("a", 3), ("b", 4)], "path string, size long")
    assert [r.path for r in inventory.to_fetch(listing, local).collect()] == ["b", "c"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.bin").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(str(tmp_path / "f"))
    (entry,) = sinks.manifest(files).collect()
    assert entry.name == "x.bin" and entry.digest.startswith("ba7816bf")
    wrong = spark.createDataFrame([("0", "x.bin"), ("1", "gone")], "digest string, name string")
    assert sorted(tuple(r) for r in sinks.verify(files, wrong).collect()) == [("gone", "missing"), ("x.bin", "changed")]
    (tmp_path / "cap.csv").write_text('src_id,G,00471\nobservation_station,G,rothamsted\nhistoric_county_name,G,herts\nlocation,G,51.807,-0.36\nheight,G,128,m\ndate_valid,G,1916,2024\ndata\nid,id_type,met_domain_name,first_year,last_year\n"1,2",DCNN,SYNOP,2013.0,2024\n3,WIND,AWSHRLY,1999,2013\nend data\n')
    r = inventory.capability(spark, str(tmp_path / "cap.csv")).first()
    assert (r.src_id, r["name"], r.lat, r.lon, r.height_m, len(r.rows)) == ("00471", "rothamsted", "51.807", "-0.36", 128.0, 2)
    assert r.rows[0].id == "1,2" and r.rows[0].first_year == 2013


def test_sites_boundaries_and_counts(spark, tmp_path):
    layer = {"features": [{"properties": {"ref_code": 7, "name": "Ash Wood", "hyperlink": " 12 ", "LSOA21CD": "E1", "XCDO": None}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}, {"properties": {"wd91cdo": "01AB", "WD91CD": "E2"}, "geometry": None}]}
    (tmp_path / "layer.json").write_text(json.dumps(layer))
    f = inventory.features(spark, str(tmp_path / "layer.json"))
    assert [r.code for r in f.select(inventory.boundary_code().alias("code")).collect()] == ["E1", "01AB"]
    rows = [tuple(r) for r in inventory.sites({"SSSI": f, "NNR": f}).collect()]
    assert sorted(rows) == sorted([("7", "Ash Wood", "12", d) for d in ("SSSI", "NNR")] + [("", "", "", d) for d in ("SSSI", "NNR")])
    c = spark.createDataFrame([("E1", "5"), ("E2", " "), ("E1", "7")], "GEOGRAPHY_CODE string, OBS_VALUE string").coalesce(1)
    assert [tuple(r) for r in inventory.counts(c).collect()] == [("E1", 7.0)]


def test_provenance_and_reports(spark, tmp_path):
    sinks.write_provenance(spark.range(1), str(tmp_path / "p"), ["1", "2"], {"a": "m"}, {"a": ("x", "y")})
    assert json.loads(spark.read.text(str(tmp_path / "p")).first().value) == {"releases": "1;2", "units": {"a": "m"}, "generator": "isohyet", "widenings": ["a"]}


def test_pages_of_elements_and_boundaries(spark, tmp_path):
    at = lambda *xy: [{"lat": a, "lon": b} for a, b in xy]
    page = {"elements": [
        {"type": "node", "id": 1, "lat": 51.0, "lon": -1.0, "tags": {"aeroway": "aerodrome"}},
        {"type": "node", "id": 2, "lat": 51.0, "lon": -1.0, "tags": {"aeroway": "helipad"}},
        {"type": "way", "id": 3, "tags": {"disused:aeroway": "runway"}, "geometry": at((51, -1), (51, -2))},
        {"type": "way", "id": 4, "tags": {"aeroway": "apron"}, "geometry": at((51, -1), (51, -2), (52, -2), (51, -1))},
        {"type": "way", "id": 5, "tags": {"aeroway": "apron"}, "geometry": at((51, -1))},
        {"type": "relation", "id": 6, "tags": {"aeroway": "aerodrome"}, "members": [{"type": "way", "geometry": at((0, 0), (0, 1), (1, 1))}, {"type": "node"}, {"type": "way", "geometry": at((1, 1), (0, 0))}]},
    ]}
    (tmp_path / "page.json").write_text(json.dumps(page))
    got = {r.feature: (r.kind, r["shape"], len(r.points)) for r in inventory.overpass(spark, str(tmp_path / "page.json")).collect()}
    assert got == {"node/1": ("aerodrome", "point", 1), "way/3": ("disused:runway", "line", 2), "way/4": ("apron", "polygon", 4)}
    from isohyet.operators import features

    (r,) = features.assemble(inventory.relation_members(spark, str(tmp_path / "page.json")).drop("kind")).collect()
    assert (r.feature, r["shape"], len(r.points)) == ("relation/6", "polygon", 4)
    outer, lake = [[-2.0, 51.0], [-2.0, 52.0], [-1.0, 52.0], [-1.0, 51.0]], [[-1.6, 51.4], [-1.4, 51.4], [-1.4, 51.6], [-1.6, 51.6]]
    esri = {"features": [{"attributes": {"code": "E1", "n": 5}, "geometry": {"rings": [outer, lake]}}]}
    (tmp_path / "esri.json").write_text(json.dumps(esri))
    (f,) = inventory.esri_pages(spark, str(tmp_path / "esri.json")).collect()
    assert f.properties == {"code": "E1", "n": "5"} and [[tuple(p) for p in ring] for ring in f.rings] == [[(b, a) for a, b in reversed(ring)] for ring in (outer, lake)]


def test_stamps_of_a_run():
    import datetime

    assert datetime.datetime.fromisoformat(selfdesc.utc_now()).utcoffset() == datetime.timedelta(0)


def small_run(spark, texts):
    files = spark.createDataFrame([(f"f{i}", "ayr", f"{i:05d}_s", "1995", i, t) for i, t in enumerate(texts)], "path string, county string, station string, year string, src_id long, text string")
    parsed = selfdesc.split_files(files).cache()
    return parsed, selfdesc.run_details(parsed, selfdesc.dataset_schema(parsed))


def test_details_shuffle_only_cells_that_something_stands_against(spark):
    """Causes are computed once, behind a generator; what passes the filter on them is counted, other cells go no further."""
    body = "type,a,int\ntype,b,float\ndata\na,b\n{}\nend data\n"
    parsed, details = small_run(spark, [body.format("1,2.5\n2,x\n3,NA\n,y"), *[body.format("1,2.5")] * 20])
    found = sorted((r.file, r.kind, r.column, r["count"]) for r in details.collect())
    assert found == [("f0", "coercion", "b", 2), ("f0", "empty_field", "a", 1)]
    lines = details._jdf.queryExecution().optimizedPlan().toString().split("\n")
    under = next(i for i, x in enumerate(lines) if "Aggregate" in x) + 1
    chain = [x.lstrip(" :+-").split(" ")[0] for x in lines[under:]]
    first = next(x for x in chain if x != "Project")
    assert first == "Filter" and chain[chain.index("Filter") + 1] == "Generate"


def test_lines_are_judged_as_before(spark):
    """Blank lines, spaces, carriage returns and marks in odd places; a column named twice is an error of its file, not of the run."""
    head = "type,a,int\n"
    texts = [
        " type,a,int \r\n  \r\n data \r\n a , b \r\n 1,2 \r\n\r\n 3, \r\n end data \r\n", head + "data\na,a\n1,2\nend data\n", head + "end data\ndata\na\n1\n", "", head + "data\n a\n1\n1,2\nend data", head + "data\na,b,\n1,2,3\n1,2\nend data",
        head + "a,b\ndata\na\n1\nend data", head + "data\n,a\n1,2\nend data", head + "data", "data\nc\nend data", head + "x,y,z,data\ndata\na\ndata\nend data\n2\nend data",
    ]
    parsed, details = small_run(spark, texts)
    got = {int(r.path[1:]): (r.header, r["columns"], r["rows"], r.error) for r in parsed.collect()}
    h, fields = ["type,a,int"], "row of another number of fields"
    assert got == {
        0: (h, ["a", "b"], ["1,2", "3,"], None), 1: (h, ["a", "a"], ["1,2"], "a column is named twice"), 2: ([*h, "end data"], ["a"], None, "header line of fewer than three parts"), 3: (None, None, None, "no 'data' line"),
        4: (h, ["a"], ["1", "1,2"], fields), 5: (h, ["a", "b", ""], ["1,2,3", "1,2"], fields), 6: ([*h, "a,b"], ["a"], ["1"], "header line of fewer than three parts"), 7: (h, ["", "a"], ["1,2"], "no column row"),
        8: (h, None, None, "no column row"), 9: ([], ["c"], [], None), 10: ([*h, "x,y,z,data"], ["a"], ["data"], None),
    }
    errors = {r.file: r.error for r in details.where("kind = 'failure'").collect()}
    assert errors == {f"f{i}": e for i, (*_, e) in got.items() if e}


def test_times_are_those_of_the_format(spark):
    """The look that a time must have refuses no token that the format takes."""
    tokens = [f"{y}-{m}-{d} {t}" for y in ("1995", "0001", "0000", "+1995", "-0001", "12345", "+12345", "995", "2024") for m, d in (("01", "31"), ("02", "29"), ("2", "01"), ("12", "00"), ("13", "01"), ("04", "31"), ("00", "10")) for t in ("00:00:00", "23:59:59", "24:00:00", "12:60:00", "1:00:00", "12:00:60", "12:00", "12:00:00.5")]
    rows = spark.createDataFrame([(t,) for t in [*tokens, " 1995-01-01 00:00:00", "1995-01-01T00:00:00", "\u0661995-01-01 00:00:00", "1995-01-01 00:00:00\n", ""]], "t string")
    at = F.try_to_timestamp("t", F.lit(coerce.TIME_FORMAT)).cast("string")
    assert rows.where(~coerce.utc_time(F.col("t")).cast("string").eqNullSafe(at)).collect() == []
    assert rows.where(coerce.utc_time(F.col("t")).isNotNull()).count() > 4
