"""Queries on tables that show what only shows at size: keys of many digits, units on a ring's edge, sums in any order."""

import pytest
from pyspark.sql import functions as F

from isohyet.operators import analysis, entity, homogenise, rings, spatial
from isohyet.plans import registry
from isohyet.plans.tables import rounded
from tests.oracle import connect, rows_of_duckdb, rows_of_spark

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation supplier part lineitem events documents embeddings pages benchmark labels conversations customer orders".split()


def tables(spark, folder, **changed):
    """A folder of the smallest tables, some of them changed."""
    for t in TABLES:
        of = changed[t] if t in changed else spark.read.parquet(f"{SF_DIR}/{t}.parquet")
        of.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def agree(spark, folder, name):
    assert rows_of_spark(registry.queries()[name](spark, folder)) == rows_of_duckdb(connect(folder), registry.oracle_sql()[name])


@pytest.fixture(scope="module")
def long_keys(spark, tmp_path_factory):
    """Customers 10,000 to 10,009 and 100,000 to 100,109: the latter begin with the digits of the former."""
    moved = lambda c: F.when(F.col(c) % 12 == 0, 10_000 + F.col(c) % 10).otherwise(100_000 + F.col(c) % 110)
    read = lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet")
    customer = read("customer").withColumn("c_custkey", moved("c_custkey")).dropDuplicates(["c_custkey"])
    return tables(spark, tmp_path_factory.mktemp("long") / "t", customer=customer, orders=read("orders").withColumn("o_custkey", moved("o_custkey")))


@pytest.mark.parametrize("name", ["station_history", "station_spans"])
def test_stations_whose_numbers_have_six_digits(spark, long_keys, name):
    agree(spark, long_keys, name)


def test_units_on_the_edge_count_whole_or_not_at_all(spark):
    centres = spark.createDataFrame([(0, 50.0, 0.0)], "centre long, lat double, lon double")
    edge = 50 + 10_000 / 111_229.0  # the ring's northern latitude
    at = lambda lat, lon: F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    box = lambda y: F.array(at(y, 0.0), at(y, 0.001), at(y + 0.001, 0.001), at(y + 0.001, 0.0))
    ids = spark.range(2).select(F.col("id").alias("code"), F.lit(100.0).alias("population"))
    units = ids.withColumn("points", F.when(F.col("code") == 0, box(edge - 0.0007)).otherwise(box(edge - 0.0003)))
    (shared,), (whole,) = spatial.ring_population(centres, units).collect(), spatial.ring_population(centres, units, whole=True).collect()
    assert shared.n_units == 2 and 50 < shared.population < 150 and shared.population != 100
    assert (whole.n_units, whole.population) == (1, 100.0)


def test_sums_are_added_in_the_order_given(spark):
    rows = [(1, 1e16, 1.0, True), (2, -1e16, 1.0, True), (3, 0.1, 1.0, True)]
    for given in (rows, rows[::-1], [rows[0], rows[2], rows[1]]):
        cells = spark.createDataFrame([("a", *r) for r in given], "k string, nth int, v double, w double, ok boolean").coalesce(1)
        (got,) = rings.gated_mean(cells, ["k"], "v", "w", "ok", order=["nth"]).collect()
        assert got["mean"] == 0.1 / 3
        (got,) = rings.ring_fraction(cells, ["k"], "v", "w", "ok", "w", ["nth"]).collect()
        assert got["built_sum"] == 0.1


def test_rounding_is_that_of_the_sql(spark):
    (got,) = spark.range(1).select(rounded(F.lit(3.23) / F.lit(6.4), 6).alias("x")).collect()
    assert got["x"] == round(3.23 / 6.4 * 1e6) / 1e6


def shared_places(spark, n):
    """Stations of which ten share every place and every name."""
    return spark.range(n).select("id", F.col("id").alias("station"), (50 + (F.col("id") % (n // 10)) * 0.2).alias("lat"), F.lit(0.0).alias("lon"), F.concat(F.lit("n-"), F.col("id") % (n // 10)).alias("name"), (F.col("id") % 3).alias("label"))


def test_pairs_are_of_places_and_put_in_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(entity, "CHUNK", 3)
    p = shared_places(spark, 100)
    got = {(r.a, r.b): r.km for r in entity.neighbours(p, "id", "lat", "lon", 30.0).collect()}
    assert got.keys() == {(a, b) for a in range(100) for b in range(a + 1, 100) if abs(a % 10 - b % 10) <= 1}
    assert all(km == 0 if a % 10 == b % 10 else 22 < km < 23 for (a, b), km in got.items())
    places = entity.placed(p, "id", "lat", "lon").where("id = group")
    assert places.count() == 10 and entity.near_places(places, 30.0).count() == 9


def test_names_that_many_share_are_paired_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(entity, "CHUNK", 3)
    names = {0: "alton", 1: "alton-park", 2: "bray"}
    p = spark.createDataFrame([(i, names[i % 3]) for i in range(30)], "id long, name string")
    got = sorted((r.a, r.b) for r in entity.related_names(p, "id", "name").collect())
    assert got == [(a, b) for a in range(30) for b in range(a + 1, 30) if (a % 3 == 2) == (b % 3 == 2)]


def test_mix_and_clusters_make_no_pair_of_stations(spark):
    p = shared_places(spark, 100)
    pairs = entity.neighbours(p, "id", "lat", "lon", 30.0)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(homogenise.neighbourhood_mix_within(p.select("station", "lat", "lon", "label"), 30.0)) == rows(homogenise.neighbourhood_mix(pairs, p.select("station", "label")))
    for km in (30.0, 10.0):  # one cluster of all places, one of each
        close = entity.neighbours(p, "id", "lat", "lon", km)
        assert rows(entity.near_clusters(p, km, "id", "lat", "lon", "name")) == rows(entity.clusters(p, close, "id", "lat", "lon", "name"))


def test_alike_rows_are_matched_once(spark):
    """The join meets ten places with two controls each, not a hundred stations of either side."""
    p = shared_places(spark, 200).withColumns({"band": F.lit(1), "era": F.lit(None).cast("int")})
    found = analysis.matched_controls(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["band"], 30.0, 2, ("era",))
    got = {(r.treated, r.nth): r.control for r in found.collect()}
    want = {}
    for a in range(0, 200, 2):
        near = sorted((abs(a % 20 - b % 20), b) for b in range(1, 200, 2) if abs(a % 20 - b % 20) <= 1)
        want |= {(a, i + 1): b for i, (_, b) in enumerate(near[:2])}
    assert {k: v % 20 in (k[0] % 20 - 1, k[0] % 20 + 1) for k, v in got.items()} == dict.fromkeys(want, True)
    assert "__first" in found._jdf.queryExecution().optimizedPlan().toString()


def test_cells_of_a_task_do_not_grow_with_stations(spark, monkeypatch):
    """Stations in one file are dealt to tasks by their cells, and sums by station need no other exchange."""
    monkeypatch.setattr(rings, "CELLS_A_TASK", 10_000)
    s = spark.range(0, 400, 1, 1).selectExpr("id AS src_id", "id * 37 % 900 + 0.5 AS x", "id * 53 % 800 + 0.25 AS y")
    w = rings.cell_weights(s, [500.0], 100.0)  # 144 cells each at most
    held = w.groupBy(F.spark_partition_id()).agg(F.countDistinct("src_id").alias("n")).collect()
    assert len(held) == 6 and sum(r.n for r in held) == 400 and max(r.n for r in held) < 120
    sums = w.groupBy("src_id", "ring_m", "row").agg(F.sum("w").alias("w"))
    assert sums._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    area = {r.src_id: r.w for r in sums.groupBy("src_id").agg(F.sum("w").alias("w")).collect()}
    assert len(area) == 400 and all(v == pytest.approx(3.141592653589793 * 25) for v in area.values())
