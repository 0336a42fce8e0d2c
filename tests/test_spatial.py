import math

import pytest
from pyspark.sql import functions as F

from isohyet.functions import crs
from isohyet.operators import spatial


def test_published_places(spark):
    """A worked example of the British grid on its own datum, lengths of the meridian, poles and edges of Mollweide."""
    lat, lon = 52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600
    grid, north = crs.project(crs.BRITISH_GRID, F.lit(lat), F.lit(lon)), crs.project(crs.utm(31), F.lit(60.0), F.lit(3.0))
    moll = [crs.mollweide(F.lit(a), F.lit(b)) for a, b in ((0.0, 90.0), (90.0, 10.0), (-90.0, 0.0), (0.0, 0.0))]
    shift = crs.british_grid(F.lit(52.657977), F.lit(1.716038))  # the same place on WGS84
    r = spark.range(1).select(*grid, *north, *[c for p in moll for c in p], *shift).first()
    assert r[0] == pytest.approx(651_409.903, abs=0.01) and r[1] == pytest.approx(313_177.270, abs=0.01)
    assert r[2] == pytest.approx(500_000, abs=1e-6) and r[3] == pytest.approx(6_651_411.190, abs=0.01)
    edge = math.sqrt(2) * 6_378_137
    assert r[4:12] == pytest.approx((edge, 0, 0, edge, 0, -edge, 0, 0), abs=1e-3)
    assert abs(r[12] - 651_409.9) < 10 and abs(r[13] - 313_177.3) < 10


def test_mollweide_keeps_areas(spark):
    df = spark.createDataFrame([(a, b) for a in (-89.9, -60.0, 5.0, 45.0, 85.0, 89.999) for b in (-179.0, 3.0)], "lat double, lon double")
    for r in df.select("lat", "lon", *[c.alias(n) for n, c in zip("xy", crs.mollweide(F.col("lat"), F.col("lon")))]).collect():
        t = math.asin(r.y / (math.sqrt(2) * 6_378_137))
        assert math.degrees(math.asin(min(1, max(-1, (2 * t + math.sin(2 * t)) / math.pi)))) == pytest.approx(r.lat, abs=1e-5)


def test_shapes_meet_rings(spark):
    p = lambda *xy: [{"lat": a, "lon": b} for a, b in xy]
    square = [(51.9, -1.6), (51.9, -1.4), (52.1, -1.4), (52.1, -1.6), (51.9, -1.6)]
    far = [(52.3, -1.5), (52.3, -1.4), (52.4, -1.4)]
    rows = [("around", "a", "polygon", p(*square)), ("runway", "b", "line", p((52.01, -1.6), (52.01, -1.4))), ("outline", "c", "line", p(*square)), ("pole", "d", "point", p((52.0, -1.5))), ("far", "e", "polygon", p(*far)), ("none", "f", "line", [])]
    features = spark.createDataFrame(rows, "feature string, kind string, shape string, points array<struct<lat:double,lon:double>>")
    centres = spark.createDataFrame([(1, 52.0, -1.5), (2, 10.0, 10.0)], "centre int, lat double, lon double")
    got = {(r.centre, r.ring_m): (r.n, r.features) for r in spatial.ring_hits(centres, features, [500.0, 2000.0, 10000.0]).collect()}
    assert got[1, 500.0] == (2, "around:a;pole:d") and got[1, 2000.0] == (3, "around:a;pole:d;runway:b")
    assert got[1, 10000.0] == (4, "around:a;outline:c;pole:d;runway:b") and got[2, 10000.0] == (0, None)


def test_population_of_a_ring(spark):
    half = [{"lat": a, "lon": b} for a, b in ((51.0, -1.5), (53.0, -1.5), (53.0, 0.5), (51.0, 0.5))]
    units = spark.createDataFrame([("u", 1000.0, half)], "code string, population double, points array<struct<lat:double,lon:double>>")
    centres = spark.createDataFrame([(1, 52.0, -1.5), (2, 40.0, -1.5)], "centre int, lat double, lon double")
    got = {r.centre: (r.population, r.covered_m2, r.n_units) for r in spatial.ring_population(centres, units).collect()}
    area = spatial.ring_areas(centres, units, 10_000).first().area_m2
    assert got[1][1] == pytest.approx(math.pi * 1e8 / 2, rel=1e-9) and got[1][0] == pytest.approx(1000 * math.pi * 1e8 / 2 / area) and got[2] == (0, 0, 0)
    with pytest.raises(ValueError, match="coarser"):
        spatial.ring_population(centres, units, 2_000)


def test_plane_keeps_distances(spark):
    """A degree of longitude and of latitude on the ellipsoid at 52 degrees, to a metre."""
    from isohyet.functions import geo

    x, y = geo.to_plane(F.lit(52.0), F.lit(-1.5), F.lit(52.01), F.lit(-1.49))
    r = spark.range(1).select(x, y).first()
    assert r[0] == pytest.approx(686.77, abs=1) and r[1] == pytest.approx(1112.66, abs=1)


def test_wide_shapes_take_few_cells(spark):
    """Boxes from a point to a continent: few rows each before the join, and every centre within reach is found."""
    import random

    rng = random.Random(7)
    box = lambda y, x, h, w: [{"lat": a, "lon": b} for a, b in ((y, x), (y, x + w), (y + h, x + w), (y + h, x))]
    shapes = [(k, "k", "polygon", box(rng.uniform(-60, 50), rng.uniform(-170, 120), *(rng.choice((0.0, 0.01, 0.3, 2.0, 10.0, 30.0)) for _ in range(2)))) for k in range(60)]
    features = spark.createDataFrame(shapes, "feature int, kind string, shape string, points array<struct<lat:double,lon:double>>")
    centres = spark.createDataFrame([(i, rng.uniform(-60, 70), rng.uniform(-170, 150)) for i in range(300)], "centre int, lat double, lon double")
    got = {(r.centre, r.feature) for r in spatial.near_features(centres, features, 30.0).select("centre", "feature").distinct().collect()}
    for i, lat, lon in [tuple(r) for r in centres.collect()]:
        for k, _, _, points in shapes:
            low, high = points[0], points[2]
            dlat, dlon = max(low["lat"] - lat, lat - high["lat"], 0), max(low["lon"] - lon, lon - high["lon"], 0)
            if math.hypot(dlat, dlon * math.cos(math.radians(lat))) * 111.2 <= 29:
                assert (i, k) in got
    wide = spark.createDataFrame([(1, "k", "polygon", box(45.0, -5.0, 10.0, 10.0))], features.schema)
    many = spark.createDataFrame([(i, 45 + i % 100 / 10, -5 + i // 100 / 10) for i in range(10_000)], "centre int, lat double, lon double")
    assert spatial.near_features(many, wide, 10.0).count() == 10_000
    with_size = spatial._around(wide.selectExpr("feature", "0 AS cell_size"), F.lit(45.0), F.lit(55.0), F.lit(-5.0), F.lit(5.0), F.lit(spatial._band(10.0) * 2**7))
    assert with_size.count() < 100
