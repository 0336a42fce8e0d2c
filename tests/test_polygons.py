import json
import math

import numpy as np
import pytest

from isohyet.functions import polygons
from isohyet.operators import features, spatial
from isohyet.sources import inventory


def square(x, y, h):
    return np.array([[x, y], [x + h, y], [x + h, y + h], [x, y + h]], float)


def areas(rings):
    return sorted(round(polygons.signed_area(r), 9) for r in polygons.repaired(rings))


def test_known_repairs():
    assert areas([square(0, 0, 1)[::-1]]) == [1.0]
    assert areas([np.array([[0, 0], [1, 1], [1, 0], [0, 1]])]) == [0.25, 0.25]
    assert areas([np.array([[0, 0], [0, 0], [1, 0], [1, 0.5], [3, 0.5], [1, 0.5], [1, 1], [0, 1]])]) == [1.0]
    assert areas([square(0, 0, 4), square(1, 1, 1)]) == [-1.0, 16.0]
    assert areas([square(0, 0, 4), square(0, 1, 1)]) == [15.0]
    assert areas([square(0, 0, 4), np.array([[0, 0], [2, 1], [1, 2]])]) == [-1.5, 16.0]
    assert areas([square(0, 0, 2), square(0, 0, 2)]) == [] == areas([np.array([[0, 0], [1, 0]])]) == areas([])
    assert areas([square(0, 0, 1), square(1, 0, 1)]) == [2.0]
    assert areas([square(0, 0, 9), square(1, 1, 6), square(2, 2, 2), square(20, 0, 1)]) == [-36.0, 1.0, 4.0, 81.0]
    turn = np.arange(5) * 4 * np.pi / 5
    assert len(areas([np.stack([np.cos(turn), np.sin(turn)], 1)])) == 5


def inside(rings, at):
    out = np.zeros(len(at), bool)
    for r in rings:
        for (x0, y0), (x1, y1) in zip(r, np.roll(r, -1, 0), strict=True):
            if y0 != y1:
                out ^= ((y0 > at[:, 1]) != (y1 > at[:, 1])) & (at[:, 0] < x0 + (at[:, 1] - y0) * (x1 - x0) / (y1 - y0))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_random_polygons_keep_their_inside(seed):
    """Corners on a lattice, which touch and overlap a lot, and anywhere: the same points are inside, rings are simple."""
    rng = np.random.default_rng(seed)
    made = [rng.integers(0, 8, (rng.integers(3, 9), 2)).astype(float) if seed % 2 else rng.random((rng.integers(3, 9), 2)) * 8 for _ in range(rng.integers(1, 3))]
    out = polygons.repaired(made)
    at = (np.indices((150, 150)).reshape(2, -1).T + [0.5037, 0.5211]) / 150 * 8
    assert (inside(made, at) == inside(out, at)).all()
    assert all(len(np.unique(r.round(9), axis=0)) == len(r) >= 3 for r in out)
    assert sum(map(polygons.signed_area, out)) == pytest.approx(inside(made, at).mean() * 64, abs=0.6)
    again = polygons.repaired(out)
    assert sorted(polygons.signed_area(r) for r in again) == pytest.approx(sorted(polygons.signed_area(r) for r in out))


def test_readers_feed_populations(spark, tmp_path):
    """The same unit, with a lake and an island, from GeoJSON, Esri and Overpass pages."""
    land, lake, island = ([[x - 0.3, y - 0.3], [x + 0.3, y - 0.3], [x + 0.3, y + 0.3], [x - 0.3, y + 0.3]] for x, y in ((-1.5, 52.0),) * 3)
    lake, island = ([[-1.5 + (x + 1.5) * f, 52 + (y - 52) * f] for x, y in ring] for f, ring in ((0.1, lake), (0.02, island)))
    closed = lambda ring: [*ring, ring[0]]
    geo = {"features": [
        {"properties": {"n": 1000}, "geometry": {"type": "MultiPolygon", "coordinates": [[closed(land), closed(lake)], [closed(island[::-1])]]}},
        {"properties": {"n": 5}, "geometry": {"type": "Polygon", "coordinates": [closed(island)]}},
        {"properties": {"n": 7}, "geometry": {"type": "LineString", "coordinates": island}},
        {"properties": {"n": 8}, "geometry": None}, {"properties": {"n": 9}, "geometry": {"type": "Polygon", "coordinates": "none"}},
    ]}
    (tmp_path / "geo.json").write_text(json.dumps(geo))
    (tmp_path / "esri.json").write_text(json.dumps({"features": [{"attributes": {"n": 1000}, "geometry": {"rings": [land[::-1], lake, island[::-1]]}}]}))
    way = lambda ring: {"type": "way", "geometry": [{"lat": y, "lon": x} for x, y in ring]}
    members = [way(closed(lake)), way(land[:3]), way([land[0], land[3], land[2]]), way(closed(island))]
    (tmp_path / "page.json").write_text(json.dumps({"elements": [{"type": "relation", "id": 1, "tags": {"aeroway": "apron"}, "members": members}]}))
    centres = spark.createDataFrame([(1, 52.0, -1.5)], "centre int, lat double, lon double")
    read = inventory.geometry(inventory.features(spark, str(tmp_path / "geo.json"))).selectExpr("double(properties['n']) AS population", "shape", "rings")
    assert {r.population: (r["shape"], r.rings and len(r.rings)) for r in read.collect()} == {1000: ("polygon", 3), 5: ("polygon", 1), 7: ("line", 1), 8: (None, None), 9: (None, None)}
    relation = features.assemble(inventory.relation_members(spark, str(tmp_path / "page.json")).drop("kind")).where("shape = 'polygon'").groupBy("feature").agg({"points": "collect_list"}).toDF("feature", "rings")
    units = {"geo": read.where("population = 1000"), "esri": inventory.esri_pages(spark, str(tmp_path / "esri.json")), "overpass": spatial.repair(relation)}
    box = lambda f: (0.6 * f) ** 2
    plain = spatial.ring_areas(centres, spark.createDataFrame([([{"lat": b, "lon": a} for a, b in land],)], "points array<struct<lat:double,lon:double>>"), 10_000.0).first().area_m2
    degree2 = plain / box(1)
    want = math.pi * 1e8 - degree2 * (box(0.1) - box(0.02))
    for name, unit in units.items():
        unit = unit.selectExpr("1000D AS population", "rings")
        (got,) = spatial.ring_population(centres, unit).collect()
        assert got.covered_m2 == pytest.approx(want, rel=1e-9) and got.n_units == 1, name
        assert got.population == pytest.approx(1000 * want / (plain - degree2 * (box(0.1) - box(0.02))), rel=1e-9), name
    hits = spatial.ring_hits(centres, read.where("shape IS NOT NULL").selectExpr("population AS feature", "'k' AS kind", "shape", "rings"), [100.0, 3_000.0])
    assert {r.ring_m: r.features for r in hits.collect()} == {100.0: "1000.0:k;5.0:k", 3_000.0: "1000.0:k;5.0:k;7.0:k"}


def test_repair_of_missing_parts(spark):
    rows = [(1, None), (2, []), (3, [[]]), (4, [[{"lat": 0.0, "lon": 0.0}, {"lat": None, "lon": 1.0}, {"lat": 0.0, "lon": 2.0}, {"lat": 2.0, "lon": 0.0}]])]
    df = spark.createDataFrame(rows, "id int, rings array<array<struct<lat:double,lon:double>>>")
    assert {r.id: [len(x) for x in r.rings] for r in spatial.repair(df).collect()} == {1: [], 2: [], 3: [], 4: [3]}


def test_ways_meet_at_either_end(spark):
    at = lambda *xy: [{"lat": float(a), "lon": float(b)} for a, b in xy]
    df = spark.createDataFrame([("r", 1, at((0, 0), (0, 1))), ("r", 2, at((0, 0), (1, 0))), ("r", 3, at((2, 0), (1, 0)))], "feature string, way int, points array<struct<lat:double,lon:double>>")
    (line,) = features.assemble(df).collect()
    assert line["shape"] == "line" and [tuple(p) for p in line.points] == [(2, 0), (1, 0), (0, 0), (0, 1)]
