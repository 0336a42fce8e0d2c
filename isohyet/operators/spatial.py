"""Rings and features: an equi-join on grid cells with exact predicates, hits, areas and populations of rings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions.geo import EARTH_KM, bind, ring_edges, rings_area, rings_in_circle, to_plane
from isohyet.functions.polygons import repaired
from isohyet.session import ship_package

#: The one ring that census units may be apportioned to, and the counties without open boundaries.
CENSUS_RING_M = 10_000
NORTHERN_IRELAND = ("antrim", "armagh", "down", "fermanagh", "londonderry", "tyrone")
SCOTLAND = (
    "aberdeenshire", "angus", "argyll-in-highland-region", "argyll-in-strathclyde-region", "ayrshire", "banffshire", "berwickshire", "buteshire", "caithness", "dumfriesshire",
    "dunbartonshire", "east-lothian", "fife", "inverness-shire", "kincardineshire", "kinross-shire", "kirkcudbrightshire", "lanarkshire", "midlothian-in-lothian-region",
    "moray-in-grampian-region", "moray-in-highland-region", "nairnshire", "orkney", "peebleshire", "perthshire-in-central-region", "perthshire-in-tayside-region", "renfrewshire",
    "ross-and-cromarty", "roxburghshire", "selkirkshire", "shetland", "stirling-in-central-region", "sutherland", "west-lothian-in-lothian-region", "western-isles", "wigtownshire",
)


def _band(km: float) -> float:
    """Degrees of latitude that a reach takes, with a little room."""
    return math.degrees(km / EARTH_KM) * 1.001


def _width(band: float | Column, i: Column) -> Column:
    """Degrees of longitude of a cell of band i: what the reach takes at the band's poleward edge."""
    return band / F.greatest(F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(i * band), F.abs((i + 1) * band))))), F.lit(1e-3))


def with_cell(points: DataFrame, lat: str, lon: str, km: float, i: str = "cell_i", j: str = "cell_j") -> DataFrame:
    """points with the cell (i, j) that holds them."""
    band = _band(km)
    return points.withColumn(i, F.floor(F.col(lat) / band)).withColumn(j, F.floor(F.col(lon) / _width(band, F.col(i))))


def with_cells_around(boxes: DataFrame, lat0: Column, lat1: Column, lon0: Column, lon1: Column, km: float, i: str = "cell_i", j: str = "cell_j") -> DataFrame:
    """boxes once for every cell that holds points within a distance of them: about nine for a point, and a box's own cells more.

    Boxes across the 180th meridian or around a pole are not sought there.
    """
    return _around(boxes, lat0, lat1, lon0, lon1, F.lit(_band(km)), i, j)


def _around(boxes: DataFrame, lat0: Column, lat1: Column, lon0: Column, lon1: Column, band: Column, i: str = "cell_i", j: str = "cell_j") -> DataFrame:
    rows = boxes.withColumn(i, F.explode(F.sequence(F.floor(lat0 / band) - 1, F.floor(lat1 / band) + 1)))
    # seen from the next band, a reach spans at most two of its cells
    width = _width(band, F.col(i))
    return rows.withColumn(j, F.explode(F.sequence(F.floor(lon0 / width) - 2, F.floor(lon1 / width) + 2)))


def near_features(centres: DataFrame, features: DataFrame, km: float) -> DataFrame:
    """centres (centre, lat, lon) beside the features (points array<struct<lat, lon>>, or rings, an array of those; other columns) that may be within a distance.

    A feature goes to the cells of the size of its own box, twice or four times the reach and so on, so that one of any extent is in some
    twenty cells; a centre is in one cell of every size.
    """
    if "rings" not in features.columns:
        features = features.withColumn("rings", F.array("points")).drop("points")
    band = _band(km)
    sizes = range(math.ceil(math.log2(360 / band)) + 1)
    of = lambda name, pick: pick(F.transform(F.flatten("rings"), lambda p: p[name]))
    box = F.struct(*[of(name, pick).alias(f"{name}{i}") for name in ("lat", "lon") for i, pick in enumerate((F.array_min, F.array_max))])
    f = features.where(F.size(F.flatten("rings")) > 0).withColumn("box", box)
    nearest = F.when((F.col("box.lat0") <= 0) & (F.col("box.lat1") >= 0), 0.0).otherwise(F.least(F.abs("box.lat0"), F.abs("box.lat1")))
    cells = F.greatest(F.col("box.lat1") - F.col("box.lat0"), (F.col("box.lon1") - F.col("box.lon0")) * F.cos(F.radians(nearest))) / band
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(cells, F.lit(1.0))))).cast("int")
    f = f.withColumn("cell_size", F.least(size, F.lit(sizes[-1])))
    f = _around(f, *[F.col(f"box.{c}") for c in ("lat0", "lat1", "lon0", "lon1")], F.lit(band) * F.pow(F.lit(2.0), "cell_size")).drop("box")
    c = centres.select("centre", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.explode(F.array(*map(F.lit, sizes))).alias("cell_size"))
    wide = F.lit(band) * F.pow(F.lit(2.0), "cell_size")
    c = c.withColumn("cell_i", F.floor(F.col("lat0") / wide)).withColumn("cell_j", F.floor(F.col("lon0") / _width(wide, F.col("cell_i"))))
    return c.join(f, ["cell_size", "cell_i", "cell_j"]).drop("cell_size", "cell_i", "cell_j")


def _local(joined: DataFrame, closed: Column | None = None) -> DataFrame:
    """Adds local: the rings in metres around the centre, without repeated last points where they are closed."""
    flat = lambda p: F.struct(*[c.alias(n) for n, c in zip("xy", to_plane(F.col("lat0"), F.col("lon0"), p["lat"], p["lon"]), strict=True)])
    open_ = lambda ring: F.when((F.size(ring) > 1) & (F.lit(True) if closed is None else closed) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    return joined.withColumn("local", F.transform("rings", lambda ring: F.transform(open_(ring), flat)))


def _edges(shape: Column, rings: Column) -> Column:
    """Edges (ax, ay, bx, by) of all rings: closed ones for polygons, a point's edge from itself to itself."""

    def edges(points: Column) -> Column:
        around = ring_edges(points)
        return F.when((shape == "polygon") | (F.size(points) == 1), around).otherwise(F.slice(around, 1, F.greatest(F.size(points) - 1, F.lit(0))))

    return F.flatten(F.transform(rings, edges))


def distance_m(shape: Column, rings: Column) -> Column:
    """Metres from the origin to a shape of the plane: 0 within a polygon, by the even-odd rule over all its rings."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        t = F.coalesce(F.try_divide(-(e["ax"] * dx + e["ay"] * dy), dx * dx + dy * dy), F.lit(0.0))
        at = lambda t: F.hypot(e["ax"] + t * dx, e["ay"] + t * dy)
        return bind(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), at)

    crosses = lambda e: ((e["ay"] > 0) != (e["by"] > 0)) & (F.coalesce(e["ax"] - e["ay"] * F.try_divide(e["bx"] - e["ax"], e["by"] - e["ay"]), F.lit(-1.0)) > 0)
    edges = _edges(shape, rings)
    inside = (shape == "polygon") & F.aggregate(edges, F.lit(False), lambda s, e: s != crosses(e))
    return F.when(inside, F.lit(0.0)).otherwise(F.array_min(F.transform(edges, to_edge)))


def ring_hits(centres: DataFrame, features: DataFrame, radii_m: list[float]) -> DataFrame:
    """(centre, ring_m, n, features): shapes that a ring meets, as 'id:kind' joined by ';'; rings without hits stay.

    features: (feature, kind, shape point, line or polygon, points or rings). The plane around a centre keeps distances to 0.1 % up to some
    60 km, to 0.5 % at 150 km.
    """
    joined = _local(near_features(centres, features, max(radii_m) / 1000), F.col("shape") == "polygon")
    found = joined.withColumn("distance", distance_m(F.col("shape"), F.col("local"))).where(F.col("distance") <= max(radii_m))
    hits = found.select("centre", "feature", "kind", "distance", F.explode(F.array(*map(F.lit, radii_m))).alias("ring_m")).where(F.col("distance") <= F.col("ring_m"))
    listed = F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", F.col("feature").cast("string"), "kind"))), ";")
    lists = hits.groupBy("centre", "ring_m").agg(F.count_distinct("feature").alias("n"), listed.alias("features"))
    rings = centres.select("centre").withColumn("ring_m", F.explode(F.array(*map(F.lit, radii_m))))
    return rings.join(lists, ["centre", "ring_m"], "left").select("centre", "ring_m", F.coalesce("n", F.lit(0)).alias("n"), "features")


def ring_areas(centres: DataFrame, polygons: DataFrame, ring_m: float) -> DataFrame:
    """centre beside every polygon (its columns but points or rings) with area_m2 and inter_m2, its part within the ring, where there is any.

    rings: parts run against the clock and holes with it, as the readers and repair() leave them.
    """
    joined = _local(near_features(centres, polygons, ring_m / 1000))
    areas = joined.withColumns({"area_m2": rings_area(F.col("local")), "inter_m2": rings_in_circle(F.col("local"), F.lit(float(ring_m)))})
    return areas.where((F.col("area_m2") > 0) & (F.col("inter_m2") > 1e-6)).drop("rings", "local", "lat0", "lon0")


def repair(polygons: DataFrame) -> DataFrame:
    """polygons with rings (array<array<struct<lat, lon>>>, or points of a single one) made valid: the inside stays what the even-odd rule says.

    Bow-ties, spikes, points in a row that are one, rings that touch or overlap become simple rings, parts against the clock and holes with it;
    what has no inside has no rings. Null rings count as none.
    """
    ship_package(polygons.sparkSession)
    if "rings" not in polygons.columns:
        polygons = polygons.withColumn("rings", F.array("points")).drop("points")

    @F.arrow_udf("array<array<struct<lat:double,lon:double>>>")
    def valid(rings: pa.Array) -> pa.Array:
        out = []
        for polygon in rings.to_pylist():
            given = [np.array([(p["lon"], p["lat"]) for p in ring if p and p["lat"] is not None and p["lon"] is not None]).reshape(-1, 2) for ring in polygon or [] if ring]
            out.append([[{"lat": y, "lon": x} for x, y in ring.tolist()] for ring in repaired(given)])
        return pa.array(out, pa.list_(pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))))

    return polygons.withColumn("rings", valid("rings"))


def ring_population(centres: DataFrame, units: DataFrame, ring_m: float = CENSUS_RING_M, whole: bool = False) -> DataFrame:
    """(centre, population, covered_m2, n_units): populations (units: code, population, points or rings) by share of area within the ring.

    whole: units aren't shared out; one counts with all of its population and area where at least half of it lies within.
    """
    if ring_m != CENSUS_RING_M:
        raise ValueError(f"census units are coarser than a ring of {ring_m} m: only {CENSUS_RING_M} m can be apportioned")
    parts = ring_areas(centres, units, ring_m)
    if whole:
        parts = parts.where(2 * F.col("inter_m2") >= F.col("area_m2")).withColumn("inter_m2", F.col("area_m2"))
    sums = parts.groupBy("centre").agg(F.sum(F.col("population") * F.col("inter_m2") / F.col("area_m2")).alias("population"), F.sum("inter_m2").alias("covered_m2"), F.count(F.lit(1)).alias("n_units"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("population", "covered_m2", "n_units")]
    return centres.select("centre").join(sums, "centre", "left").select("centre", *filled)


def census_reason(county: Column, year: Column) -> Column:
    """Why a station has no census density for a year (null: before any open census); null if it may have one."""
    return (
        F.when(year.isNull(), "no-open-census-pre-1981")
        .when(county.isin(*SCOTLAND), "no-census-boundaries-scotland")
        .when(county.isin(*NORTHERN_IRELAND), "no-census-boundaries-northern-ireland")
    )
