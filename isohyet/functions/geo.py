"""Geometry as Column expressions: great-circle distance, the station's plane, areas of polygons within a circle."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Semi-major axis and squared eccentricity of the reference ellipsoid.
SEMI_MAJOR_M, ECCENTRICITY_2 = 6_378_137.0, 0.00669437999014


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def to_plane(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres around (lat0, lon0), from the ellipsoid's radii of curvature: a circle around it stays one."""
    s2 = F.sin(F.radians(lat0)) * F.sin(F.radians(lat0))
    w = F.sqrt(1 - ECCENTRICITY_2 * s2)
    north = SEMI_MAJOR_M * (1 - ECCENTRICITY_2) / (w * w * w)
    east = SEMI_MAJOR_M / w * F.cos(F.radians(lat0))
    return F.radians(lon - lon0) * east, F.radians(lat - lat0) * north


def ring_box(lat: Column, lon: Column, metres: Column, pad: float = 1.05) -> Column:
    """(south, west, north, east) around a ring, padded by a factor."""
    dlat = F.degrees(metres * pad / (EARTH_KM * 1000))
    dlon = dlat / F.greatest(F.cos(F.radians(lat)), F.lit(1e-3))
    return F.struct((lat - dlat).alias("south"), (lon - dlon).alias("west"), (lat + dlat).alias("north"), (lon + dlon).alias("east"))


def coordinate_precision_m(lat: Column, lat_places: Column, lon_places: Column) -> Column:
    """Half the last digit of either coordinate on the ground, the larger one."""
    degree = 111_320.0
    return F.greatest(
        degree * F.pow(F.lit(10.0), -lat_places) / 2, degree * F.cos(F.radians(lat)) * F.pow(F.lit(10.0), -lon_places) / 2
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable isn't inlined where it is used."""
    return F.transform(F.array(value), body).getItem(0)


def edge_in_circle(edge: Column, r: Column) -> Column:
    """Signed area between the origin and the edge (ax, ay)-(bx, by) that lies within the circle of radius r around the origin."""
    clip = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    angle = lambda ux, uy, vx, vy: F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)

    def line(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        a, b = dx * dx + dy * dy, e["ax"] * dx + e["ay"] * dy
        disc = b * b - a * (e["ax"] * e["ax"] + e["ay"] * e["ay"] - r * r)
        return F.struct(dx.alias("dx"), dy.alias("dy"), a.alias("a"), b.alias("b"), disc.alias("disc"))

    def cuts(q: Column) -> Column:
        root, hits = F.sqrt(F.greatest(q["disc"], F.lit(0.0))), (q["disc"] > 0) & (q["a"] > 0)
        return F.struct(F.when(hits, clip((-q["b"] - root) / q["a"])).otherwise(0.0).alias("t1"), F.when(hits, clip((-q["b"] + root) / q["a"])).otherwise(0.0).alias("t2"))

    def area(e: Column, q: Column, t: Column) -> Column:
        point = F.struct(
            (e["ax"] + t["t1"] * q["dx"]).alias("px"), (e["ay"] + t["t1"] * q["dy"]).alias("py"), (e["ax"] + t["t2"] * q["dx"]).alias("qx"), (e["ay"] + t["t2"] * q["dy"]).alias("qy")
        )
        part = lambda p: (p["px"] * p["qy"] - p["py"] * p["qx"]) / 2 + r * r / 2 * (angle(e["ax"], e["ay"], p["px"], p["py"]) + angle(p["qx"], p["qy"], e["bx"], e["by"]))
        return F.when(t["t1"] < t["t2"], bind(point, part)).otherwise(r * r / 2 * angle(e["ax"], e["ay"], e["bx"], e["by"]))

    return bind(edge, lambda e: bind(line(e), lambda q: bind(cuts(q), lambda t: area(e, q, t))))


def ring_edges(ring: Column) -> Column:
    """Edges (ax, ay, bx, by) of a ring of struct(x, y), its first point not repeated."""
    edge = lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    return bind(ring, lambda p: F.zip_with(p, F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1)), edge))


def rings_area(rings: Column) -> Column:
    """Area of a polygon of several rings (x, y): holes run the other way than what they lie in, so that signed areas add up."""
    edges = F.flatten(F.transform(rings, ring_edges))
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def polygon_in_circle(ring: Column, r: Column) -> Column:
    """Area of a simple polygon within the circle around the origin. ring: array of struct(x, y), first point not repeated."""
    return rings_in_circle(F.array(ring), r)


def rings_in_circle(rings: Column, r: Column) -> Column:
    """Area of a polygon of several rings within the circle around the origin; holes run the other way than what they lie in."""
    parts = F.transform(F.flatten(F.transform(rings, ring_edges)), lambda e: edge_in_circle(e, r))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, e: s + e))


def signed_area(ring: Column) -> Column:
    """Area of a ring of struct(lat, lon) in square degrees, positive if it runs against the clock."""
    nexts = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, nexts, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def oriented(ring: Column, outer: Column) -> Column:
    """A ring of struct(lat, lon), turned so that it runs against the clock if it is an outer one, with it if it is a hole."""
    return F.when((signed_area(ring) > 0) == outer, ring).otherwise(F.reverse(ring))


def circle_cut(h: Column, r: Column) -> tuple[Column, Column]:
    """For |h| <= r: half the circle's area between the middle and the line at h (negative below), and the cap beyond |h|."""
    root = F.sqrt(F.greatest(r * r - h * h, F.lit(0.0)))
    return (h * root + r * r * F.asin(h / r)) / 2, r * r * F.acos(F.abs(h) / r) - F.abs(h) * root


def corner_in_circle(x: Column, y: Column, cut_x: tuple[Column, Column], cut_y: tuple[Column, Column], r: Column) -> Column:
    """Area of the part of the circle that lies left of x and below y, for |x|, |y| <= r, with their circle_cut()."""
    outside = F.when((x >= 0) & (y >= 0), math.pi * r * r - cut_x[1] - cut_y[1]).when((x <= 0) & (y <= 0), 0.0).when(x < 0, cut_x[1]).otherwise(cut_y[1])
    return F.when(x * x + y * y >= r * r, outside).otherwise(x * y + cut_x[0] + cut_y[0] + math.pi * r * r / 4)


def rectangle_in_circle(x0: Column, y0: Column, x1: Column, y1: Column, r: Column) -> Column:
    """Area of an axis-parallel rectangle within the circle around the origin: a closed form of its corners, all of it compiled code."""
    far2 = F.greatest(x0 * x0, x1 * x1) + F.greatest(y0 * y0, y1 * y1)
    dx, dy = F.greatest(x0, -x1, F.lit(0.0)), F.greatest(y0, -y1, F.lit(0.0))
    clip = lambda v: F.greatest(-r, F.least(r, v))
    corner = lambda x, y: corner_in_circle(clip(x), clip(y), circle_cut(clip(x), r), circle_cut(clip(y), r), r)
    cut = corner(x1, y1) - corner(x0, y1) - corner(x1, y0) + corner(x0, y0)
    return F.when(far2 <= r * r, (x1 - x0) * (y1 - y0)).when(dx * dx + dy * dy >= r * r, 0.0).otherwise(F.greatest(F.lit(0.0), cut))
