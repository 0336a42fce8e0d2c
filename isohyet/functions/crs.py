"""Map projections as Column expressions: transverse Mercator (UTM, the British grid) and Mollweide, in metres."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from isohyet.functions.geo import bind


@dataclass(frozen=True)
class TransverseMercator:
    """An ellipsoid (semi-major axis, flattening) and its projection; angles in degrees."""

    a: float
    f: float
    lat0: float
    lon0: float
    k0: float
    east0: float
    north0: float

    def series(self) -> tuple[float, float, tuple[float, float, float]]:
        """(n, rectifying radius, coefficients) of Krueger's series to the third order of n."""
        n = self.f / (2 - self.f)
        radius = self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        return n, radius, (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)

    def origin(self) -> float:
        """Length of the meridian from the equator to lat0."""
        n, radius, alpha = self.series()
        s, c = math.sin(math.radians(self.lat0)), 2 * math.sqrt(n) / (1 + n)
        xi = math.atan(math.sinh(math.atanh(s) - c * math.atanh(c * s)))
        return radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(alpha, 1)))


#: The ellipsoids and grids as published.
WGS84 = (6_378_137.0, 1 / 298.257223563)
AIRY = (6_377_563.396, 1 / 299.3249646)
BRITISH_GRID = TransverseMercator(*AIRY, 49.0, -2.0, 0.9996012717, 400_000.0, -100_000.0)
#: The published Helmert shift from WGS84 to the British datum (metres, parts per million, seconds of arc); good to some 5 m.
TO_BRITISH = (-446.448, 125.157, -542.060, 20.4894, -0.1502, -0.2470, -0.8421)
#: Radius of the Mollweide sphere, and rounds of Newton's method: the poles converge slowest.
MOLLWEIDE_RADIUS, ROUNDS = 6_378_137.0, 40


def utm(zone: int, south: bool = False) -> TransverseMercator:
    return TransverseMercator(*WGS84, 0.0, zone * 6.0 - 183.0, 0.9996, 500_000.0, 10_000_000.0 if south else 0.0)


def project(tm: TransverseMercator, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(east, north) of latitudes and longitudes on the projection's own ellipsoid."""
    n, radius, alpha = tm.series()
    c = 2 * math.sqrt(n) / (1 + n)
    s, dl = F.sin(F.radians(lat)), F.radians(lon - tm.lon0)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))

    def grid(p: Column) -> Column:
        east = p["eta"] + sum(a * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"]) for j, a in enumerate(alpha, 1))
        north = p["xi"] + sum(a * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"]) for j, a in enumerate(alpha, 1))
        k = tm.k0 * radius
        return F.struct((tm.east0 + k * east).alias("east"), (tm.north0 - tm.k0 * tm.origin() + k * north).alias("north"))

    both = bind(t, lambda t: bind(F.struct(F.atan2(t, F.cos(dl)).alias("xi"), F.atanh(F.sin(dl) / F.sqrt(1 + t * t)).alias("eta")), grid))
    return both["east"], both["north"]


def to_british_datum(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(lat, lon) on the British datum of places at WGS84 height 0, by the Helmert shift."""
    tx, ty, tz, ppm, *turn = TO_BRITISH
    rx, ry, rz = (math.radians(x / 3600) for x in turn)
    (a, f), (a2, f2) = WGS84, AIRY
    e2, e2b, s = f * (2 - f), f2 * (2 - f2), 1 + ppm * 1e-6
    phi, lam = F.radians(lat), F.radians(lon)
    nu = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    x, y, z = nu * F.cos(phi) * F.cos(lam), nu * F.cos(phi) * F.sin(lam), nu * (1 - e2) * F.sin(phi)
    place = F.struct((tx + s * x - rz * y + ry * z).alias("x"), (ty + rz * x + s * y - rx * z).alias("y"), (tz - ry * x + rx * y + s * z).alias("z"))

    def angles(p: Column) -> Column:
        flat = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
        step = lambda q: F.atan2(p["z"] + e2b * (a2 / F.sqrt(1 - e2b * F.sin(q) * F.sin(q))) * F.sin(q), flat)
        turned = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.atan2(p["z"], flat * (1 - e2b)), lambda q, _: step(q))
        return F.struct(F.degrees(turned).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lon"))

    both = bind(place, angles)
    return both["lat"], both["lon"]


def british_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(east, north) on the British grid of WGS84 places, within some 5 m."""
    return project(BRITISH_GRID, *to_british_datum(lat, lon))


def mollweide(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) of the equal-area Mollweide projection on the sphere."""
    goal = math.pi * F.sin(F.radians(lat))
    # Newton's method on 2t + sin 2t; at a pole its slope is 0, and the start is the answer
    step = lambda t: F.coalesce(t - F.try_divide(2 * t + F.sin(2 * t) - goal, 2 + 2 * F.cos(2 * t)), t)
    pole = F.abs(F.radians(lat)) > math.pi / 2 - 1e-12
    theta = F.when(pole, F.radians(lat)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.radians(lat), lambda t, _: step(t)))
    both = bind(theta, lambda t: F.struct((2 * math.sqrt(2) / math.pi * MOLLWEIDE_RADIUS * F.radians(lon) * F.cos(t)).alias("x"), (math.sqrt(2) * MOLLWEIDE_RADIUS * F.sin(t)).alias("y")))
    return both["x"], both["y"]
