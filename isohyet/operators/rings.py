"""Ring statistics: complete grids, cell weights, weighted sums, dominant classes, hits, apportionment, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.geo import circle_cut, corner_in_circle, haversine_km
from isohyet.operators.spatial import with_cell, with_cells_around


#: Values of an axis that are broadcast.
AXIS_ROWS = 50_000
#: Cells that one task makes, about.
CELLS_A_TASK = 1_000_000


def complete_grid(axes: list[DataFrame], facts: DataFrame, on: list[str]) -> DataFrame:
    """Every combination of the axes, with its facts where there are any, null-safely.

    Axes are counted: one of up to AXIS_ROWS values is broadcast to the rows so far, a longer one meets them in a shuffled product.
    """
    grid = axes[0]
    for axis in axes[1:]:
        values = axis.distinct()
        short = values.limit(AXIS_ROWS + 1).count() <= AXIS_ROWS
        grid = grid.crossJoin(F.broadcast(values) if short else values)
    held = facts.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in facts.columns])
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return grid.join(held, match, "left").drop(*[f"__{c}" for c in on])


def cell_weights(stations: DataFrame, radii: list[float], cell: float) -> DataFrame:
    """(src_id, ring_m, row, col, w): the fraction of each cell within the ring, for stations at (x, y) of the cells' plane.

    Only the cells of the ring's box are made; w is 1 inside, 0 outside and exact on the boundary. Stations are dealt by src_id to as many tasks as their
    cells need: a task's cells, and what is summed of them by station without another exchange, don't grow with the table.
    """
    made = stations.count() * sum((2 * r / cell + 2) ** 2 for r in radii)
    dealt = stations.repartition(int(made // CELLS_A_TASK) + 1, "src_id")
    ringed = dealt.select("src_id", "x", "y", F.explode(F.array(*map(F.lit, radii))).alias("ring_m"))
    span = lambda c: F.sequence(F.floor((F.col(c) - F.col("ring_m")) / cell).cast("int"), F.floor((F.col(c) + F.col("ring_m")) / cell).cast("int"))
    cells = ringed.withColumn("col", F.explode(span("x"))).withColumn("row", F.explode(span("y")))
    r, sides = F.col("ring_m"), ("x0", "x1", "y0", "y1")
    x0, y0 = F.col("col") * cell - F.col("x"), F.col("row") * cell - F.col("y")
    placed = cells.select("src_id", "ring_m", "row", "col", x0.alias("x0"), (x0 + cell).alias("x1"), y0.alias("y0"), (y0 + cell).alias("y1"))
    far2 = F.greatest(F.abs("x0"), F.abs("x1")) ** 2 + F.greatest(F.abs("y0"), F.abs("y1")) ** 2
    dx, dy = F.greatest(F.col("x0"), -F.col("x1"), F.lit(0.0)), F.greatest(F.col("y0"), -F.col("y1"), F.lit(0.0))
    met = placed.where(dx * dx + dy * dy < r * r).withColumn("whole", far2 <= r * r)
    # sides are cut to the circle and each is measured once, on the boundary only; corners put them together
    clipped = met.withColumns({c: F.greatest(-r, F.least(r, F.col(c))) for c in sides})
    cuts = clipped.withColumns({f"{n}_{c}": F.when(~F.col("whole"), v) for c in sides for n, v in zip(("half", "cap"), circle_cut(F.col(c), r), strict=True)})
    corner = lambda x, y: corner_in_circle(F.col(x), F.col(y), (F.col(f"half_{x}"), F.col(f"cap_{x}")), (F.col(f"half_{y}"), F.col(f"cap_{y}")), r)
    area = corner("x1", "y1") - corner("x0", "y1") - corner("x1", "y0") + corner("x0", "y0")
    w = F.when(F.col("whole"), 1.0).otherwise(F.greatest(F.lit(0.0), area) / (cell * cell))
    # a filter would be pushed below the columns above and write each of them out again wherever it is used
    return cuts.select("src_id", "ring_m", "row", "col", F.explode(F.filter(F.array(w), lambda v: v > 1e-9)).alias("w"))


def _sums(cells: DataFrame, by: list[str], terms: dict[str, Column], order: list[str] | None, **more: Column) -> DataFrame:
    """(by, sums, more). With an order, the terms of a group are added in it: floating sums in any order differ in their last bits, and with them what is rounded or gated."""
    if order is None:
        return cells.groupBy(*by).agg(*[F.sum(t).alias(n) for n, t in terms.items()], *[c.alias(n) for n, c in more.items()])
    held = F.struct(*order, *[t.cast("double").alias(f"__{n}") for n, t in terms.items()])
    rows = cells.groupBy(*by).agg(F.array_sort(F.collect_list(held)).alias("__rows"), *[c.alias(n) for n, c in more.items()])

    def total(name: str) -> Column:
        values = F.filter(F.transform("__rows", lambda r: r[f"__{name}"]), lambda v: v.isNotNull())
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v))

    return rows.select(*by, *[total(n).alias(n) for n in terms], *more)


def ring_fraction(weighted: DataFrame, by: list[str], built: str, land: str, covered: str, w: str = "w", order: list[str] | None = None) -> DataFrame:
    """(by, built_sum, land_sum, fraction, reason): what isn't covered has no coverage, what has no land no fraction.

    order: columns that fix the order in which a group's cells are added up.
    """
    terms = {"built_sum": F.col(w) * F.when(F.col(covered), F.col(built)), "land_sum": F.col(w) * F.when(F.col(covered), F.col(land))}
    sums = _sums(weighted, by, terms, order, complete=F.bool_and(covered))
    reason = F.when(~F.col("complete"), "no-coverage").when(F.coalesce("land_sum", F.lit(0.0)) <= 0, "no-land-in-ring")
    gated = lambda c: F.when(F.col("complete"), F.col(c))
    return sums.select(
        *by, gated("built_sum").alias("built_sum"), gated("land_sum").alias("land_sum"),
        F.when(reason.isNull(), F.try_divide("built_sum", "land_sum")).alias("fraction"), reason.alias("reason"),
    )


def gated_mean(cells: DataFrame, by: list[str], v: str, w: str, valid: str, least: float = 0.8, order: list[str] | None = None) -> DataFrame:
    """(by, mean, valid_fraction, reason): weighted mean over valid cells; too few of them give a reason instead.

    order: columns that fix the order in which a group's cells are added up.
    """
    terms = {"s": F.when(F.col(valid), F.col(w) * F.col(v)), "ok": F.when(F.col(valid), F.col(w)), "all": F.col(w)}
    sums = _sums(cells, by, terms, order)
    share = F.coalesce(F.try_divide("ok", "all"), F.lit(0.0))
    return sums.select(
        *by, F.when(share >= least, F.try_divide("s", "ok")).alias("mean"), share.alias("valid_fraction"),
        F.when(share < least, "insufficient-clear-coverage").alias("reason"),
    )


def dominant_class(areas: DataFrame, by: list[str], kind: str, area: str, whole: Column, legend: list[str]) -> DataFrame:
    """(by, dominant, coverage, frac_<class>...): largest area, ties to the earlier class of the legend; unknown classes don't count."""
    place = F.array_position(F.array(*map(F.lit, legend)), F.col(kind))
    known = areas.where(place > 0).groupBy(*by, F.col(kind).alias("kind"), place.alias("place")).agg(F.sum(area).alias("a"), F.max(whole).alias("whole"))
    fractions = [F.coalesce(F.sum(F.when(F.col("kind") == c, F.col("a"))) / F.max("whole"), F.lit(0.0)).alias(f"frac_{i}") for i, c in enumerate(legend, 1)]
    return known.groupBy(*by).agg(
        F.max_by("kind", F.struct("a", -F.col("place"))).alias("dominant"),
        F.least(F.sum("a") / F.max("whole"), F.lit(1.0)).alias("coverage"),
        *fractions,
    )


def radius_hits(centres: DataFrame, features: DataFrame, radii: list[float]) -> DataFrame:
    """(centre, ring_km, n, feature_ids): features (feature, lat, lon) within each ring of centres (centre, lat, lon); rings without hits stay.

    Both sides meet on cells as wide as the largest ring, each feature in those around it; distances decide.
    """
    c = with_cell(centres.select("centre", F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), "lat0", "lon0", max(radii))
    at = F.col("lat"), F.col("lat"), F.col("lon"), F.col("lon")
    f = with_cells_around(features.select("feature", "lat", "lon"), *at, max(radii))
    met = c.join(f, ["cell_i", "cell_j"]).withColumn("km", haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))
    near = met.where(F.col("km") <= max(radii)).select("centre", "feature", "km").withColumn("ring_km", F.explode(F.array(*map(F.lit, radii)))).where(F.col("km") <= F.col("ring_km"))
    lists = near.groupBy("centre", "ring_km").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("feature")), ";").alias("feature_ids"))
    rings = centres.select("centre").withColumn("ring_km", F.explode(F.array(*map(F.lit, radii))))
    return rings.join(lists, ["centre", "ring_km"], "left").select("centre", "ring_km", F.coalesce("n", F.lit(0)).alias("n"), "feature_ids")


def any_ring(hits: DataFrame) -> DataFrame:
    """Adds flagged: whether any ring of the centre has a hit."""
    return hits.withColumn("flagged", F.bool_or(F.col("n") > 0).over(Window.partitionBy("centre")))


def apportion_density(units: DataFrame, by: str, period: str, population: str, inter: str, area: str, land: str, least: float = 0.8) -> DataFrame:
    """(by, period, population, density, delta, reason): area-weighted shares; delta to the previous period that has a density."""
    sums = units.where((F.col(area) > 0) & (F.col(inter) > 0)).groupBy(by, period).agg(
        F.sum(F.col(population) * F.col(inter) / F.col(area)).alias("population"), F.sum(inter).alias("covered"), F.max(land).alias("land")
    )
    enough = F.col("covered") >= least * F.col("land")
    rows = sums.withColumn("density", F.when(enough, F.try_divide("population", "land"))).withColumn("reason", F.when(~enough, "insufficient-boundary-coverage"))
    before = Window.partitionBy(by).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(by, period, "population", "density", (F.col("density") - F.last("density", ignorenulls=True).over(before)).alias("delta"), "reason")


#: Years in which the layer's cells were observed, and the sensor of each.
OBSERVATIONS = ((1975, "MSS"), (1990, "TM"), (2000, "ETM+"), (2014, "OLI"), (2018, "S2"))


def epoch_provenance(epoch: Column, observed: tuple[tuple[int, str], ...] = OBSERVATIONS) -> dict[str, Column]:
    """tag, anchor_sensor, and the nearest observation (ties to the earlier) with its sensor and distance in years."""
    seen = F.array(*[F.struct(F.abs(epoch - y).alias("d"), F.lit(y).alias("y"), F.lit(s).alias("s")) for y, s in observed])
    nearest, last = F.array_min(seen), max(y for y, _ in observed)
    exact = nearest["d"] == 0
    return {
        "tag": F.when(exact, "sensor-anchored").when(epoch > last, "projected").otherwise("interpolated"),
        "anchor_sensor": F.when(exact, nearest["s"]),
        "nearest_obs_year": nearest["y"],
        "nearest_obs_sensor": nearest["s"],
        "obs_offset_years": nearest["d"],
    }


def point_in_cell(points: DataFrame, cells: DataFrame, x: str, y: str, x0: float, y0: float, size: float, nodata: int | None = None) -> DataFrame:
    """points with the value of their cell (row, col, value); outside the raster, or on nodata, null."""
    at = points.withColumns({"row": F.floor((F.lit(y0) - F.col(y)) / size).cast("int"), "col": F.floor((F.col(x) - x0) / size).cast("int")})
    joined = at.join(cells.select("row", "col", "value"), ["row", "col"], "left")
    return joined if nodata is None else joined.withColumn("value", F.when(F.col("value") != nodata, F.col("value")))
