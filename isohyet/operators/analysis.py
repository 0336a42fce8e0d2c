"""Cohort analysis: matched controls, means by station and by area, event time, extrema, block bootstrap, coverage of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.coerce import finite
from isohyet.functions.draws import draw
from isohyet.functions.geo import haversine_km
from isohyet.operators.spatial import with_cell, with_cells_around


def matched_controls(treated: DataFrame, controls: DataFrame, bands: list[str], km: float, n: int = 1, where_known: tuple[str, ...] = ()) -> DataFrame:
    """(treated, control, nth, km): the n nearest controls in the same bands within a distance; a control may serve several.

    Both tables: id, lat, lon and the band columns, on which, with cells as wide as the distance, they are joined. Bands of where_known must agree
    only where both sides have them. Rows of one side that share place and bands are alike but for their ids: only the first n such controls can serve,
    and such treated rows are matched once.
    """
    alike = Window.partitionBy("lat", "lon", *bands, *where_known)
    known = treated.select("id", "lat", "lon", *bands, *where_known).withColumn("alike", F.min("id").over(alike))
    same = known.select(F.col("alike").alias("treated"), F.col("id").alias("__id"))
    treated = known.where("id = alike")
    controls = controls.select("id", "lat", "lon", *bands, *where_known).withColumn("__first", F.row_number().over(alike.orderBy("id"))).where(F.col("__first") <= n)
    t = with_cell(treated.select(F.col("id").alias("treated"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), *bands, *[F.col(c).alias(f"t_{c}") for c in where_known]), "t_lat", "t_lon", km)
    c = controls.select(F.col("id").alias("control"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), *bands, *[F.col(c).alias(f"c_{c}") for c in where_known])
    c = with_cells_around(c, F.col("c_lat"), F.col("c_lat"), F.col("c_lon"), F.col("c_lon"), km)
    near = t.join(c, [*bands, "cell_i", "cell_j"]).withColumn("km", haversine_km(F.col("t_lat"), F.col("t_lon"), F.col("c_lat"), F.col("c_lon"))).where(F.col("km") <= km)
    for k in where_known:
        near = near.where(F.coalesce(F.col(f"t_{k}") == F.col(f"c_{k}"), F.lit(True)))
    w = Window.partitionBy("treated").orderBy("km", "control")
    found = near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("treated", "control", "nth", "km")
    return found.join(same, "treated").select(F.col("__id").alias("treated"), "control", "nth", "km")


def matched_effect(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(effect, stderr, n_pairs, n_controls): the mean difference of treated and control over pairs (treated, control), values (id, value).

    Pairs that share a control share its weight of one, and its noise: errors are summed by control, G / (G - 1) corrects for G of them. Pairs without
    both values don't count; with one control there is no error.
    """
    of = lambda side: values.select(F.col("id").alias(side), finite(F.col("value")).alias(f"v_{side}")).where(F.col(f"v_{side}").isNotNull())
    both = pairs.select("treated", "control").join(of("treated"), "treated").join(of("control"), "control")
    by_control = both.groupBy("control").agg(F.avg(F.col("v_treated") - F.col("v_control")).alias("d"), F.count(F.lit(1)).alias("n"))
    # a control's pairs weigh 1 together: the effect is the mean over controls, a control's score its distance from it
    spread = F.when(F.count(F.lit(1)) > 1, F.stddev_samp("d") / F.sqrt(F.count(F.lit(1))))
    return by_control.agg(F.avg("d").alias("effect"), spread.alias("stderr"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.count(F.lit(1)).alias("n_controls"))


def station_means(rows: DataFrame, period: str, station: str, value: str) -> DataFrame:
    """(period, by_station, by_count): stations weighing alike, and values weighing alike."""
    per = rows.groupBy(period, station).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return per.groupBy(period).agg(F.avg("m").alias("by_station"), (F.sum("s") / F.sum("n")).alias("by_count"))


def equal_area_mean(points: DataFrame, lat: str, lon: str, value: str, degrees: float, least: int = 2) -> DataFrame:
    """(n_cells, mean): means of cells, weighted by the cosine of their latitude; cells of fewer than least points don't count."""
    i, j = F.floor(F.col(lat) / degrees).alias("i"), F.floor(F.col(lon) / degrees).alias("j")
    cells = points.groupBy(i, j).agg(F.avg(value).alias("m"), F.count(value).alias("n")).where(F.col("n") >= least)
    w = F.cos(F.radians((F.col("i") + 0.5) * degrees))
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), (F.sum(w * F.col("m")) / F.sum(w)).alias("mean"))


def event_time(rows: DataFrame, year: Column, treated_in: Column, value: str) -> DataFrame:
    """(event_year, n, mean) by years since treatment; rows never treated (null) stay out."""
    return rows.withColumn("event_year", year - treated_in).where("event_year is not null").groupBy("event_year").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def daily_extrema(hourly: DataFrame, station: str, time: str, value: str) -> DataFrame:
    """(station, day, low, high, n)."""
    return hourly.groupBy(station, F.to_date(time).alias("day")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def extrema_gap(derived: DataFrame, reported: DataFrame, station: str) -> DataFrame:
    """(n_days, n_inverted, mean_low_gap, mean_high_gap): reported less derived extrema on common days; days reported with low above high."""
    r = reported.select(station, "day", F.col("low").alias("r_low"), F.col("high").alias("r_high"))
    return derived.join(r, [station, "day"]).agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("r_low") > F.col("r_high")).alias("n_inverted"), F.avg(F.col("r_low") - F.col("low")).alias("mean_low_gap"), F.avg(F.col("r_high") - F.col("high")).alias("mean_high_gap")
    )


def block_bootstrap(series: DataFrame, by: str, month: str, value: str, block: int = 24, draws: int = 100, seed: int = 1) -> DataFrame:
    """(by, mean, lower, upper): blocks of consecutive months are resampled with replacement within each series, by a hash."""
    rows = series.select(F.col(by).alias("__by"), F.floor(F.col(month) / block).alias("k"), finite(F.col(value)).alias("v")).where("v IS NOT NULL")
    blocks = rows.groupBy("__by", "k").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    w = Window.partitionBy("__by")
    ranked = blocks.withColumn("i", F.row_number().over(w.orderBy("k")) - 1).withColumn("m", F.count(F.lit(1)).over(w))
    picks = ranked.select("__by", "i", "m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).withColumn("i", (draw(seed, F.col("__by"), F.col("b"), F.col("i")) % F.col("m")).cast("int"))
    # neither side may be broadcast: both grow with series, picks to more than their estimate
    means = picks.join(ranked.select("__by", "i", "s", "n").hint("shuffle_hash"), ["__by", "i"]).groupBy("__by", "b").agg((F.sum("s") / F.sum("n")).alias("x"))
    bounds = means.groupBy("__by").agg(F.percentile("x", 0.025).alias("lower"), F.percentile("x", 0.975).alias("upper"))
    return blocks.groupBy("__by").agg((F.sum("s") / F.sum("n")).alias("mean")).join(bounds, "__by").withColumnRenamed("__by", by)


def wild_cluster_bootstrap(rows: DataFrame, cluster: str, x: str, y: str, draws: int = 199, seed: int = 1) -> DataFrame:
    """(slope, p_value): of the regression of y on x, against no slope; residuals without it keep or turn their sign by cluster.

    With demeaned x, a draw's slope is a signed sum over clusters, so that only one sum for each cluster travels. Signs are hashes: reruns agree.
    """
    both = rows.select(F.col(cluster).alias("c"), finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    means = both.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    sums = both.join(F.broadcast(means)).withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")}).groupBy("c").agg(
        F.sum(F.col("dx") * F.col("dy")).alias("sxy"), F.sum(F.col("dx") * F.col("dx")).alias("sxx"), F.sum("dx").alias("sx"), F.sum("dy").alias("sy"), F.count(F.lit(1)).alias("n")
    )
    total = sums.agg(F.sum("sxy").alias("sxy"), F.sum("sxx").alias("sxx"))
    sign = F.when(draw(seed, F.col("b"), F.col("c")) % 2 == 0, 1).otherwise(-1)
    # x is centred, so that the mean of signed residuals drops out of the slope
    drawn = sums.select("c", "sxy", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).groupBy("b").agg(F.sum(sign * F.col("sxy")).alias("t"))
    return drawn.join(F.broadcast(total)).agg(
        F.try_divide(F.first("sxy"), F.first("sxx")).alias("slope"), ((F.count_if(F.abs("t") >= F.abs("sxy") * (1 - 1e-12)) + 1) / F.lit(draws + 1)).alias("p_value")
    )


def covering_set(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(status, n) over two manifests (name, digest): ok, changed, missing or unlisted."""
    p = present.select(F.col("name").alias("p_name"), F.col("digest").alias("p_digest"))
    both = expected.join(p, F.col("name") == F.col("p_name"), "full_outer")
    status = F.when(F.col("p_name").isNull(), "missing").when(F.col("name").isNull(), "unlisted").when(F.col("digest") != F.col("p_digest"), "changed").otherwise("ok")
    return both.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def require_cover(expected: DataFrame, present: DataFrame) -> None:
    """Raises unless every expected file is present and unchanged."""
    bad = {r.status: r.n for r in covering_set(expected, present).where("status in ('missing', 'changed')").collect()}
    if bad:
        raise ValueError(f"the deposit doesn't cover the manifest: {bad}")


def attrition(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(step, rule, n_lost, n_left): rows that fall to each rule in turn; a rule is what rows must meet, null is not met."""
    fails = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), i) for i, (_, ok) in enumerate(rules, 1)], F.lit(0))
    lost = rows.groupBy(fails.alias("step")).agg(F.count(F.lit(1)).alias("n_lost"))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("rule")) for i, (name, _) in enumerate(rules, 1)])
    total = lost.agg(F.coalesce(F.sum("n_lost"), F.lit(0)).alias("total")).select("total", F.inline(steps))
    filled = total.join(lost, "step", "left").withColumn("n_lost", F.coalesce("n_lost", F.lit(0)))
    # as many rows as rules
    so_far = Window.partitionBy("total").orderBy("step")
    return filled.select("step", "rule", "n_lost", (F.col("total") - F.sum("n_lost").over(so_far)).alias("n_left"))


def repairs(rows: DataFrame, low: str, high: str, fixed_low: str, fixed_high: str) -> DataFrame:
    """(outcome, n) of extrema before and after a repair: in order before, swapped, set to null, otherwise repaired, still inverted."""
    inverted = F.col(low) > F.col(high)
    swapped = F.col(fixed_low).eqNullSafe(F.col(high)) & F.col(fixed_high).eqNullSafe(F.col(low))
    outcome = (
        F.when(F.col(low).isNull() | F.col(high).isNull(), "incomplete").when(~inverted, "in-order").when(swapped, "swapped")
        .when(F.col(fixed_low).isNull() | F.col(fixed_high).isNull(), "set-to-null").when(F.col(fixed_low) <= F.col(fixed_high), "repaired").otherwise("still-inverted")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def diurnal_profile(hourly: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """(by, hour, mean, departure): hourly means and how far they lie from the mean of the hours."""
    hours = hourly.groupBy(*by, F.hour(time).alias("hour")).agg(F.avg(value).alias("mean"))
    return hours.withColumn("departure", F.col("mean") - F.avg("mean").over(Window.partitionBy(*by)))


def dose_response(rows: DataFrame, by: list[str], dose: str, value: str) -> DataFrame:
    """(by, slope, n): least-squares slope of value on dose, over rows with both."""
    both = rows.where(F.col(dose).isNotNull() & F.col(value).isNotNull())
    return both.groupBy(*by).agg(F.regr_slope(F.col(value).cast("double"), F.col(dose).cast("double")).alias("slope"), F.count(F.lit(1)).alias("n"))


def year_spill(rows: DataFrame, station: str, file_year: Column, time: str) -> DataFrame:
    """(station, file_year, n, n_before, n_after): observations of a year's file that fall into the years beside it."""
    year = F.year(time)
    return rows.groupBy(station, file_year.alias("file_year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(year == file_year - 1).alias("n_before"), F.count_if(year == file_year + 1).alias("n_after")
    )


#: The shares of built-up land that part the classes of a station, growth that counts, a long record's years.
BUILT = ((0.02, "rural"), (0.05, "sparse"), (0.15, "mixed"), (0.30, "dense"))
GROWTH = (0.03, 0.01)
LONG_RECORD = 50


def built_class(share: Column) -> Column:
    out = F.lit("urban")
    for limit, name in reversed(BUILT):
        out = F.when(share < limit, name).otherwise(out)
    return F.when(share.isNull(), "unknown").otherwise(out)


def growth_class(first: Column, last: Column) -> Column:
    """Null unless both shares are known."""
    grown = last - first
    return F.when(grown > GROWTH[0], "strong").when(grown > GROWTH[1], "some").when(grown.isNotNull(), "little")


def headline(stations: DataFrame, first: str, last: str, first_year: str, last_year: str) -> DataFrame:
    """(n_stations, n_both, n_rural, n_long): stations, those with both shares, of these the rural ones, and long records."""
    both = F.col(first).isNotNull() & F.col(last).isNotNull()
    return stations.agg(
        F.count(F.lit(1)).alias("n_stations"), F.count_if(both).alias("n_both"), F.count_if(both & (built_class(F.col(last)) == "rural")).alias("n_rural"),
        F.count_if(F.col(last_year) - F.col(first_year) >= LONG_RECORD).alias("n_long"),
    )
