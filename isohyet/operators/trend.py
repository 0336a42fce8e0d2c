"""Break-aware trends: anomalies, the single-slope fit with intercept shifts, paired differences, robust slopes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.functions.coerce import finite
from isohyet.functions.draws import draw
from isohyet.operators.entity import cut_off
from isohyet.operators.ranking import ranked
from isohyet.operators.slopes import median_slope
from isohyet.session import ship_package

LEAST = 24
R1_MOST = 0.99


def monthly_anomalies(series: DataFrame, by: str = "series", month: str = "month", value: str = "value", least: int = 3) -> DataFrame:
    """series with anomaly: value less the mean of its calendar month (month % 12); months of fewer than least values have none."""
    clean = series.withColumn(value, finite(F.col(value)))
    w = Window.partitionBy(by, F.pmod(F.col(month), F.lit(12)))
    return clean.withColumn("anomaly", F.when(F.count(value).over(w) >= least, F.col(value) - F.avg(value).over(w)))


def break_trend(series: DataFrame, breaks: DataFrame | None = None, by: str = "series", month: str = "month", value: str = "anomaly") -> DataFrame:
    """(by, slope, stderr, n, n_breaks): one slope a decade with an intercept for every segment between breaks.

    Slope and one intercept a segment span what a slope with step dummies does, so that demeaning within segments
    leaves two sums. breaks: (by, months array<double>); those outside the open support of the values don't count. Fewer
    than 24 finite values have no fit. The standard error takes the effective number of values under AR(1) residuals.
    """
    rows = series.select(F.col(by).alias("by"), F.col(month).cast("double").alias("t"), finite(F.col(value)).alias("y")).where("y IS NOT NULL AND t IS NOT NULL")
    if breaks is not None:
        rows = rows.join(breaks.select(F.col(by).alias("b_by"), "months"), F.col("by").eqNullSafe(F.col("b_by")), "left").drop("b_by")
    else:
        rows = rows.withColumn("months", F.lit(None).cast("array<double>"))
    group = Window.partitionBy("by")
    rows = rows.withColumns({"t0": F.min("t").over(group), "t1": F.max("t").over(group)})
    kept = F.filter(F.coalesce("months", F.array().cast("array<double>")), lambda b: (b > F.col("t0")) & (b < F.col("t1")))
    rows = rows.withColumn("kept", kept).withColumn("segment", F.size(F.filter("kept", lambda b: F.col("t") >= b))).withColumn("x", (F.col("t") - F.col("t0")) / 120)
    seg = Window.partitionBy("by", "segment")
    rows = rows.withColumns({"xd": F.col("x") - F.avg("x").over(seg), "yd": F.col("y") - F.avg("y").over(seg)})
    rows = rows.withColumn("slope", F.try_divide(F.sum(F.col("xd") * F.col("yd")).over(group), F.sum(F.col("xd") * F.col("xd")).over(group)))
    rows = rows.withColumn("resid", F.col("yd") - F.col("slope") * F.col("xd"))
    rows = rows.withColumn("before", F.lag("resid").over(group.orderBy("t")))
    sums = rows.groupBy("by").agg(
        F.first("slope").alias("slope"), F.count(F.lit(1)).alias("n"), F.first(F.size("kept")).alias("n_breaks"),
        F.sum(F.col("resid") * F.col("resid")).alias("rss"), F.sum(F.col("xd") * F.col("xd")).alias("sxx"),
        F.corr(F.when(F.col("before").isNotNull(), F.col("resid")), "before").alias("r"),
    )
    r1 = F.greatest(F.lit(0.0), F.least(F.lit(R1_MOST), F.col("r")))
    neff = F.when(F.col("n") < 10, F.col("n").cast("double")).otherwise(F.col("n") * (1 - r1) / (1 + r1))
    p = F.col("n_breaks") + 2
    se = F.when(neff > p + 1, F.sqrt(F.col("rss") / (neff - p) / F.col("sxx") * F.col("n") / neff))
    fits = F.col("n") >= LEAST
    return sums.select(F.col("by").alias(by), F.when(fits, F.col("slope")).alias("slope"), F.when(fits, se).alias("stderr"), "n", "n_breaks")


def paired_difference(series: DataFrame, pairs: DataFrame, breaks: DataFrame | None = None, station: str = "station") -> DataFrame:
    """(pair, slope, stderr, n, n_breaks): trend of a - b on common months; differenced, then deseasonalised, then fitted.

    series: (station, month, value); pairs: (pair, a, b); breaks: (station, months array<double>), joined for both stations.
    """
    s = series.select(F.col(station).alias("station"), "month", finite(F.col("value")).alias("value")).where("value IS NOT NULL")
    a = pairs.join(s, pairs["a"] == s["station"]).select("pair", "b", "month", F.col("value").alias("va"))
    b = s.select(F.col("station").alias("s_b"), F.col("month").alias("m_b"), F.col("value").alias("vb"))
    diff = a.join(b, (F.col("b") == F.col("s_b")) & (F.col("month") == F.col("m_b"))).select("pair", "month", (F.col("va") - F.col("vb")).alias("value"))
    union = None
    if breaks is not None:
        x = breaks.select(F.col(station).alias("s"), "months")
        ends = pairs.select("pair", F.explode(F.array("a", "b")).alias("s"))
        union = ends.join(x, "s").groupBy("pair").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("months")))).alias("months"))
    return break_trend(monthly_anomalies(diff, "pair"), union, "pair")


def pair_mean(fits: DataFrame) -> DataFrame:
    """(n_pairs, mean_slope, se): over pairs with a slope."""
    ok = fits.withColumn("slope", finite(F.col("slope"))).where("slope IS NOT NULL")
    return ok.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("slope").alias("mean_slope"), (F.stddev_samp("slope") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def make_pairs(treated: DataFrame, controls: DataFrame, seed: int = 0) -> DataFrame:
    """(pair, a, b): one-to-one, both sides in an order drawn by the seed."""
    placed = lambda df, name: ranked(df.select(F.col(df.columns[0]).alias(name)).withColumn("at", draw(seed, F.col(name))), ["at", name], name="pair").drop("at")
    return placed(treated, "a").join(placed(controls, "b"), "pair").select("pair", "a", "b")


def split_slopes(series: DataFrame, at: float | Column, by: str = "series", month: str = "month", value: str = "value") -> DataFrame:
    """(by, naive_slope): mean of the slopes before and after a break (a month, or a column with each series' own). A break confounds it; kept to show that."""
    x = F.col(month).cast("double") / 120
    side = series.withColumn("late", F.col(month) >= at).groupBy(by, "late").agg(F.regr_slope(finite(F.col(value)), x).alias("s"))
    return side.groupBy(by).agg(F.avg("s").alias("naive_slope"))


def theil_sen(series: DataFrame, by: str = "series", month: str = "month", value: str = "value") -> DataFrame:
    """(by, slope, n_pairs): exact median of the slopes of all pairs of a series, per decade; null without a pair.

    A series is one group, of at most the hours of a station's life; its pairs are counted, not laid out (slopes.median_slope).
    """
    ship_package(series.sparkSession)
    s = series.select(F.col(by).alias("by"), finite(F.col(month)).alias("t"), finite(F.col(value)).alias("y")).where("t IS NOT NULL AND y IS NOT NULL")

    def fit(table: pa.Table) -> pa.Table:
        slope, pairs = median_slope(*(table.column(c).to_numpy() for c in ("t", "y")))
        return pa.table({"by": table.column("by").slice(0, 1), "slope": pa.array([None if slope is None else slope * 120], pa.float64()), "n_pairs": [pairs]})

    fits = s.groupBy("by").applyInArrow(fit, T.StructType([s.schema["by"], T.StructField("slope", T.DoubleType()), T.StructField("n_pairs", T.LongType())]))
    return fits.withColumnRenamed("by", by)


def clustered_bootstrap(values: DataFrame, cluster: str, value: str, draws: int = 200, seed: int = 1) -> DataFrame:
    """(mean, lower, upper): clusters are resampled with replacement by a hash, so that reruns agree."""
    sums, size = cut_off(values.withColumn("__v", finite(F.col(value))).groupBy(cluster).agg(F.sum("__v").alias("s"), F.count("__v").alias("n")).where("n > 0"))
    placed = ranked(sums, [cluster], name="i").select((F.col("i") - 1).alias("pick"), "s", "n")
    nth = values.sparkSession.range(draws * size).select(F.expr(f"id div {max(size, 1)}").alias("b"), (F.col("id") % max(size, 1)).alias("i"))
    picks = nth.select("b", (draw(seed, F.col("b"), F.col("i")) % size).alias("pick"))
    # neither side may be broadcast: both grow with clusters, picks to more than their estimate
    means = picks.join(placed.hint("shuffle_hash"), "pick").groupBy("b").agg((F.sum("s") / F.sum("n")).alias("m"))
    stats = means.agg(F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper"))
    return sums.agg((F.sum("s") / F.sum("n")).alias("mean")).join(stats)
