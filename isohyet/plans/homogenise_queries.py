"""Queries on pairwise homogenisation and long memory: suppliers as stations, mean quantity by month of shipping as their series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.operators import homogenise
from isohyet.plans.tables import SQL_KM, SQL_LAT, SQL_LON, lat, lon, table

KM = 80.0
#: Low enough for shifts to be found in series without any.
CRITICAL = 4.0


def _series(spark: SparkSession, d: str, key: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("bigint")
    return l.groupBy(F.col(key).alias("station"), month.alias("month")).agg(F.avg("l_quantity").alias("value"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("station"), lat("s_suppkey").alias("lat"), lon("s_suppkey").alias("lon"))


def strongest_pair_shift(spark: SparkSession, d: str) -> DataFrame:
    out = homogenise.neighbour_shifts(_series(spark, d, "l_suppkey"), _points(spark, d), KM)
    return out.select("a", "b", "month", F.round("stat", 5).alias("stat"), F.round("shift", 5).alias("shift"))


def pair_shift_log(spark: SparkSession, d: str) -> DataFrame:
    """Every shift laid to a station; splits go on until none is left, in SQL a relation for every level of them."""
    out = homogenise.neighbour_log(_series(spark, d, "l_suppkey"), _points(spark, d), KM, CRITICAL)
    return out.select("station", "month", F.round("shift", 5).alias("shift"), "n_neighbours")


def neighbourhood_mix(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_nationkey").alias("label"))
    out = homogenise.neighbourhood_mix_within(_points(spark, d).join(labels, "station"), KM)
    return out.select("station", "label", "n", F.round("share", 9).alias("share"))


def long_memory_trend(spark: SparkSession, d: str) -> DataFrame:
    out = homogenise.long_memory_trend(_series(spark, d, "l_returnflag"), "station")
    return out.select("station", *[F.round(c, 5).alias(c) for c in ("slope", "stderr", "d")], "n")


_SERIES = "SELECT {0} AS station, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT AS month, avg(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY ALL"
_PLACED = f"SELECT s_suppkey AS k, s_nationkey AS label, {SQL_LAT.format('s_suppkey')} AS lat, {SQL_LON.format('s_suppkey')} AS lon FROM supplier"
_NEAR = f"SELECT x.k AS a, y.k AS b FROM placed x JOIN placed y ON x.k < y.k AND {SQL_KM.format('x.lat', 'x.lon', 'y.lat', 'y.lon')} <= {KM}"


#: A part needs 24 values, of at most 96 months: no split lies deeper.
LEVELS = 9


def _sql_splits() -> str:
    """Relations p0, p1, ... of parts and s0, s1, ... of their strongest splits, from differences d(a, b, month, v)."""
    out = ["p0 AS (SELECT DISTINCT a, b, -9999 AS lo, 9999 AS hi FROM d)"]
    for i in range(LEVELS):
        out.append(f"""x{i} AS (
  SELECT a, b, lo, hi, month, count(*) OVER w AS n, avg(v) OVER w AS m, stddev_samp(v) OVER w AS sd, sum(v) OVER w AS total, count(*) OVER o AS k, sum(v) OVER o AS early FROM p{i} JOIN d USING (a, b) WHERE month >= lo AND month < hi
  WINDOW w AS (PARTITION BY a, b, lo), o AS (PARTITION BY a, b, lo ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s{i} AS (
  SELECT * FROM (SELECT *, k * ((early / k - m) / sd) ** 2 + (n - k) * (((total - early) / (n - k) - m) / sd) ** 2 AS stat FROM x{i} WHERE k >= {homogenise.LEAST_SIDE} AND n - k >= {homogenise.LEAST_SIDE} AND sd > 0)
  QUALIFY row_number() OVER (PARTITION BY a, b, lo ORDER BY stat DESC, month) = 1 AND stat > {CRITICAL})""")
        out.append(f"p{i + 1} AS (SELECT a, b, lo, month AS hi FROM s{i} UNION ALL SELECT a, b, month, hi FROM s{i})")
    return ",\n".join(out)


SQL = {
    "pair_shift_log": f"""
WITH s AS ({_SERIES.format('l_suppkey')}), placed AS ({_PLACED}), near AS ({_NEAR}),
d AS (SELECT near.a, near.b, x.month, x.value - y.value AS v FROM near JOIN s x ON x.station = near.a JOIN s y ON y.station = near.b AND y.month = x.month),
{_sql_splits()},
hit AS ({" UNION ALL ".join(f"SELECT a, b, month FROM s{i}" for i in range(LEVELS))}),
begun AS (SELECT d.a, d.b, d.v, max(hit.month) AS since FROM d LEFT JOIN hit ON hit.a = d.a AND hit.b = d.b AND hit.month <= d.month GROUP BY d.a, d.b, d.month, d.v),
level AS (SELECT a, b, since, avg(v) AS m FROM begun GROUP BY ALL),
step AS (SELECT a, b, since AS month, m - lag(m) OVER (PARTITION BY a, b ORDER BY since NULLS FIRST) AS shift FROM level QUALIFY since IS NOT NULL),
vote AS (SELECT a AS station, b AS other, month, shift FROM step UNION ALL SELECT b, a, month, -shift FROM step),
run AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY month, other) AS run FROM (SELECT *, coalesce(month - lag(month) OVER (PARTITION BY station ORDER BY month, other) > 12, false)::INTEGER AS new FROM vote)),
mid AS (SELECT station, run, floor(quantile_cont(month, 0.5))::BIGINT AS month, quantile_cont(shift, 0.5) AS shift, count(DISTINCT other) AS n FROM run GROUP BY station, run),
degree AS (SELECT station, count(DISTINCT other) AS degree FROM (SELECT a AS station, b AS other FROM near UNION ALL SELECT b, a FROM near) GROUP BY 1)
SELECT station, month, round(shift, 5) AS shift, n AS n_neighbours FROM mid JOIN degree USING (station) WHERE n >= 2 AND 2 * n > degree""",
    "strongest_pair_shift": f"""
WITH s AS ({_SERIES.format('l_suppkey')}), placed AS ({_PLACED}), p AS ({_NEAR}),
d AS (SELECT p.a, p.b, x.month, x.value - y.value AS v FROM p JOIN s x ON x.station = p.a JOIN s y ON y.station = p.b AND y.month = x.month),
cut AS (SELECT t.a, t.b, t.month, avg(o.v) FILTER (WHERE o.month < t.month) AS m1, avg(o.v) FILTER (WHERE o.month >= t.month) AS m2, count(*) FILTER (WHERE o.month < t.month) AS n1, count(*) FILTER (WHERE o.month >= t.month) AS n2, avg(o.v) AS m, var_samp(o.v) AS var
  FROM d t JOIN d o ON o.a = t.a AND o.b = t.b GROUP BY ALL),
stat AS (SELECT *, (n1 * (m1 - m) ** 2 + n2 * (m2 - m) ** 2) / var AS stat FROM cut WHERE n1 >= 12 AND n2 >= 12 AND var > 0)
SELECT a, b, month, round(stat, 5) AS stat, round(m2 - m1, 5) AS shift FROM stat QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY stat DESC, month) = 1""",
    "neighbourhood_mix": f"""
WITH placed AS ({_PLACED}), p AS ({_NEAR}), e AS (SELECT a AS station, b AS other FROM p UNION SELECT b, a FROM p)
SELECT station, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY station), 9) AS share FROM e JOIN placed ON k = other GROUP BY station, label""",
    "long_memory_trend": f"""
WITH s AS ({_SERIES.format('l_returnflag')}),
f AS (SELECT station, count(*) AS n, min(month) AS m0, max(month) - min(month) + 1 AS span, regr_slope(value, month / 120.0) AS slope, regr_intercept(value, month / 120.0) AS cut, regr_sxx(value, month / 120.0) AS sxx, avg(month / 120.0) AS mx FROM s GROUP BY 1),
r AS (SELECT s.station, month - m0 AS pos, value - cut - slope * month / 120.0 AS e, (month / 120.0 - mx) / sxx AS w, span FROM s JOIN f USING (station)),
g AS (SELECT station, j, span, sum(e * cos(2 * pi() * j * pos / span)) ** 2 + sum(e * sin(2 * pi() * j * pos / span)) ** 2 AS power FROM r, generate_series(1, 100) q(j) WHERE j <= floor(sqrt(span)) GROUP BY ALL),
h AS (SELECT station, least(0.49, greatest(0.0, -regr_slope(ln(power), ln(4 * sin(pi() * j / span) ** 2)))) AS d FROM g GROUP BY 1),
k AS (SELECT station, lag, product(CASE WHEN lag = 0 THEN 1.0 ELSE (lag - 1 + d) / (lag - d) END) OVER (PARTITION BY station ORDER BY lag) AS rho FROM h JOIN f USING (station), generate_series(0, 1000) q(lag) WHERE lag < span),
v AS (SELECT x.station, sum(x.w * y.w * rho) AS spread FROM r x JOIN r y USING (station) JOIN k ON k.station = x.station AND k.lag = abs(x.pos - y.pos) GROUP BY 1),
q AS (SELECT station, sum(e * e) AS rss FROM r GROUP BY 1)
SELECT station, round(slope, 5) AS slope, round(sqrt(greatest(rss / (n - 2) * spread, 0)), 5) AS stderr, round(d, 5) AS d, n FROM f JOIN h USING (station) JOIN v USING (station) JOIN q USING (station)""",
}
QUERIES = {name: globals()[name] for name in SQL}
