"""Queries on trends, audits and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.draws import sql_draw
from isohyet.operators import audit, inference, trend
from isohyet.plans.tables import table

BREAK = 36.0  # months after January 1995: the start of 1998


def _series(spark: SparkSession, d: str) -> DataFrame:
    """(series, month, value): mean quantity by return flag and month of shipping, counted from January 1995; some months are missing, NaN or infinite."""
    l = table(spark, d, "lineitem")
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("bigint")
    s = l.groupBy(F.col("l_returnflag").alias("series"), month.alias("month")).agg(F.avg("l_quantity").alias("value"))
    nth = F.pmod("month", F.lit(17))
    return s.withColumn("value", F.when(nth == 3, F.lit(None)).when(nth == 7, float("nan")).when(nth == 11, float("-inf")).otherwise(F.col("value")))


def _breaks(series: DataFrame, key: str = "series") -> DataFrame:
    return series.select(key).distinct().withColumn("months", F.array(F.lit(BREAK)))


def _rounded(fits: DataFrame, key: str) -> DataFrame:
    return fits.select(key, F.round("slope", 5).alias("slope"), F.round("stderr", 5).alias("stderr"), "n", F.col("n_breaks").cast("long").alias("n_breaks"))


def monthly_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return trend.monthly_anomalies(_series(spark, d)).select("series", "month", F.round("anomaly", 6).alias("anomaly"))


def break_trend_fit(spark: SparkSession, d: str) -> DataFrame:
    s = _series(spark, d)
    return _rounded(trend.break_trend(trend.monthly_anomalies(s), _breaks(s)), "series")


def paired_difference_trend(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier of even key against the next of odd key, with a break for both at the start of 1998."""
    l = table(spark, d, "lineitem")
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("bigint")
    s = l.groupBy(F.col("l_suppkey").alias("station"), month.alias("month")).agg(F.avg("l_quantity").alias("value"))
    pairs = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select((F.col("s_suppkey") / 2).cast("bigint").alias("pair"), F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return _rounded(trend.paired_difference(s, pairs, _breaks(s, "station")), "pair")


def naive_split_slope(spark: SparkSession, d: str) -> DataFrame:
    return trend.split_slopes(_series(spark, d), BREAK).select("series", F.round("naive_slope", 5).alias("naive_slope"))


def theil_sen(spark: SparkSession, d: str) -> DataFrame:
    return trend.theil_sen(_series(spark, d)).select("series", F.round("slope", 5).alias("slope"), "n_pairs")


def clustered_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    b = trend.clustered_bootstrap(table(spark, d, "lineitem"), "l_suppkey", "l_quantity")
    return b.select(*[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")])


def day_density_histogram(spark: SparkSession, d: str) -> DataFrame:
    return audit.day_density(table(spark, d, "events"), "user_id", "ts").select("bin", "n_days", F.round("share", 6).alias("share"))


def _effects(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"))
    step = (F.col("event_id") % 7 - 3) * (F.col("event_id") % 5) * 1.5
    nan = F.lit(float("nan"))
    before = e.where("event_id % 9 <> 0").withColumn("value", F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, nan).when(F.col("event_id") % 4 == 0, F.col("value") + step).otherwise(F.col("value")))
    e = e.withColumn("value", F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 14 == 0, nan).otherwise(F.col("value")))
    return audit.qc_effects(before, e, ["user_id", "event_type", "day"], "value", [F.col("event_id")])


def qc_identity_join(spark: SparkSession, d: str) -> DataFrame:
    x = _effects(spark, d).withColumn("band", F.when(F.col("changed"), audit.banded(F.round(F.abs("delta"), 6), audit.MAGNITUDES, ">20")))
    return x.groupBy("matched", F.coalesce("band", "outcome").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("delta"), 4).alias("delta"))


def qc_two_part(spark: SparkSession, d: str) -> DataFrame:
    """By kind of event and decade of days of the month."""
    t = audit.two_part(_effects(spark, d).withColumn("part", F.struct("event_type", F.expr("day(day) div 10").alias("decade"))), "part")
    return t.select("part.event_type", "part.decade", "n", "n_created", "n_deleted", "n_changed", *[F.round(c, 6).alias(c) for c in ("p_changed", "mean_when_changed", "mean_delta")])


def flag_decode(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), (F.col("event_id") % 100).cast("string"))).otherwise((F.col("event_id") * 13 % 200000).cast("string"))
    return table(spark, d, "events").select("event_id", *[(c.try_cast("int") if n != "residual" else c).alias(n) for n, c in _flag(flag).items()])


def _flag(flag: F.Column) -> dict:
    digits = audit.flag_digits(flag)
    padded = F.lpad(flag, 5, "0")
    return {n: (F.substring(padded, int(n[1]), 1) if n != "residual" else c) for n, c in digits.items()}


def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    p = (F.col("o_orderkey") * 7919 % 100003 / F.lit(100003.0)) * F.when(F.col("o_orderkey") % 10 == 0, 0.0001).otherwise(1.0)
    p = F.when(F.col("o_orderkey") % 23 == 0, F.lit(None)).when(F.col("o_orderkey") % 29 == 0, float("nan")).otherwise(p)
    tests = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", p.alias("p"))
    return inference.benjamini_hochberg(tests, "o_orderkey", "p", 0.05, "o_orderpriority").select("o_orderkey", F.col("rank").cast("long").alias("rank"), "significant")


def familywise_tolerance(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    out = inference.familywise_tolerance(p, "p_brand", (F.col("p_retailprice") - 1000) / (F.col("p_size") + 1))
    return out.select(F.round("critical", 6).alias("critical"), "n_draws")


def agreement_vote(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    layers = table(spark, d, "customer").select("c_custkey", F.when(k % 5 != 0, k % 2 == 0).alias("builtup"), F.when(k % 7 != 0, k % 3 == 0).alias("landuse"), (k % 11 == 0).alias("airfield"))
    out = inference.agreement(layers, ["builtup", "landuse", "airfield"], ["airfield"])
    return out.select("c_custkey", "status", F.col("voters").cast("long").alias("voters"), F.col("abstained").cast("long").alias("abstained"), "disagreeing")


def wind_terciles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("month", F.month("ts"))
    t = inference.terciles(e, ["user_id", "month"], "value", "event_id")
    return t.groupBy("user_id", F.col("tercile").cast("long").alias("tercile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean"))


def top_movers(spark: SparkSession, d: str) -> DataFrame:
    """The seven customers whose spending grew most from 1995 to 2000, of those with orders in both years."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    g = o.groupBy("o_custkey").agg(F.sum(F.when(F.col("y") == 1995, F.col("o_totalprice"))).alias("a"), F.sum(F.when(F.col("y") == 2000, F.col("o_totalprice"))).alias("b"))
    return g.where("a is not null and b is not null").select("o_custkey", F.round(F.col("b") - F.col("a"), 2).alias("growth")).orderBy(F.desc("growth"), "o_custkey").limit(7)


def decade_bars(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy((F.floor(F.year("o_orderdate") / 10) * 10).cast("int").alias("decade")).agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"))


_MONTH = "((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT"
_SERIES = f"SELECT l_returnflag AS series, {_MONTH} AS month, CASE WHEN ({_MONTH} % 17 + 17) % 17 NOT IN (3, 7, 11) THEN avg(l_quantity) END AS value FROM lineitem GROUP BY 1, 2"
_ANOMALY = "SELECT {by}, month, CASE WHEN count(value) OVER w >= 3 THEN value - avg(value) OVER w END AS y FROM {of} WINDOW w AS (PARTITION BY {by}, month % 12)"


def _sql_fit(by: str) -> str:
    """Over a table an(by, month, y)."""
    return f"""
v AS (SELECT {by}, month AS t, y, min(month) OVER (PARTITION BY {by}) AS t0, max(month) OVER (PARTITION BY {by}) AS t1 FROM an WHERE y IS NOT NULL),
k AS (SELECT *, (t - t0) / 120.0::DOUBLE AS x, CASE WHEN t0 < {BREAK} AND {BREAK} < t1 THEN 1 ELSE 0 END AS nb FROM v),
g AS (SELECT *, CASE WHEN nb = 1 AND t >= {BREAK} THEN 1 ELSE 0 END AS seg FROM k),
c AS (SELECT *, x - avg(x) OVER s AS xd, y - avg(y) OVER s AS yd FROM g WINDOW s AS (PARTITION BY {by}, seg)),
b AS (SELECT *, sum(xd * yd) OVER p / nullif(sum(xd * xd) OVER p, 0) AS slope FROM c WINDOW p AS (PARTITION BY {by})),
r AS (SELECT *, yd - slope * xd AS resid FROM b),
q AS (SELECT *, lag(resid) OVER (PARTITION BY {by} ORDER BY t) AS before FROM r),
z AS (SELECT {by}, any_value(slope) AS slope, count(*) AS n, max(nb)::BIGINT AS n_breaks, sum(resid * resid) AS rss, sum(xd * xd) AS sxx, corr(resid, before) AS cr FROM q GROUP BY {by}),
e AS (SELECT *, CASE WHEN n < 10 THEN n ELSE n * (1 - greatest(0, least(0.99, cr))) / (1 + greatest(0, least(0.99, cr))) END AS neff FROM z)
SELECT {by}, CASE WHEN n >= 24 THEN round(slope, 5) END AS slope, CASE WHEN n >= 24 AND neff > n_breaks + 3 THEN round(sqrt(rss / (neff - n_breaks - 2) / sxx * n / neff), 5) END AS stderr, n, n_breaks FROM e"""


_EFFECTS = """
k AS (SELECT event_id, user_id, event_type, value, ts::DATE AS day FROM events),
a AS (SELECT * REPLACE (CASE WHEN event_id % 10 <> 0 AND event_id % 14 <> 0 THEN value END AS value) FROM k QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY event_id) = 1),
p AS (SELECT event_id, user_id, event_type, day, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL WHEN event_id % 4 = 0 THEN value + (event_id % 7 - 3) * (event_id % 5) * 1.5::DOUBLE ELSE value END AS value FROM k WHERE event_id % 9 <> 0),
b AS (FROM p QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY event_id) = 1),
o AS (SELECT a.event_type, day(a.day) // 10 AS decade, b.event_id IS NOT NULL AS matched, a.value - b.value AS d, CASE WHEN b.event_id IS NULL THEN 'unmatched' WHEN b.value IS NULL AND a.value IS NOT NULL THEN 'created' WHEN a.value IS NULL AND b.value IS NOT NULL THEN 'deleted' WHEN a.value <> b.value THEN 'changed' ELSE 'unchanged' END AS outcome FROM a LEFT JOIN b USING (user_id, event_type, day)),
x AS (SELECT *, CASE WHEN outcome = 'changed' THEN d WHEN outcome NOT IN ('created', 'deleted') THEN 0.0 END AS delta FROM o)"""

SQL = {
    "monthly_anomaly": f"WITH s AS ({_SERIES}), an AS ({_ANOMALY.format(by='series', of='s')}) SELECT series, month, round(y, 6) AS anomaly FROM an",
    "break_trend_fit": f"WITH s AS ({_SERIES}), an AS ({_ANOMALY.format(by='series', of='s')}), {_sql_fit('series')}",
    "paired_difference_trend": f"""
WITH m AS (SELECT l_suppkey AS k, {_MONTH} AS month, avg(l_quantity) AS value FROM lineitem GROUP BY ALL),
s AS (SELECT a.k // 2 AS pair, a.month, a.value - b.value AS value FROM m a JOIN m b ON b.k = a.k + 1 AND b.month = a.month WHERE a.k % 2 = 0 AND a.k IN (SELECT s_suppkey FROM supplier)),
an AS ({_ANOMALY.format(by='pair', of='s')}), {_sql_fit('pair')}""",
    "naive_split_slope": f"""
WITH s AS ({_SERIES}), h AS (SELECT series, month >= {BREAK} AS late, regr_slope(value, month / 120.0::DOUBLE) AS b FROM s GROUP BY ALL)
SELECT series, round(avg(b), 5) AS naive_slope FROM h GROUP BY series""",
    "theil_sen": f"""
WITH s AS ({_SERIES})
SELECT a.series, round(quantile_cont((b.value - a.value) / (b.month - a.month), 0.5) * 120, 5) AS slope, count(*) AS n_pairs FROM s a JOIN s b ON a.series = b.series AND a.month < b.month WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1""",
    "day_density_histogram": """
WITH d AS (SELECT count(*) AS n FROM events GROUP BY user_id, ts::DATE),
b AS (SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 11 THEN '4-11' WHEN n <= 19 THEN '12-19' ELSE '20-24' END AS bin, count(*) AS n_days FROM d GROUP BY 1)
SELECT bin, n_days, round(n_days / sum(n_days) OVER (), 6) AS share FROM b""",
    "qc_identity_join": f"""
WITH {_EFFECTS},
y AS (SELECT *, CASE WHEN outcome <> 'changed' THEN outcome WHEN round(abs(delta), 6) <= 0.2 THEN '<=0.2' WHEN round(abs(delta), 6) <= 1 THEN '0.2-1' WHEN round(abs(delta), 6) <= 5 THEN '1-5' WHEN round(abs(delta), 6) <= 20 THEN '5-20' ELSE '>20' END AS band FROM x)
SELECT matched, band, count(*) AS n, round(sum(delta), 4) AS delta FROM y GROUP BY ALL""",
    "qc_two_part": f"""
WITH {_EFFECTS}
SELECT event_type, decade, count(delta) AS n, count(*) FILTER (WHERE outcome = 'created') AS n_created, count(*) FILTER (WHERE outcome = 'deleted') AS n_deleted, count(*) FILTER (WHERE outcome = 'changed') AS n_changed,
       round(count(*) FILTER (WHERE outcome = 'changed') / nullif(count(delta), 0), 6) AS p_changed, round(avg(delta) FILTER (WHERE outcome = 'changed'), 6) AS mean_when_changed, round(avg(delta), 6) AS mean_delta FROM x GROUP BY ALL""",
    "flag_decode": """
WITH f AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'x' || (event_id % 100) ELSE (event_id * 13 % 200000)::VARCHAR END AS flag FROM events),
p AS (SELECT *, CASE WHEN length(flag) > 5 THEN substr(flag, 1, 5) ELSE lpad(flag, 5, '0') END AS z FROM f)
SELECT event_id, try_cast(z[1] AS INTEGER) AS d1, try_cast(z[2] AS INTEGER) AS d2, try_cast(z[3] AS INTEGER) AS d3, try_cast(z[4] AS INTEGER) AS d4, try_cast(z[5] AS INTEGER) AS d5,
       CASE WHEN length(flag) > 5 THEN 'overlong' WHEN regexp_full_match(z, '[0-9]{5}') THEN 'clean' ELSE 'malformed' END AS residual FROM p""",
    "bh_fdr": """
WITH t AS (SELECT o_orderkey, o_orderpriority AS f, (o_orderkey * 7919 % 100003 / 100003.0::DOUBLE) * CASE WHEN o_orderkey % 10 = 0 THEN 0.0001::DOUBLE ELSE 1.0::DOUBLE END AS p FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p, o_orderkey) AS rank, count(*) OVER (PARTITION BY f) AS m FROM t WHERE o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0),
k AS (SELECT *, max(CASE WHEN p <= rank * 0.05::DOUBLE / m THEN rank END) OVER (PARTITION BY f) AS top FROM r)
SELECT o_orderkey, rank, coalesce(rank <= top, false) AS significant FROM t LEFT JOIN k USING (o_orderkey)""",
    "familywise_tolerance": """
WITH w AS (SELECT max(abs((p_retailprice - 1000) / (p_size + 1))) AS worst FROM part GROUP BY p_brand)
SELECT round(quantile_cont(worst, 0.99), 6) AS critical, count(*) AS n_draws FROM w""",
    "agreement_vote": """
WITH l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 2 = 0 END AS a, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 3 = 0 END AS b, CASE WHEN c_custkey % 11 = 0 THEN true END AS c FROM customer),
n AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n, coalesce(a, false)::INT + coalesce(b, false)::INT + coalesce(c, false)::INT AS yes FROM l),
s AS (SELECT *, CASE WHEN n = 0 THEN 'unclassified' WHEN yes = n OR yes = 0 THEN 'confirmed' ELSE 'disputed' END AS status, yes * 2 < n AS minority FROM n)
SELECT k AS c_custkey, status, n::BIGINT AS voters, (3 - n)::BIGINT AS abstained,
       CASE WHEN status = 'disputed' THEN concat_ws(';', CASE WHEN a = minority THEN 'builtup' END, CASE WHEN b = minority THEN 'landuse' END, CASE WHEN c = minority THEN 'airfield' END) ELSE '' END AS disagreeing FROM s""",
    "clustered_bootstrap": f"""
WITH s AS (SELECT l_suppkey AS c, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS size FROM s),
p AS (SELECT b, {sql_draw('1', 'b', 'i')} % size AS pick FROM r, range(200) t(b)),
m AS (SELECT b, sum(s) / sum(n) AS m FROM p JOIN r ON pick = i GROUP BY b)
SELECT (SELECT round(sum(s) / sum(n), 6) FROM s) AS mean, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM m""",
    "wind_terciles": """
WITH t AS (SELECT user_id, value, ntile(3) OVER (PARTITION BY user_id, month(ts) ORDER BY value, event_id) AS tercile FROM events)
SELECT user_id, tercile, count(*) AS n, round(avg(value), 5) AS mean FROM t GROUP BY ALL""",
    "top_movers": """
WITH g AS (SELECT o_custkey, sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1995) AS a, sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 2000) AS b FROM orders GROUP BY 1)
SELECT o_custkey, round(b - a, 2) AS growth FROM g WHERE a IS NOT NULL AND b IS NOT NULL ORDER BY growth DESC, o_custkey LIMIT 7""",
    "decade_bars": "SELECT (year(o_orderdate) // 10 * 10)::INTEGER AS decade, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
