"""Queries on features, cohorts and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.draws import sql_draw
from isohyet.operators import analysis, features, trend
from isohyet.plans.tables import SQL_KM, SQL_LAT, SQL_LON, lat, lon, table
from isohyet.sources import inventory


def tag_kind(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    value = F.when(k % 7 == 0, "helipad").when(k % 7 == 1, "airstrip").when(k % 4 == 0, "runway").when(k % 4 == 1, "gate").when(k % 4 == 2, "taxiway").otherwise("aerodrome")
    tags = F.create_map(F.when(k % 3 == 0, "aeroway").when(k % 3 == 1, "disused:aeroway").otherwise("name"), value, F.lit("abandoned:aeroway"), F.when(k % 5 == 0, "apron").otherwise("none"))
    return table(spark, d, "events").select("event_id", features.tag_kind(tags).alias("kind"))


def symbol_blobs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.floor((lat("c_custkey") - 50) / 0.25).cast("int").alias("row"), F.floor((lon("c_custkey") + 6) / 0.25).cast("int").alias("col"))
    return features.blobs(c).select("blob", "n", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), F.round("solidity", 6).alias("solidity"))


def matched_controls(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), lat("s_suppkey").alias("lat"), lon("s_suppkey").alias("lon"), (F.col("s_suppkey") * 7 % 300 / 100).cast("int").alias("height_band"))
    out = analysis.matched_controls(s.where("id % 2 = 0"), s.where("id % 2 = 1"), ["height_band"], 400.0, 2)
    return out.select("treated", "control", F.col("nth").cast("long").alias("nth"), F.round("km", 3).alias("km"))


def matched_pair_effect(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of even and odd number in the same band of height and, where both are known, of the same era: the difference of their slopes."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("id"), lat("s_suppkey").alias("lat"), lon("s_suppkey").alias("lon"), (k * 7 % 300 / 100).cast("int").alias("height_band"), F.when(k % 5 != 0, k % 3).alias("era"))
    pairs = analysis.matched_controls(s.where("id % 2 = 0"), s.where("id % 2 = 1"), ["height_band"], 400.0, 2, ("era",))
    slopes = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.regr_slope("l_extendedprice", "l_quantity").alias("value"))
    out = analysis.matched_effect(pairs, slopes.withColumn("value", F.when(F.col("id") % 17 != 0, F.col("value")).otherwise(float("nan"))))
    return out.select(F.round("effect", 5).alias("effect"), F.round("stderr", 5).alias("stderr"), "n_pairs", "n_controls")


def station_means(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.dayofmonth("ts"))
    return analysis.station_means(e, "day", "user_id", "value").select("day", F.round("by_station", 5).alias("by_station"), F.round("by_count", 5).alias("by_count"))


def equal_area_mean(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(lat("c_custkey").alias("lat"), lon("c_custkey").alias("lon"), "c_acctbal")
    return analysis.equal_area_mean(c, "lat", "lon", "c_acctbal", 1.0).select("n_cells", F.round("mean", 4).alias("mean"))


def event_time(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    treated = F.when(F.col("o_custkey") % 4 != 0, 1996 + F.col("o_custkey") % 4)
    out = analysis.event_time(o, F.year("o_orderdate"), treated, "o_totalprice")
    return out.select("event_year", "n", F.round("mean", 3).alias("mean"))


def extrema_gap(spark: SparkSession, d: str) -> DataFrame:
    daily = analysis.daily_extrema(table(spark, d, "events"), "user_id", "ts", "value")
    step = (F.col("user_id") % 7 - 3) * 0.5
    reported = daily.where("user_id % 11 <> 0").select("user_id", "day", (F.col("low") + step).alias("low"), (F.col("high") - step).alias("high"))
    out = analysis.extrema_gap(daily, reported, "user_id")
    return out.select("n_days", "n_inverted", F.round("mean_low_gap", 6).alias("mean_low_gap"), F.round("mean_high_gap", 6).alias("mean_high_gap"))


def pair_slopes_mean(spark: SparkSession, d: str) -> DataFrame:
    """Even suppliers drawn against odd ones; the mean over pairs of the differences of their slopes, some of them missing or NaN."""
    s = table(spark, d, "supplier")
    key = lambda odd: s.where(F.col("s_suppkey") % 2 == odd).select("s_suppkey")
    pairs = trend.make_pairs(key(0), key(1), seed=3)
    slopes = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"))
    of = lambda name: slopes.select(F.col("l_suppkey").alias(name), F.col("b").alias(f"b_{name}"))
    slope = F.when(F.col("pair") % 7 == 0, F.lit(None)).when(F.col("pair") % 11 == 0, float("nan")).otherwise(F.col("b_a") - F.col("b_b"))
    fits = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("slope", slope)
    return trend.pair_mean(fits).select("n_pairs", F.round("mean_slope", 6).alias("mean_slope"), F.round("se", 6).alias("se"))


def boundary_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of boundaries from properties of other names and cases, some of them missing."""
    k = F.col("c_custkey")
    code = lambda prefix: F.concat(F.lit(prefix), k)
    properties = (
        F.when(k % 5 == 0, F.create_map(F.lit("name"), F.col("c_name"), F.lit("wd91cd"), code("A"), F.lit("WD91CDO"), code("B")))
        .when(k % 5 == 1, F.create_map(F.lit("ward21CD"), code("C"), F.lit("aaCD"), code("D")))
        .when(k % 5 == 2, F.create_map(F.lit("xcdo"), F.lit(None).cast("string"), F.lit("ycd"), code("E")))
        .when(k % 5 == 3, F.create_map(F.lit("code"), code("F"), F.lit("cdx"), code("G")))
    )
    return table(spark, d, "customer").withColumn("properties", properties).select("c_custkey", inventory.boundary_code().alias("code"))


def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("bigint")
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("series"), month.alias("month")).agg(F.avg("l_quantity").alias("value"))
    return analysis.block_bootstrap(s, "series", "month", "value").select("series", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")])


def covering_set(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    present = docs.where("name % 17 <> 3").select(F.when(F.col("name") % 23 == 5, -F.col("name") - 1).otherwise(F.col("name")).alias("name"), F.when(F.col("name") % 13 == 2, "0").otherwise(F.col("digest")).alias("digest"))
    return analysis.covering_set(docs, present)


def record_length_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Orders by segment and year with totals, for reports."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return j.rollup("segment", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


SQL = {
    "pair_slopes_mean": f"""
WITH r AS (SELECT s_suppkey AS k, s_suppkey % 2 AS odd, row_number() OVER (PARTITION BY s_suppkey % 2 ORDER BY {sql_draw('3', 's_suppkey')}, s_suppkey) AS pair FROM supplier),
b AS (SELECT l_suppkey AS k, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY 1),
s AS (SELECT x.pair, p.b - q.b AS slope FROM r x JOIN r y ON x.odd = 0 AND y.odd = 1 AND x.pair = y.pair LEFT JOIN b p ON p.k = x.k LEFT JOIN b q ON q.k = y.k WHERE x.pair % 7 <> 0 AND x.pair % 11 <> 0)
SELECT count(slope) AS n_pairs, round(avg(slope), 6) AS mean_slope, round(stddev_samp(slope) / sqrt(count(slope)), 6) AS se FROM s""",
    "boundary_codes": "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'B' || c_custkey WHEN 1 THEN 'D' || c_custkey WHEN 2 THEN 'E' || c_custkey END AS code FROM customer",
    "block_bootstrap": f"""
WITH q AS (SELECT l_returnflag AS g, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS month, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
s AS (SELECT g, floor(month / 24) AS k, sum(v) AS s, count(*) AS n FROM q GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM s),
p AS (SELECT g, b, {sql_draw('1', 'g', 'b', 'i')} % m AS pick FROM r, range(100) t(b)),
x AS (SELECT p.g, b, sum(s) / sum(n) AS x FROM p JOIN r ON p.g = r.g AND pick = r.i GROUP BY ALL)
SELECT g AS series, round(any_value(mean), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS lower, round(quantile_cont(x, 0.975), 6) AS upper FROM x JOIN (SELECT g, sum(s) / sum(n) AS mean FROM s GROUP BY g) USING (g) GROUP BY g""",
    "tag_kind": """
WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'helipad' WHEN event_id % 7 = 1 THEN 'airstrip' WHEN event_id % 4 = 0 THEN 'runway' WHEN event_id % 4 = 1 THEN 'gate' WHEN event_id % 4 = 2 THEN 'taxiway' ELSE 'aerodrome' END AS v FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 AND v IN ('aerodrome', 'runway', 'taxiway', 'apron') THEN v WHEN event_id % 3 = 1 AND v IN ('aerodrome', 'runway', 'taxiway', 'apron') THEN 'disused:' || v WHEN event_id % 5 = 0 THEN 'abandoned:apron' END AS kind FROM t""",
    "symbol_blobs": f"""
WITH RECURSIVE c AS (SELECT DISTINCT floor(({SQL_LAT.format('c_custkey')} - 50) / 0.25)::BIGINT AS row, floor(({SQL_LON.format('c_custkey')} + 6) / 0.25)::BIGINT AS col FROM customer),
k AS (SELECT *, row * 2147483648 + col AS id FROM c),
e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT node, min(reach) AS blob FROM r GROUP BY node)
SELECT blob, count(*) AS n, max(row) - min(row) + 1 AS height, max(col) - min(col) + 1 AS width, round(count(*) / ((max(row) - min(row) + 1) * (max(col) - min(col) + 1)), 6) AS solidity FROM m JOIN k ON id = node GROUP BY blob""",
    "matched_controls": f"""
WITH s AS (SELECT s_suppkey AS id, {SQL_LAT.format('s_suppkey')} AS lat, {SQL_LON.format('s_suppkey')} AS lon, s_suppkey * 7 % 300 // 100 AS band FROM supplier),
n AS (SELECT t.id AS treated, c.id AS control, {SQL_KM.format('t.lat', 't.lon', 'c.lat', 'c.lon')} AS km FROM s t JOIN s c ON t.id % 2 = 0 AND c.id % 2 = 1 AND t.band = c.band),
r AS (SELECT *, row_number() OVER (PARTITION BY treated ORDER BY km, control) AS nth FROM n WHERE km <= 400)
SELECT treated, control, nth, round(km, 3) AS km FROM r WHERE nth <= 2""",
    "matched_pair_effect": f"""
WITH s AS (SELECT s_suppkey AS id, {SQL_LAT.format('s_suppkey')} AS lat, {SQL_LON.format('s_suppkey')} AS lon, s_suppkey * 7 % 300 // 100 AS band, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 3 END AS era FROM supplier),
n AS (SELECT t.id AS treated, c.id AS control, {SQL_KM.format('t.lat', 't.lon', 'c.lat', 'c.lon')} AS km FROM s t JOIN s c ON t.id % 2 = 0 AND c.id % 2 = 1 AND t.band = c.band AND (t.era = c.era OR t.era IS NULL OR c.era IS NULL)),
r AS (FROM n WHERE km <= 400 QUALIFY row_number() OVER (PARTITION BY treated ORDER BY km, control) <= 2),
v AS (SELECT l_suppkey AS id, regr_slope(l_extendedprice, l_quantity) AS v FROM lineitem WHERE l_suppkey % 17 <> 0 GROUP BY 1),
e AS (SELECT control, x.v - y.v AS d, 1.0 / count(*) OVER (PARTITION BY control) AS w FROM r JOIN v x ON x.id = treated JOIN v y ON y.id = control),
m AS (SELECT sum(w * d) / sum(w) AS b, sum(w) AS sw FROM e),
g AS (SELECT sum(w * (d - b)) AS q FROM e, m GROUP BY control)
SELECT round(any_value(b), 5) AS effect, round(sqrt(sum(q * q) * count(*) / (count(*) - 1)) / any_value(sw), 5) AS stderr, (SELECT count(*) FROM e) AS n_pairs, count(*) AS n_controls FROM g, m""",
    "station_means": """
WITH p AS (SELECT day(ts)::INTEGER AS day, user_id, avg(value) AS m, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL)
SELECT day, round(avg(m), 5) AS by_station, round(sum(s) / sum(n), 5) AS by_count FROM p GROUP BY day""",
    "equal_area_mean": f"""
WITH c AS (SELECT floor({SQL_LAT.format('c_custkey')}) AS i, floor({SQL_LON.format('c_custkey')}) AS j, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) >= 2)
SELECT count(*) AS n_cells, round(sum(cos(radians(i + 0.5)) * m) / sum(cos(radians(i + 0.5))), 4) AS mean FROM c""",
    "event_time": """
SELECT year(o_orderdate) - (1996 + o_custkey % 4) AS event_year, count(o_totalprice) AS n, round(avg(o_totalprice), 3) AS mean FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1""",
    "extrema_gap": """
WITH d AS (SELECT user_id, ts::DATE AS day, min(value) AS low, max(value) AS high FROM events GROUP BY ALL),
g AS (SELECT low, high, low + (user_id % 7 - 3) * 0.5::DOUBLE AS r_low, high - (user_id % 7 - 3) * 0.5::DOUBLE AS r_high FROM d WHERE user_id % 11 <> 0)
SELECT count(*) AS n_days, count(*) FILTER (WHERE r_low > r_high) AS n_inverted, round(avg(r_low - low), 6) AS mean_low_gap, round(avg(r_high - high), 6) AS mean_high_gap FROM g""",
    "covering_set": """
WITH e AS (SELECT doc_id AS name, sha256(coalesce(text, '')) AS digest FROM documents),
p AS (SELECT CASE WHEN name % 23 = 5 THEN -name - 1 ELSE name END AS name, CASE WHEN name % 13 = 2 THEN '0' ELSE digest END AS digest FROM e WHERE name % 17 <> 3)
SELECT CASE WHEN p.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unlisted' WHEN e.digest <> p.digest THEN 'changed' ELSE 'ok' END AS status, count(*) AS n FROM e FULL JOIN p ON e.name = p.name GROUP BY 1""",
    "record_length_rollup": """
SELECT c_mktsegment AS segment, year(o_orderdate)::INTEGER AS year, count(*) AS n, round(sum(o_totalprice), 1) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (segment, year)""",
}
QUERIES = {name: globals()[name] for name in SQL}
