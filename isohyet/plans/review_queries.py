"""Queries on scenes, site layers, ledgers, classes of stations, profiles and joins of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions import bands, geo
from isohyet.operators import analysis, features, inference
from isohyet.plans.tables import SQL_LAT, SQL_LON, lat, lon, table
from isohyet.sources import inventory


def scene_search(spark: SparkSession, d: str) -> DataFrame:
    """Line items as scenes: spelt platforms, covers that are unknown or high, missing bands, years before the first sensor."""
    l, k = table(spark, d, "lineitem"), F.col("l_orderkey")
    platform = F.when(k % 4 == 0, "LANDSAT_7").when(k % 4 == 1, "landsat-5").when(k % 4 == 2, "Landsat-8").otherwise("landsat_4")
    listed = F.array(*map(F.lit, bands.BANDS))
    scenes = l.select(
        (k * 10 + F.col("l_linenumber")).alias("scene_id"), F.make_date(F.year("l_shipdate") - k % 3 * 10, F.month("l_shipdate"), F.lit(1)).alias("day"), platform.alias("platform"),
        F.when(k % 9 != 0, (k * 7 % 100).cast("double")).alias("cloud_cover"), F.when(k % 5 == 0, F.slice(listed, 1, 3)).otherwise(F.concat(listed, F.array(F.lit("blue")))).alias("assets"),
    )
    found = inventory.search_scenes(scenes)
    return found.select("scene_id", "day", bands.sensor(F.col("platform")).alias("sensor"), "cloud_cover")


def scene_reasons(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    reason = bands.composite_reason(bands.decade(1970 + k % 50), k % 5, k % 7 != 0, F.when(k % 11 != 0, (k % 10) / 10))
    return o.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def site_layers(spark: SparkSession, d: str) -> DataFrame:
    """Two layers of properties, one after the other."""
    props = lambda t, key, name: table(spark, d, t).select(F.map_filter(F.create_map(F.lit("ref_code"), F.col(key).cast("string"), F.lit("name"), F.col(name), F.lit("hyperlink"), F.when(F.col(key) % 2 == 0, F.concat(F.lit("  "), F.col(key).cast("string"), F.lit(" ")))), lambda _, v: v.isNotNull()).alias("properties"))
    return inventory.sites({"SSSI": props("customer", "c_custkey", "c_name"), "NNR": props("supplier", "s_suppkey", "s_name")})


def land_area_lookup(spark: SparkSession, d: str) -> DataFrame:
    layer = table(spark, d, "orders").select(F.col("o_custkey").alias("src_id"), F.when(F.col("o_orderkey") % 2 == 0, 10_000).otherwise(500).alias("ring_m"), (F.lit(2000) + F.col("o_orderkey") % 3 * 10).cast("int").alias("epoch"), F.col("o_totalprice").alias("land_m2"), "o_orderkey")
    one = layer.groupBy("src_id", "ring_m", "epoch").agg(F.max_by("land_m2", "o_orderkey").alias("land_m2"))
    return inventory.with_land_area(table(spark, d, "customer").select(F.col("c_custkey").alias("src_id")), one)


def units_by_code(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries with old codes: translated where a translation is known; unmatched ones stay without a population."""
    b = table(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "old-").otherwise(""), (F.col("c_custkey") % 40).cast("string")).alias("code"))
    t = spark.range(40).where("id % 4 <> 0").select(F.concat(F.lit("old-"), "id").alias("code"), F.col("id").cast("string").alias("to"))
    counts = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("GEOGRAPHY_CODE"), F.when(F.col("n_nationkey") % 6 == 0, " ").otherwise((F.col("n_nationkey") * 10).cast("string")).alias("OBS_VALUE"))
    return inventory.build_units(b, inventory.counts(counts), t)


def attrition_ledger(spark: SparkSession, d: str) -> DataFrame:
    rules = [("has-level", F.col("c_acctbal") > 0), ("not-automobile", F.col("c_mktsegment") != "AUTOMOBILE"), ("even", F.col("c_custkey") % 2 == 0), ("all", F.lit(True))]
    return analysis.attrition(table(spark, d, "customer"), rules)


def repair_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    e = table(spark, d, "events").select(F.when(k % 13 != 0, v).alias("low"), (v + k % 3 - 1).alias("high"), k.alias("k"))
    fixed = e.withColumns({"f_low": F.when(F.col("k") % 4 == 0, F.col("high")).when(F.col("k") % 4 != 1, F.col("low")), "f_high": F.when(F.col("k") % 4 == 0, F.col("low")).when(F.col("k") % 4 == 2, F.col("low") + 1).otherwise(F.col("high"))})
    return analysis.repairs(fixed, "low", "high", "f_low", "f_high")


def diurnal_profile(spark: SparkSession, d: str) -> DataFrame:
    out = analysis.diurnal_profile(table(spark, d, "events"), ["event_type"], "ts", "value")
    return out.select("event_type", "hour", F.round("mean", 6).alias("mean"), F.round("departure", 6).alias("departure"))


def dose_response(spark: SparkSession, d: str) -> DataFrame:
    out = analysis.dose_response(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), "n")


def year_spill(spark: SparkSession, d: str) -> DataFrame:
    """A line item's file is that of its order's year; items ship into the next."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select("o_orderpriority", "o_orderdate", "l_shipdate")
    return analysis.year_spill(j, "o_orderpriority", F.year("o_orderdate"), "l_shipdate")


def station_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    first, last = F.when(k % 8 != 0, (k * 7 % 40) / 100.0), F.when(k % 9 != 0, (k * 7 % 40 + k % 6) / 100.0)
    s = table(spark, d, "customer").select("c_custkey", first.alias("b75"), last.alias("b20"))
    return s.groupBy(analysis.built_class(F.col("b20")).alias("built"), analysis.growth_class(F.col("b75"), F.col("b20")).alias("growth")).agg(F.count(F.lit(1)).alias("n"))


def station_headline(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    s = table(spark, d, "customer").select(F.when(k % 8 != 0, 0.01).alias("b75"), F.when(k % 9 != 0, (k * 7 % 40) / 100.0).alias("b20"), (1900 + k % 60).alias("fy"), (1960 + k % 50).alias("ly"))
    return analysis.headline(s, "b75", "b20", "fy", "ly")


def filtered_blobs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.floor((lat("c_custkey") - 50) / 0.125).cast("int").alias("row"), F.floor((lon("c_custkey") + 6) / 0.125).cast("int").alias("col"))
    return features.blobs(c, 2, 40, 3.0, 0.5).select("blob", "n")


def pair_tolerances(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    worst = inference.familywise_tolerance(p, "p_brand", (F.col("p_retailprice") - 1000) / (F.col("p_size") + 1))
    spreads = p.groupBy("p_brand").agg(F.avg("p_size").alias("s"))
    return inference.tolerances(worst, spreads, "p_brand", "s").select("p_brand", F.round("tolerance", 5).alias("tolerance"))


def bh_fdr_one_family(spark: SparkSession, d: str) -> DataFrame:
    p = (F.col("o_orderkey") * 7919 % 100003 / F.lit(100003.0)) * F.when(F.col("o_orderkey") % 10 == 0, 0.0001).otherwise(1.0)
    out = inference.benjamini_hochberg(table(spark, d, "orders").select("o_orderkey", p.alias("p")), "o_orderkey", "p")
    return out.select("o_orderkey", F.col("rank").cast("long").alias("rank"), "significant")


def ring_boxes(spark: SparkSession, d: str) -> DataFrame:
    box = geo.ring_box(lat("s_suppkey"), lon("s_suppkey"), F.lit(10_000.0))
    return table(spark, d, "supplier").select("s_suppkey", *[F.round(box[c], 6).alias(c) for c in ("south", "west", "north", "east")])


def pilot_stations(spark: SparkSession, d: str) -> DataFrame:
    return inventory.pilot(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 5)


SQL = {
    "scene_search": """
WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS scene_id, make_date((year(l_shipdate) - l_orderkey % 3 * 10)::INTEGER, month(l_shipdate)::INTEGER, 1) AS day, l_orderkey % 4 AS p, CASE WHEN l_orderkey % 9 <> 0 THEN (l_orderkey * 7 % 100)::DOUBLE END AS cloud_cover, l_orderkey % 5 <> 0 AS ok FROM lineitem)
SELECT scene_id, day, CASE p WHEN 0 THEN 'ETM+' WHEN 2 THEN 'OLI' ELSE 'TM' END AS sensor, cloud_cover FROM s
WHERE ok AND cloud_cover < 70 AND month(day) BETWEEN 5 AND 9 AND year(day) >= 1984 AND CASE year(day) // 10 * 10 WHEN 1980 THEN p IN (1, 3) WHEN 1990 THEN p = 1 WHEN 2000 THEN p = 0 WHEN 2010 THEN p = 2 ELSE false END""",
    "scene_reasons": """
SELECT CASE WHEN 1970 + o_orderkey % 50 < 1980 THEN 'no-swir-sensor' WHEN o_orderkey % 5 < 2 THEN 'insufficient-clear-scenes' WHEN o_orderkey % 7 = 0 THEN 'no-scene-coverage'
  WHEN o_orderkey % 11 = 0 OR o_orderkey % 10 < 8 THEN 'insufficient-clear-coverage' END AS reason, count(*) AS n FROM orders GROUP BY 1""",
    "site_layers": """
SELECT c_custkey::VARCHAR AS ref_code, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE '' END AS hyperlink, 'SSSI' AS designation FROM customer
UNION ALL SELECT s_suppkey::VARCHAR, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR ELSE '' END, 'NNR' FROM supplier""",
    "land_area_lookup": """
WITH l AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS land FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 2 GROUP BY 1)
SELECT c_custkey AS src_id, coalesce(land, 0.0) AS land_m2 FROM customer LEFT JOIN l ON o_custkey = c_custkey""",
    "units_by_code": """
WITH b AS (SELECT c_custkey, c_custkey % 40 AS k, c_custkey % 3 = 0 AS old FROM customer),
t AS (SELECT *, CASE WHEN old AND k % 4 = 0 THEN 'old-' || k ELSE k::VARCHAR END AS code FROM b)
SELECT c_custkey, code, (n_nationkey * 10)::DOUBLE AS population FROM t LEFT JOIN nation ON code = n_nationkey::VARCHAR AND n_nationkey % 6 <> 0""",
    "attrition_ledger": """
WITH f AS (SELECT CASE WHEN NOT coalesce(c_acctbal > 0, false) THEN 1 WHEN NOT coalesce(c_mktsegment <> 'AUTOMOBILE', false) THEN 2 WHEN c_custkey % 2 <> 0 THEN 3 ELSE 0 END AS s FROM customer)
SELECT step, rule, count(s) FILTER (WHERE s = step) AS n_lost, count(s) FILTER (WHERE s = 0 OR s > step) AS n_left FROM f, (VALUES (1, 'has-level'), (2, 'not-automobile'), (3, 'even'), (4, 'all')) v(step, rule) GROUP BY ALL""",
    "repair_outcomes": """
WITH e AS (SELECT event_id AS k, CASE WHEN event_id % 13 <> 0 THEN value END AS lo, value + event_id % 3 - 1 AS hi FROM events)
SELECT CASE WHEN lo IS NULL OR hi IS NULL THEN 'incomplete' WHEN lo <= hi THEN 'in-order' WHEN k % 4 = 0 THEN 'swapped' WHEN k % 4 = 1 THEN 'set-to-null' WHEN k % 4 = 2 THEN 'repaired' ELSE 'still-inverted' END AS outcome, count(*) AS n FROM e GROUP BY 1""",
    "diurnal_profile": """
WITH h AS (SELECT event_type, hour(ts)::INTEGER AS hour, avg(value) AS m FROM events GROUP BY ALL)
SELECT event_type, hour, round(m, 6) AS mean, round(m - avg(m) OVER (PARTITION BY event_type), 6) AS departure FROM h""",
    "dose_response": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1",
    "year_spill": """
SELECT o_orderpriority, year(o_orderdate)::INTEGER AS file_year, count(*) AS n, count(*) FILTER (WHERE year(l_shipdate) = year(o_orderdate) - 1) AS n_before, count(*) FILTER (WHERE year(l_shipdate) = year(o_orderdate) + 1) AS n_after
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "station_classes": """
WITH s AS (SELECT CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey * 7 % 40) / 100.0::DOUBLE END AS a, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey * 7 % 40 + c_custkey % 6) / 100.0::DOUBLE END AS b FROM customer)
SELECT CASE WHEN b IS NULL THEN 'unknown' WHEN b < 0.02 THEN 'rural' WHEN b < 0.05 THEN 'sparse' WHEN b < 0.15 THEN 'mixed' WHEN b < 0.30 THEN 'dense' ELSE 'urban' END AS built,
       CASE WHEN b - a > 0.03 THEN 'strong' WHEN b - a > 0.01 THEN 'some' WHEN b - a IS NOT NULL THEN 'little' END AS growth, count(*) AS n FROM s GROUP BY ALL""",
    "station_headline": """
WITH s AS (SELECT c_custkey % 8 <> 0 AND c_custkey % 9 <> 0 AS b, (c_custkey * 7 % 40) / 100.0::DOUBLE AS v, 1960 + c_custkey % 50 - 1900 - c_custkey % 60 AS span FROM customer)
SELECT count(*) AS n_stations, count(*) FILTER (WHERE b) AS n_both, count(*) FILTER (WHERE b AND v < 0.02) AS n_rural, count(*) FILTER (WHERE span >= 50) AS n_long FROM s""",
    "filtered_blobs": f"""
WITH RECURSIVE k AS (SELECT DISTINCT floor(({SQL_LAT.format('c_custkey')} - 50) / 0.125)::BIGINT AS row, floor(({SQL_LON.format('c_custkey')} + 6) / 0.125)::BIGINT AS col FROM customer),
i AS (SELECT *, row * 2147483648 + col AS id FROM k),
e AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT node, min(reach) AS blob FROM r GROUP BY node),
b AS (SELECT blob, count(*) AS n, max(row) - min(row) + 1 AS h, max(col) - min(col) + 1 AS w FROM m JOIN i ON id = node GROUP BY blob)
SELECT blob, n FROM b WHERE n BETWEEN 2 AND 40 AND greatest(h, w) <= 3 * least(h, w) AND n / (h * w) >= 0.5""",
    "pair_tolerances": """
WITH w AS (SELECT max(abs((p_retailprice - 1000) / (p_size + 1))) AS worst FROM part GROUP BY p_brand), c AS (SELECT quantile_cont(worst, 0.99) AS critical FROM w)
SELECT p_brand, round(any_value(critical) * avg(p_size), 5) AS tolerance FROM part, c GROUP BY 1""",
    "bh_fdr_one_family": """
WITH t AS (SELECT o_orderkey, (o_orderkey * 7919 % 100003 / 100003.0::DOUBLE) * CASE WHEN o_orderkey % 10 = 0 THEN 0.0001::DOUBLE ELSE 1.0::DOUBLE END AS p FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY p, o_orderkey) AS rank, count(*) OVER () AS m FROM t),
k AS (SELECT *, max(CASE WHEN p <= rank * 0.05::DOUBLE / m THEN rank END) OVER () AS top FROM r)
SELECT o_orderkey, rank, coalesce(rank <= top, false) AS significant FROM k""",
    "ring_boxes": f"""
WITH s AS (SELECT s_suppkey, {SQL_LAT.format('s_suppkey')} AS lat, {SQL_LON.format('s_suppkey')} AS lon, degrees(10000 * 1.05::DOUBLE / 6371000) AS d FROM supplier)
SELECT s_suppkey, round(lat - d, 6) AS south, round(lon - d / cos(radians(lat)), 6) AS west, round(lat + d, 6) AS north, round(lon + d / cos(radians(lat)), 6) AS east FROM s""",
    "pilot_stations": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 5",
}
QUERIES = {name: globals()[name] for name in SQL}
