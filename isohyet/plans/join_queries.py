"""Queries on joins in time, set operations, grouping sets and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.functions.draws import sql_draw
from isohyet.operators import analysis, joins
from isohyet.plans.tables import table


def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """Every event with the last error of its user, itself included."""
    e = table(spark, d, "events")
    errors = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("last_event"), F.col("value").alias("last_value"))
    return joins.as_of(e.select("event_id", "user_id", "ts"), errors, "user_id", "ts", ["last_event", "last_value"]).select("event_id", "user_id", "last_event", "last_value")


def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Every event beside the errors of its user whose following one to three hours it falls in, to parts of a second; some events have no time."""
    at = F.when(F.col("event_id") % 37 != 0, F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", at.alias("at"))
    spans = e.where("event_type = 'error'").select(F.col("event_id").alias("span"), "user_id", F.col("at").alias("start"), (F.col("at") + 3_600 * (1 + F.col("event_id") % 3)).alias("end"))
    return joins.within_spans(e, spans, "user_id", "at", "start", "end", 7_200).select("event_id", "span")


def semi_join(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 200000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_nationkey")


def intersect_nations(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.select(F.col("c_nationkey").alias("nation")).intersect(s.select(F.col("s_nationkey").alias("nation")))


def segment_cube(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.grouping_id().cast("long").alias("level"))


def frame_functions(spark: SparkSession, d: str) -> DataFrame:
    """Range frames, relative ranks and the third value of a customer's orders."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1995-01-01")).cast("long").alias("day"), "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy("day")
    tied = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    return o.select(
        "o_orderkey", F.count(F.lit(1)).over(w.rangeBetween(-365, 0)).alias("n_year"), F.round(F.percent_rank().over(tied), 9).alias("place"),
        F.nth_value("o_orderkey", 3).over(tied.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("third"),
    )


def wild_cluster_slope(spark: SparkSession, d: str) -> DataFrame:
    return analysis.wild_cluster_bootstrap(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), "p_value")


SQL = {
    "as_of_join": """
WITH r AS (SELECT * FROM events WHERE event_type = 'error'),
j AS (SELECT l.event_id, l.user_id, r.event_id AS last_event, r.value AS last_value, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC, r.event_id DESC, r.value DESC) AS n FROM events l LEFT JOIN r ON r.user_id = l.user_id AND r.ts <= l.ts)
SELECT event_id, user_id, last_event, last_value FROM j WHERE n = 1""",
    "interval_join": """
WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 37 <> 0 THEN epoch_us(ts) / 1e6::DOUBLE END AS t FROM events)
SELECT p.event_id, s.event_id AS span FROM e p JOIN e s ON s.event_type = 'error' AND p.user_id = s.user_id AND p.t >= s.t AND p.t < s.t + 3600 * (1 + s.event_id % 3)""",
    "semi_join": "SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "intersect_nations": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "segment_cube": "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance, (grouping(c_mktsegment) * 2 + grouping(c_nationkey))::BIGINT AS level FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "frame_functions": """
WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS day FROM orders)
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 365 PRECEDING AND CURRENT ROW) AS n_year, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey), 9) AS place,
       nth_value(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM o""",
    "wild_cluster_slope": f"""
WITH d AS (SELECT l_suppkey AS c, l_quantity - avg(l_quantity) OVER () AS dx, l_extendedprice - avg(l_extendedprice) OVER () AS dy FROM lineitem),
s AS (SELECT c, sum(dx * dy) AS sxy, sum(dx * dx) AS sxx FROM d GROUP BY c),
t AS (SELECT b, sum(CASE WHEN {sql_draw('1', 'b', 'c')} % 2 = 0 THEN sxy ELSE -sxy END) AS t FROM s, range(199) t(b) GROUP BY b),
a AS (SELECT sum(sxy) AS sxy, sum(sxx) AS sxx FROM s)
SELECT round(any_value(sxy / sxx), 4) AS slope, (count(*) FILTER (WHERE abs(t) >= abs(sxy) * (1 - 1e-12)) + 1) / 200.0::DOUBLE AS p_value FROM t, a""",
}
QUERIES = {name: globals()[name] for name in SQL}
