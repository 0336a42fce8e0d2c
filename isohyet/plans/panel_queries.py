"""Queries on panels with effects of stations and periods, on exclusions, and on distinct counts that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.operators import neutrality, panel, sketches
from isohyet.plans.tables import table

YEARS = (1996, 2000)


def two_way_effect(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' mean quantities by year, three quarters of them treated from 1997, 1998 or 1999 on: a balanced panel, for which SQL has a closed form."""
    l = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate")).where(F.col("year").between(*YEARS))
    cells = l.groupBy("l_suppkey", "year").agg(F.avg("l_quantity").alias("value"))
    post = (F.col("l_suppkey") % 4 != 0) & (F.col("year") >= 1997 + F.col("l_suppkey") % 3)
    fit = panel.two_way_fit(cells.withColumn("post", post.cast("int")), "l_suppkey", "year", "value", ["post"])
    return fit.select("term", F.round("coefficient", 8).alias("coefficient"), F.round("stderr", 8).alias("stderr"), "n", "n_units")


def exclusion_neutrality(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines against the others, by line status; some prices are missing, and discounts have many ties."""
    l = table(spark, d, "lineitem").withColumn("out", F.when(F.col("l_orderkey") % 13 != 0, F.col("l_returnflag") == "A"))
    l = l.withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 17 == 0, float("nan")).when(F.col("l_orderkey") % 19 != 0, F.col("l_extendedprice")))
    gaps = neutrality.exclusion_gaps(l, ["l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"], "out")
    return gaps.select("l_linestatus", "covariate", "n_kept", "n_excluded", *[F.round(c, 9).alias(c) for c in ("gap", "gap_at", "mean_difference", "spread_ratio", "critical")], "neutral")


def merged_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Parts by return flag from sketches by flag and status: estimates lie within four standard errors of the count, and are those from sketches by flag and line."""
    l = table(spark, d, "lineitem")
    fine = sketches.sketched(l, ["l_returnflag", "l_linestatus"], F.col("l_partkey"))
    merged = sketches.estimated(sketches.united(fine, ["l_returnflag"]))
    other = sketches.sketched(l, ["l_returnflag", "l_linenumber"], F.col("l_partkey"))
    at_once = sketches.estimated(sketches.united(other, ["l_returnflag"]), "n_once")
    exact = l.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"))
    near = F.abs(F.col("n_distinct") - F.col("n")) <= 4 * sketches.standard_error() * F.col("n")
    return exact.join(merged, "l_returnflag").join(at_once, "l_returnflag").select("l_returnflag", "n", near.alias("near"), (F.col("n_distinct") == F.col("n_once")).alias("same"))


SQL = {
    "two_way_effect": f"""
WITH c AS (SELECT l_suppkey AS s, year(l_shipdate) AS y, avg(l_quantity) AS v, (l_suppkey % 4 <> 0 AND year(l_shipdate) >= 1997 + l_suppkey % 3)::INTEGER AS x FROM lineitem WHERE year(l_shipdate) BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY 1, 2),
m AS (SELECT s, v - avg(v) OVER s - avg(v) OVER y + avg(v) OVER () AS dv, x - avg(x) OVER s - avg(x) OVER y + avg(x) OVER () AS dx FROM c WINDOW s AS (PARTITION BY s), y AS (PARTITION BY y)),
b AS (SELECT sum(dx * dv) / sum(dx * dx) AS b, sum(dx * dx) AS sxx, count(*) AS n, count(DISTINCT s) AS g FROM m),
e AS (SELECT sum(q * q) AS q FROM (SELECT sum(dx * (dv - b * dx)) AS q FROM m, b GROUP BY s))
SELECT 'post' AS term, round(b, 8) AS coefficient, round(sqrt(q * g / (g - 1)) / sxx, 8) AS stderr, n, g AS n_units FROM b, e""",
    "exclusion_neutrality": f"""
WITH l AS (SELECT *, coalesce(l_orderkey % 13 <> 0 AND l_returnflag = 'A', false) AS o FROM lineitem),
u AS (
  SELECT l_linestatus, o, 'l_quantity' AS covariate, l_quantity AS v FROM l UNION ALL SELECT l_linestatus, o, 'l_discount', l_discount FROM l UNION ALL
  SELECT l_linestatus, o, 'l_extendedprice', l_extendedprice FROM l WHERE l_orderkey % 17 <> 0 AND l_orderkey % 19 <> 0),
m AS (
  SELECT l_linestatus, covariate, count(*) FILTER (WHERE NOT o) AS n, count(*) FILTER (WHERE o) AS k, avg(v) FILTER (WHERE NOT o) AS ma, avg(v) FILTER (WHERE o) AS mb, var_samp(v) FILTER (WHERE NOT o) AS va, var_samp(v) FILTER (WHERE o) AS vb
  FROM u GROUP BY ALL),
c AS (SELECT DISTINCT l_linestatus, covariate, v, count(*) FILTER (WHERE NOT o) OVER w AS a, count(*) FILTER (WHERE o) OVER w AS b FROM u WINDOW w AS (PARTITION BY l_linestatus, covariate ORDER BY v)),
g AS (SELECT c.*, round(abs(a / n - b / k), 12) AS g, m.* EXCLUDE (l_linestatus, covariate), {neutrality.CRITICAL}::DOUBLE * sqrt((n + k) / (n * k)::DOUBLE) AS crit FROM c JOIN m USING (l_linestatus, covariate)),
t AS (FROM g QUALIFY row_number() OVER (PARTITION BY l_linestatus, covariate ORDER BY g DESC, v) = 1)
SELECT l_linestatus, covariate, n AS n_kept, k AS n_excluded, CASE WHEN n * k > 0 THEN round(g, 9) END AS gap, CASE WHEN n * k > 0 THEN round(v, 9) END AS gap_at, round((mb - ma) / sqrt((va + vb) / 2), 9) AS mean_difference,
       round(sqrt(vb) / sqrt(va), 9) AS spread_ratio, CASE WHEN n * k > 0 THEN round(crit, 9) END AS critical, CASE WHEN n * k > 0 THEN g < crit END AS neutral FROM t""",
    "merged_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n, true AS near, true AS same FROM lineitem GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
