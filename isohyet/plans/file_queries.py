"""Queries on whole station files, typed in one vectorised pass with the causes of nulls, and on pages that follow each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.plans.ingest_queries import FLOAT_TOKENS, INT_TOKENS, TIME_TOKENS, _sql_int
from isohyet.plans.tables import cycled, sql_cycled, table
from isohyet.session import scratch_dir
from isohyet.sources import pages, selfdesc, vectorised

HEADER = "Conventions,G,BADC-CSV\ncollection_version_number,G,202507\ntype,src_id,int\ntype,key,int\ntype,amount,{kind}\ntype,total,float\ntype,at,char\ncoordinate_variable,at,t\ntype,total_q,int\n"


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A file for every customer with a row for each order; every seventh customer's has no end mark, every fifth order names another station.

    Every other customer's file declares the amounts as integers, which the dataset widens.
    """
    other = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("string")
    row = F.concat_ws(",", other, F.col("o_orderkey").cast("string"), *[cycled("o_orderkey", v) for v in (INT_TOKENS, FLOAT_TOKENS, TIME_TOKENS)], F.concat(F.lit(" 0"), F.col("o_orderkey") % 10))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("line")))).alias("r"))
    header = F.when(F.col("o_custkey") % 2 == 0, HEADER.format(kind="float")).otherwise(HEADER.format(kind="int"))
    text = F.concat(header, F.lit("data\nsrc_id,key,amount,total,at,total_q\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.when(F.col("o_custkey") % 7 == 0, "\n").otherwise("\nend data\n"))
    county = F.concat(F.lit("county-"), F.col("o_custkey") % 5)
    return rows.select(F.concat(F.lit("f"), F.col("o_custkey")).alias("path"), county.alias("county"), F.concat(F.col("o_custkey"), F.lit("_s")).alias("station"), F.col("o_custkey").cast("bigint").alias("src_id"), text.alias("text"))


def _schema(files: DataFrame) -> selfdesc.DatasetSchema:
    return selfdesc.dataset_schema(selfdesc.split_files(files))


def station_file_rows(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return vectorised.rows(files, _schema(files))


def station_file_tallies(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    t = vectorised.tallies(files, _schema(files))
    return t.groupBy("county", "col", "error").agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("rows", "na", "empty", "coerced", "mismatched")])


PAGE_ROWS = 2_000


def paged_events(spark: SparkSession, d: str) -> DataFrame:
    """Events cut into pages by their number, fetched by a stream in two runs: the second finds nothing new."""
    root = scratch_dir(spark, "pages")
    nth = F.expr(f"event_id div {PAGE_ROWS}") + 1
    e = table(spark, d, "events").select(nth.alias("page"), F.to_json(F.struct("event_id", "event_type")).alias("value"))
    last = e.agg(F.max("page")).first()[0] or 0
    following = spark.range(1, max(last, 1)).select(F.col("id").alias("page"), F.to_json(F.struct((F.col("id") + 1).alias("next"))).alias("value"))
    e.unionByName(following).repartition("page").write.partitionBy("page").text(f"{root}/in")
    for _ in range(2):
        pages.fetch_new(spark, f"{root}/in", f"{root}/out", f"{root}/mark")
    got = pages.fetched(spark, f"{root}/out").withColumn("e", F.from_json("value", "event_id long, event_type string"))
    return got.select("page", "e.event_id", "e.event_type")


_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_T = f"""t AS (
  SELECT o_orderkey AS k, o_custkey AS c, 'county-' || o_custkey % 5 AS county, o_custkey % 7 <> 0 AS good, {sql_cycled('o_orderkey', INT_TOKENS)} AS i, {sql_cycled('o_orderkey', FLOAT_TOKENS)} AS f, {sql_cycled('o_orderkey', TIME_TOKENS)} AS a FROM orders),
v AS (
  SELECT *, CASE WHEN i IN ('', 'NA') THEN NULL WHEN c % 2 = 1 THEN {_sql_int('i')}::FLOAT WHEN regexp_full_match(i, '{_NUM}') AND abs(try_cast(i AS DOUBLE)) < 3.4028235e38 THEN try_cast(i AS FLOAT) END AS amount, CASE WHEN regexp_full_match(f, '{_NUM}') AND abs(try_cast(f AS DOUBLE)) < 3.4028235e38 THEN try_cast(f AS FLOAT) END AS total,
         CASE WHEN a SIMILAR TO '[0-9-]+ [0-9:]+' THEN try_cast(a AS TIMESTAMP) END AS stamp FROM t WHERE good)"""

SQL = {
    "paged_events": f"SELECT event_id // {PAGE_ROWS} + 1 AS page, event_id, event_type FROM events",
    "station_file_rows": f"WITH {_T} SELECT c AS src_id, county, c || '_s' AS station_file_name, amount, stamp AS at, k AS key, total, '0' || k % 10 AS total_q FROM v",
    "station_file_tallies": f"""
WITH {_T},
x AS (
  SELECT county, c, 'amount' AS col, i AS token, amount IS NULL AS none, 0 AS other FROM v UNION ALL SELECT county, c, 'total', f, total IS NULL, 0 FROM v UNION ALL SELECT county, c, 'at', a, stamp IS NULL, 0 FROM v UNION ALL
  SELECT county, c, col, '1', false, (col = 'src_id' AND k % 5 = 0)::INTEGER FROM v, (VALUES ('src_id'), ('key'), ('total_q')) n(col))
SELECT county, col, NULL::VARCHAR AS error, count(DISTINCT c) AS files, rows, na, empty, coerced, mismatched FROM x JOIN (
  SELECT county, col, sum(n)::BIGINT AS rows, sum(na)::BIGINT AS na, sum(empty)::BIGINT AS empty, sum(coerced)::BIGINT AS coerced, sum(other)::BIGINT AS mismatched FROM (
    SELECT county, col, c, count(*) AS n, count(*) FILTER (WHERE token = 'NA') AS na, count(*) FILTER (WHERE token = '') AS empty, count(*) FILTER (WHERE none AND token NOT IN ('', 'NA')) AS coerced, sum(other) AS other FROM x GROUP BY ALL) GROUP BY ALL) USING (county, col)
GROUP BY ALL
UNION ALL SELECT county, NULL, 'no ''end data'' line', count(DISTINCT c), NULL, NULL, NULL, NULL, NULL FROM t WHERE NOT good GROUP BY county""",
}
QUERIES = {name: globals()[name] for name in SQL}
