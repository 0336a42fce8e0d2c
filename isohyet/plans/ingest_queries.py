"""Queries on typing, schemas, keys, timelines and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions import coerce, geo
from isohyet.operators import audit, entity, timeline
from isohyet.plans.tables import SQL_KM, SQL_LAT, SQL_LON, cycled, lat, lon, sql_cycled, table
from isohyet.session import shared_dir
from isohyet.sources import inventory, selfdesc, sinks

INT_TOKENS = ["300", "300.0", "-5", "0", "9223372036854775807", "-9223372036854775808", "300.5", "/", "", "1e30", "inf", "9223372036854775808.0"]
FLOAT_TOKENS = ["1.5", "NA", "", "inf", "1e39", "abc", "-2"]
TIME_TOKENS = ["1995-01-01 00:00:00", "1995-01-01", "NA", "", "2020-13-01 00:00:00"]
NAMES = ["alton", "alton-park", "bray", "bray-no-2", "coll-hill", "coll-hill-3", "coll", "dunoon", "dunoon-5", "esk", "esk-upper-no-1"]

_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def _sql_int(t: str) -> str:
    d = f"try_cast({t} AS DOUBLE)"
    return (
        f"coalesce(CASE WHEN regexp_full_match({t}, '[+-]?[0-9]+') THEN try_cast({t} AS BIGINT) END, "
        f"CASE WHEN regexp_full_match({t}, '{_NUM}') AND {d} >= -9223372036854775808::DOUBLE AND {d} < 9223372036854775808::DOUBLE AND floor({d}) = {d} THEN try_cast({d} AS BIGINT) END)"
    )


def coerce_lenient_int(spark: SparkSession, d: str) -> DataFrame:
    t = cycled("o_orderkey", INT_TOKENS)
    return table(spark, d, "orders").select("o_orderkey", t.alias("token"), coerce.lenient_int(t).alias("value"))


def coerce_cause_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    cols = {"count": ("int", INT_TOKENS), "level": ("float", FLOAT_TOKENS), "at": ("time", TIME_TOKENS)}
    cells = o.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), coerce.cause(cycled("o_orderkey", v), kind).alias("cause")) for c, (kind, v) in cols.items()])).alias("x"))
    return cells.groupBy("x.col").agg(*[F.count_if(F.coalesce(F.col("x.cause") == c, F.lit(False))).alias(c) for c in ("na", "empty", "coerced")])


def schema_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    strip = lambda t, p: t.select([F.col(c).alias(c.removeprefix(p)) for c in t.columns])
    a, b = strip(table(spark, d, "customer").drop("c_custkey"), "c_"), strip(table(spark, d, "supplier").drop("s_suppkey"), "s_")
    return a.withColumn("side", F.lit("customer")).unionByName(b.withColumn("side", F.lit("supplier")), allowMissingColumns=True)


def schema_conflict_widening(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.format_string("f%03d", "n_nationkey").alias("path"), F.col("n_name").alias("station"), F.col("n_nationkey").alias("k"))
    kinds = {"depth": F.when(F.col("k") % 3 == 0, "float").otherwise("int"), "name": F.lit("char"), "mixed": F.when(F.col("k") == 7, "char").otherwise("int")}
    rows = n.select("path", "station", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), t.alias("type")) for c, t in kinds.items()])).alias("x"))
    types = rows.select("path", "station", "x.col", "x.type", F.lit("m").alias("unit"))
    return selfdesc.union_types(types).select("col", F.array_join("types", ",").alias("types"), "type", F.array_join("stations", ",").alias("stations"))


def attribution_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return selfdesc.src_id_mismatches(_parsed(spark, d))


def report_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("hour", F.hour("ts")).withColumn("day", F.to_date("ts"))
    return audit.one_per_key(e, ["user_id", "day", "hour", "event_type"], [F.col("event_id")]).select("event_id", "user_id", "event_type", F.col("hour").cast("long").alias("hour"))


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_check(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "day", "event_type"])


def reconcile_tables(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    changed = o.withColumn("o_totalprice", F.when((F.col("o_orderkey") % 1000 == 1) & (F.col("o_orderstatus") == "F"), F.col("o_totalprice") + 1000).otherwise(F.col("o_totalprice")))
    return audit.reconcile(o, changed.where("not (o_orderstatus = 'P' and o_orderkey % 10 = 3)"), "o_orderstatus", ["o_totalprice", "o_custkey"], 2)


def data_years_islands(spark: SparkSession, d: str) -> DataFrame:
    """Some orders have no year."""
    year = F.when(F.col("o_orderkey") % 31 != 0, F.year("o_orderdate"))
    return timeline.segments(table(spark, d, "orders").select("o_custkey", year.alias("year")), "o_custkey")


def era_break_segments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.dayofmonth("ts").alias("day"), (F.col("user_id") % 30).alias("aws"))
    return timeline.segments(e, "user_id", "day", "aws")


def survivorship_decade(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("first"), F.max(F.year("o_orderdate")).alias("last"))
    return timeline.survivorship(spans, "first", "last", 2001, 2)


def coordinate_precision(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("text", cycled("s_suppkey", ["56.5", "51.807", "52", "-3.72", "50.25"]))
    places = coerce.decimal_places(F.col("text"))
    m = geo.coordinate_precision_m(F.col("text").cast("double"), places, places)
    return s.select("s_suppkey", places.alias("places"), F.round(m, 1).alias("precision_m"), (m > 100).alias("coarse"))


def name_stem_prefix_pairs(spark: SparkSession, d: str) -> DataFrame:
    return entity.related_names(table(spark, d, "supplier").withColumn("name", cycled("s_suppkey", NAMES)), "s_suppkey", "name")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", lat("s_suppkey").alias("lat"), lon("s_suppkey").alias("lon"), "s_name")


def haversine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return entity.neighbours(_points(spark, d), "s_suppkey", "lat", "lon", 60.0).select("a", "b", F.round("km", 3).alias("km"))


def relocation_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return entity.near_clusters(p, 58.0, "s_suppkey", "lat", "lon", "s_name")


def code_translate_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Codes translated by a lookup with gaps, identity where it has none; customers counted, unmatched codes too."""
    codes = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("to"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    code = F.coalesce("to", F.concat(F.lit("N"), F.col("nation")))
    return c.join(codes, F.col("nation") == F.col("k"), "left").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("to").isNull()).alias("n_unmatched"))


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Events as listed files: two of the kinds, one version and what has none, without those that are there in their size."""
    k = F.col("event_id")
    path = F.concat(F.lit("f"), k)
    e = table(spark, d, "events")
    listing = e.select(path.alias("path"), F.col("user_id").alias("size"), F.col("event_type").alias("county"), F.when(k % 4 != 0, k % 4).alias("qc"))
    local = e.where(k % 3 != 0).select(path.alias("path"), F.when(k % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("size"))
    return inventory.to_fetch(listing, local, ["error", "signup"], 1)


def manifest_sha256(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the files of a release, against a manifest that has lost some, lists others that aren't there and holds old digests."""
    k = F.col("doc_id")
    files = table(spark, d, "documents").select(F.concat(F.lit("release/"), k).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), "doc_id")
    kept = sinks.manifest(files.where(k % 7 != 0))
    old = F.col("name").cast("long") % 5 == 0
    expected = kept.withColumn("digest", F.when(old, F.lit("old")).otherwise(F.col("digest")))
    return sinks.verify(files.where(k % 11 != 0), expected)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """Files of one order each, some with a bad header or without an end; every eleventh names another station."""
    o = table(spark, d, "orders")
    text = F.concat(
        F.lit("Conventions,G,BADC-CSV\ncollection_version_number,G,202507\n"), F.when(F.col("o_orderkey") % 50 == 0, "broken\n").otherwise(""),
        F.lit("type,src_id,int\ntype,total,float\nlong_name,total,order total,euros\ntype,at,char\ncoordinate_variable,at,t\ndata\nsrc_id,total,at,mystery\n"),
        F.col("o_custkey") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0), F.lit(","), cycled("o_orderkey", FLOAT_TOKENS), F.lit(","), cycled("o_orderkey", TIME_TOKENS), F.lit(",NA\n"), F.when(F.col("o_orderkey") % 77 == 0, "").otherwise("end data\n"),
    )
    files = o.select(F.concat(F.lit("f"), F.col("o_orderkey")).alias("path"), F.col("o_orderpriority").alias("county"), F.concat_ws("_", F.lpad(F.col("o_custkey").cast("string"), 5, "0"), F.lit("s")).alias("station"), F.lit("1995").alias("year"), text.alias("text"), F.col("o_custkey").cast("bigint").alias("src_id"))
    shared_dir(spark)
    return selfdesc.split_files(files).checkpoint()  # every tally reads it


def run_record_json(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed(spark, d)
    schema = selfdesc.dataset_schema(parsed)
    return selfdesc.run_record(parsed, selfdesc.run_details(parsed, schema), schema, "hourly", 1, "raw")


def run_record_details(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed(spark, d)
    return selfdesc.run_details(parsed, selfdesc.dataset_schema(parsed))


def run_typed_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows themselves under the dataset schema, with the folder's attribution in place of the file's."""
    parsed = _parsed(spark, d)
    return selfdesc.typed_rows(parsed, selfdesc.dataset_schema(parsed))


_POINTS = f"SELECT s_suppkey, {SQL_LAT.format('s_suppkey')} AS lat, {SQL_LON.format('s_suppkey')} AS lon FROM supplier"
_NEAR = f"SELECT a.s_suppkey AS a, b.s_suppkey AS b, {SQL_KM.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM p a JOIN p b ON a.s_suppkey < b.s_suppkey"
_CAUSE = "CASE WHEN {t} = '' THEN 'empty' WHEN {t} = 'NA' THEN 'na' WHEN ({v}) IS NULL THEN 'coerced' END"


def _sql_segments(rows: str) -> str:
    return f"""
WITH r AS (SELECT DISTINCT station, year, aws FROM ({rows})),
g AS (SELECT *, lag(year) OVER (PARTITION BY station ORDER BY year) AS before FROM r),
m AS (SELECT *, CASE WHEN before IS NULL THEN 'open' WHEN year <> before + 1 THEN 'resumed-after-gap' WHEN year = aws THEN 'aws-transition' END AS reason FROM g),
s AS (SELECT *, (sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY year) - 1)::INTEGER AS segment FROM m),
a AS (SELECT station, segment, min(year) AS start_year, max(year) AS end_year, max(reason) AS break_reason, max(aws) AS aws FROM s GROUP BY ALL)
SELECT station, segment, start_year, end_year, break_reason,
       CASE WHEN aws IS NULL THEN 'unknown' WHEN start_year >= aws THEN 'aws' ELSE 'manual' END AS era,
       count(*) OVER (PARTITION BY station) AS n_segments, min(start_year) OVER (PARTITION BY station) AS first_year, max(end_year) OVER (PARTITION BY station) AS last_year
FROM a"""


def _stem(x: str) -> str:
    return f"string_split(regexp_replace(lower({x}), '(?:-no)?-[0-9]+$', ''), '-')"


_T, _A = sql_cycled("o_orderkey", FLOAT_TOKENS), sql_cycled("o_orderkey", TIME_TOKENS)
_FILES = f"""f AS (
  SELECT o_orderkey, o_custkey, 'f' || o_orderkey AS file, o_orderpriority AS county, {_T} AS total_token, {_A} AS at_token,
         CASE WHEN o_orderkey % 50 = 0 THEN 'header line of fewer than three parts' WHEN o_orderkey % 77 = 0 THEN 'no ''end data'' line' END AS error FROM orders),
good AS (
  SELECT *, CASE total_token WHEN '' THEN 'empty' WHEN 'NA' THEN 'na' WHEN 'inf' THEN 'coerced' WHEN '1e39' THEN 'coerced' WHEN 'abc' THEN 'coerced' END AS total_cause,
         CASE WHEN at_token = '' THEN 'empty' WHEN at_token = 'NA' THEN 'na' WHEN at_token NOT SIMILAR TO '[0-9-]+ [0-9:]+' OR try_cast(at_token AS TIMESTAMP) IS NULL THEN 'coerced' END AS at_cause FROM f WHERE error IS NULL)"""

SQL = {
    "coerce_lenient_int": f"SELECT o_orderkey, token, {_sql_int('token')} AS value FROM (SELECT o_orderkey, {sql_cycled('o_orderkey', INT_TOKENS)} AS token FROM orders)",
    "coerce_cause_counts": f"""
WITH t AS (SELECT {sql_cycled('o_orderkey', INT_TOKENS)} AS a, {sql_cycled('o_orderkey', FLOAT_TOKENS)} AS b, {sql_cycled('o_orderkey', TIME_TOKENS)} AS c FROM orders),
x AS (
  SELECT 'count' AS col, {_CAUSE.format(t='a', v=_sql_int('a'))} AS cause FROM t UNION ALL
  SELECT 'level', {_CAUSE.format(t='b', v=f"CASE WHEN regexp_full_match(b, '{_NUM}') AND abs(try_cast(b AS DOUBLE)) < 3.4028235e38 THEN 1 END")} FROM t UNION ALL
  SELECT 'at', {_CAUSE.format(t='c', v="try_strptime(c, '%Y-%m-%d %H:%M:%S')")} FROM t)
SELECT col, count(*) FILTER (WHERE cause = 'na') AS na, count(*) FILTER (WHERE cause = 'empty') AS empty, count(*) FILTER (WHERE cause = 'coerced') AS coerced FROM x GROUP BY col""",
    "schema_union_by_name": """
SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment, 'customer' AS side FROM customer
UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier""",
    "schema_conflict_widening": """
WITH n AS (SELECT printf('f%03d', n_nationkey) AS path, n_name AS station, n_nationkey AS k FROM nation),
t AS (SELECT path, station, 'depth' AS col, CASE WHEN k % 3 = 0 THEN 'float' ELSE 'int' END AS type FROM n UNION ALL
      SELECT path, station, 'name', 'char' FROM n UNION ALL SELECT path, station, 'mixed', CASE WHEN k = 7 THEN 'char' ELSE 'int' END FROM n),
g AS (SELECT col, string_agg(DISTINCT type, ',' ORDER BY type) AS types, list_sort([arg_min(station, type || path), arg_max(station, type || path)]) AS s FROM t GROUP BY col)
SELECT col, types, CASE WHEN types NOT LIKE '%,%' THEN types WHEN types = 'float,int' THEN 'float' END AS type, array_to_string(s, ',') AS stations FROM g""",
    "attribution_mismatch": f"WITH {_FILES} SELECT file AS path, count(*) AS n FROM good WHERE o_orderkey % 11 = 0 GROUP BY file",
    "report_dedupe": """
SELECT event_id, user_id, event_type, hour(ts) AS hour FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE, hour(ts), event_type ORDER BY event_id) = 1""",
    "duplicate_keys": """
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, (sum(n) - count(*))::BIGINT AS n_surplus
FROM (SELECT count(*) AS n FROM events GROUP BY user_id, ts::DATE, event_type)""",
    "reconcile_tables": """
WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_totalprice AS p, o_custkey::DOUBLE AS c FROM orders),
n AS (SELECT o_orderkey, s, CASE WHEN o_orderkey % 1000 = 1 AND s = 'F' THEN p + 1000 ELSE p END AS p, c FROM o WHERE NOT (s = 'P' AND o_orderkey % 10 = 3)),
f AS (SELECT 'old' AS side, s, 'o_totalprice' AS col, count(*) AS n, count(p) AS v, round(min(p), 2) AS lo, round(max(p), 2) AS hi, round(sum(p), 2) AS t FROM o GROUP BY s UNION ALL
      SELECT 'old', s, 'o_custkey', count(*), count(c), min(c), max(c), sum(c) FROM o GROUP BY s UNION ALL
      SELECT 'new', s, 'o_totalprice', count(*), count(p), round(min(p), 2), round(max(p), 2), round(sum(p), 2) FROM n GROUP BY s UNION ALL
      SELECT 'new', s, 'o_custkey', count(*), count(c), min(c), max(c), sum(c) FROM n GROUP BY s)
SELECT coalesce(a.s, b.s) AS o_orderstatus, coalesce(a.col, b.col) AS column,
       CASE WHEN a.s IS NULL THEN 'only-new' WHEN b.s IS NULL THEN 'only-old' WHEN (a.n, a.v, a.lo, a.hi) = (b.n, b.v, b.lo, b.hi) AND abs(a.t - b.t) < 0.02 THEN 'same' ELSE 'differs' END AS status
FROM (FROM f WHERE side = 'old') a FULL JOIN (FROM f WHERE side = 'new') b ON a.s = b.s AND a.col = b.col""",
    "data_years_islands": _sql_segments("SELECT o_custkey AS station, year(o_orderdate)::INTEGER AS year, NULL::BIGINT AS aws FROM orders WHERE o_orderkey % 31 <> 0"),
    "era_break_segments": _sql_segments("SELECT user_id AS station, day(ts)::INTEGER AS year, (user_id % 30)::BIGINT AS aws FROM events"),
    "survivorship_decade": """
WITH s AS (SELECT min(year(o_orderdate)) AS f, max(year(o_orderdate)) AS l FROM orders GROUP BY o_custkey)
SELECT (f // 2 * 2)::INTEGER AS opened_in, count(*) AS opened, count(*) FILTER (WHERE l >= 2001) AS still_open, count(*) FILTER (WHERE l < 2001) AS closed FROM s GROUP BY 1""",
    "coordinate_precision": f"""
WITH t AS (SELECT s_suppkey, {sql_cycled('s_suppkey', ['56.5', '51.807', '52', '-3.72', '50.25'])} AS x FROM supplier),
p AS (SELECT s_suppkey, x::DOUBLE AS lat, length(coalesce(string_split(x, '.')[2], ''))::INTEGER AS places FROM t),
m AS (SELECT *, greatest(111320.0 * pow(10, -places) / 2, 111320.0 * cos(radians(lat)) * pow(10, -places) / 2) AS m FROM p)
SELECT s_suppkey, places, round(m, 1) AS precision_m, m > 100 AS coarse FROM m""",
    "name_stem_prefix_pairs": f"""
WITH s AS (SELECT s_suppkey AS id, {_stem(sql_cycled('s_suppkey', NAMES))} AS stem FROM supplier)
SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND a.stem[1] = b.stem[1]
WHERE a.stem[1:least(len(a.stem), len(b.stem))] = b.stem[1:least(len(a.stem), len(b.stem))]""",
    "haversine_neighbours": f"WITH p AS ({_POINTS}), n AS ({_NEAR}) SELECT a, b, round(km, 3) AS km FROM n WHERE km <= 60",
    "relocation_clusters": f"""
WITH RECURSIVE p AS ({_POINTS}), n AS ({_NEAR}), e AS (SELECT a, b FROM n WHERE km <= 58 UNION SELECT b, a FROM n WHERE km <= 58),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY node),
w AS (SELECT x.component, round(max({SQL_KM.format('p1.lat', 'p1.lon', 'p2.lat', 'p2.lon')}), 2) AS max_km
      FROM c x JOIN c y ON x.component = y.component AND x.node < y.node JOIN p p1 ON p1.s_suppkey = x.node JOIN p p2 ON p2.s_suppkey = y.node GROUP BY 1)
SELECT 'cluster-' || c.component AS cluster_id, count(*) AS n, string_agg(node, ';' ORDER BY node) AS members, count(DISTINCT s_name) AS names, max(max_km) AS max_km
FROM c JOIN supplier ON s_suppkey = node JOIN w USING (component) GROUP BY c.component""",
    "code_translate_lookup": """
SELECT coalesce('R' || n_regionkey, 'N' || c_nationkey) AS code, count(*) AS n, count(*) FILTER (WHERE n_regionkey IS NULL) AS n_unmatched
FROM customer LEFT JOIN (FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey GROUP BY 1""",
    "resume_anti_join": """
SELECT 'f' || event_id AS path, user_id AS size, event_type AS county, nullif(event_id % 4, 0) AS qc FROM events
WHERE event_type IN ('error', 'signup') AND event_id % 4 IN (0, 1) AND (event_id % 3 = 0 OR event_id % 5 = 0)""",
    "run_record_details": f"""
WITH {_FILES}
SELECT county, 'coercion' AS kind, file, x.c AS column, 1::BIGINT AS count, NULL::VARCHAR AS error FROM good, (VALUES ('total'), ('at')) x(c) WHERE CASE x.c WHEN 'total' THEN total_cause ELSE at_cause END = 'coerced'
UNION ALL SELECT county, 'empty_field', file, x.c, 1, NULL FROM good, (VALUES ('total'), ('at')) x(c) WHERE CASE x.c WHEN 'total' THEN total_cause ELSE at_cause END = 'empty'
UNION ALL SELECT county, 'src_id_mismatch', file, NULL, 1, NULL FROM good WHERE o_orderkey % 11 = 0
UNION ALL SELECT county, 'undeclared_fallback', file, 'mystery', NULL, NULL FROM good
UNION ALL SELECT county, 'failure', file, NULL, NULL, error FROM f WHERE error IS NOT NULL""",
    "run_record_json": f"""
WITH {_FILES},
c AS (SELECT county, count(*) FILTER (WHERE error IS NULL) AS ok FROM f GROUP BY 1),
k AS (SELECT count(*) FILTER (WHERE total_cause = 'coerced') + count(*) FILTER (WHERE at_cause = 'coerced') AS co, count(*) FILTER (WHERE total_cause = 'empty') + count(*) FILTER (WHERE at_cause = 'empty') AS em, count(*) AS un, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS mi FROM good)
SELECT '{{"dataset":"hourly","qc_version":1,"raw_dir":"raw","releases":["202507"],"schema_columns":4,"schema_widenings":[],"files_parsed":' || sum(ok) || ',"total_rows":' || sum(ok) || ',"counties_written":' || count(*) FILTER (WHERE ok > 0)
  || ',"counties_skipped_all_failed":[' || coalesce(string_agg('"' || county || '"', ',' ORDER BY county) FILTER (WHERE ok = 0), '') || '],"rows_per_county":{{' || coalesce(string_agg('"' || county || '":' || ok, ',' ORDER BY county) FILTER (WHERE ok > 0), '')
  || '}},"findings":{{' || (SELECT '"coercion":{{"entries":' || co || ',"values":' || co || '}},"empty_field":{{"entries":' || em || ',"values":' || em || '}},"undeclared_fallback":{{"entries":' || un || ',"values":' || un || '}},"src_id_mismatch":{{"entries":' || mi || ',"values":' || mi || '}}' FROM k)
  || ',"failure":{{"entries":' || (SELECT count(*) FROM f WHERE error IS NOT NULL) || ',"values":' || (SELECT count(*) FROM f WHERE error IS NOT NULL) || '}}}}}}' AS record FROM c""",
    "run_typed_rows": f"""
WITH {_FILES}
SELECT o_custkey AS src_id, county, lpad(o_custkey::VARCHAR, 5, '0') || '_s' AS station_file_name, CASE WHEN at_cause IS NULL THEN try_cast(at_token AS TIMESTAMP) END AS at, 'NA' AS mystery, CASE WHEN total_cause IS NULL THEN try_cast(total_token AS FLOAT) END AS total FROM good""".replace("'NA' AS mystery", "NULL::VARCHAR AS mystery"),
    "manifest_sha256": """
SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'unlisted' ELSE 'changed' END AS status
FROM documents WHERE (doc_id % 7 <> 0 AND (doc_id % 11 = 0 OR doc_id % 5 = 0)) OR (doc_id % 7 = 0 AND doc_id % 11 <> 0)""",
}
QUERIES = {name: globals()[name] for name in SQL}
