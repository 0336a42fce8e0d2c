"""Queries on rings, layers, scenes and citation texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions import bands, textrules
from isohyet.operators import composite, rings
from isohyet.plans.tables import SQL_KM, SQL_LAT, SQL_LON, cycled, lat, lon, rounded, sql_cycled, table

LEGEND = ["STANDARD", "SMALL", "PROMO", "MEDIUM", "LARGE"]
RADII = [50.0, 200.0, 1000.0]
#: Headers of citations; the whole text of a document follows each.
TEXTS = [
    "COUNTY: X\nSITE NAME: ASH WOOD\nDate Notified (Under 1949 Act): 1965\nDate of Last Revision: 1971\nArea: 2 ha",
    "SITE NAME: BERE HEATH\nFirst  Notified: 1984\nSee boundary map overleaf",
    "SITE NAME: CARR FEN\nDate Notified (Under 1949 Act): -\nDate of Renotification: 1986",
    "no fields here",
    "",
    "SITE NAME: OTHER MOSS\nDate Notified (Under 1949 Act):\nDate Notified (Under 1981 Act):\n1983\nArea: 2 ha",
    "DORSET: ASH WOOD\nDate  Notified ( Under 1949 Act ):\n1955\nDate Notified (Under 1981 Act): 1986",
    "SITE NAME: BERE HEATH\nFirst Notified: 1958\nFormerly part of B",
    "SITE NAME: Carr Fen Extension\nDate Notified (Under 1981 Act): 1985",
    "SITE NAME: DUN MOSS\nDate Notified (Under 1949 Act): 1960\nDate of Revision: 1950",
    "SITE NAME: Esk Marsh (part)\nDate Notified (Under 1949 Act):\n\nseen\nin 1961 by hand\nand 1962",
    "SITE\u00a0NAME:\u2003ASH WOOD\u00a0\nDate\u00a0Notified (Under\u20091949 Act):\u00a01960\u3000\nDate of\u00a0Revision: 1950",
]
SITES = ["Ash Wood SSSI", "Bere Heath (North)", "Carr Fen NNR", "Dun Moss", "Esk Marsh", "Dun Moss S.S.S.I.", "Ash Wood", "Bere Heath", "Carr Fen", "Dun Moss", "Esk Marsh", ""]


def epoch_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Years from long before the first observation to long after the last."""
    epochs = table(spark, d, "orders").select((F.lit(1960) + F.col("o_orderkey") % 75).cast("int").alias("epoch")).distinct()
    return epochs.select("epoch", *[c.alias(n) for n, c in rings.epoch_provenance(F.col("epoch")).items()])


def grid_completion(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    facts = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    axes = [c.select(F.col("c_mktsegment").alias("segment")).distinct(), o.select(F.year("o_orderdate").alias("year")), o.select(F.col("o_orderpriority").alias("priority"))]
    return rings.complete_grid(axes, facts, ["segment", "year", "priority"]).select("segment", "year", "priority", F.coalesce("n", F.lit(0)).alias("n"))


def point_in_cell(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(lat("c_custkey").alias("lat"), lon("c_custkey").alias("lon"))
    cells = c.groupBy(F.floor((59 - F.col("lat")) / 0.5).cast("int").alias("row"), F.floor((F.col("lon") + 6) / 0.5).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("value"))
    p = table(spark, d, "supplier").select("s_suppkey", lat("s_suppkey").alias("lat"), lon("s_suppkey").alias("lon"))
    return rings.point_in_cell(p, cells, "lon", "lat", -6.0, 59.0, 0.5, 1).select("s_suppkey", "row", "col", "value")


def ring_cell_weights(spark: SparkSession, d: str) -> DataFrame:
    """Sums of weights of every row and of every column of cells, beside the circle's area in that band, and the number of whole cells."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src_id"), (F.col("s_suppkey") * 37 % 900 + 0.5).alias("x"), (F.col("s_suppkey") * 53 % 800 + 0.25).alias("y"))
    w = rings.cell_weights(s, [500.0, 1500.0], 100.0)
    bands_ = w.select("src_id", "ring_m", F.explode(F.array(F.struct(F.lit("row").alias("axis"), F.col("row").alias("nth")), F.struct(F.lit("col").alias("axis"), F.col("col").alias("nth")))).alias("b"), "w")
    return bands_.groupBy("src_id", "ring_m", "b.axis", "b.nth").agg(F.round(F.sum("w"), 6).alias("cells"), F.count_if(F.col("w") == 1).alias("whole")).where("cells > 0.00001")


#: Where a row stands in the table's files: cells are added up in that order, as by one thread of SQL.
PLACE = ["file", "nth"]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"), "l_orderkey", F.col("l_discount").alias("w"), F.col("l_quantity").alias("v"), (F.col("l_quantity") + F.col("l_linenumber")).alias("land"), (F.col("l_returnflag") != "A").alias("ok"))


def ring_weighted_fraction(spark: SparkSession, d: str) -> DataFrame:
    out = rings.ring_fraction(_cells(spark, d), ["l_orderkey"], "v", "land", "ok", order=PLACE)
    return out.select("l_orderkey", *[rounded(F.col(c), 6).alias(c) for c in ("built_sum", "land_sum", "fraction")], "reason")


def ring_weighted_mean_gate(spark: SparkSession, d: str) -> DataFrame:
    out = rings.gated_mean(_cells(spark, d).withColumn("w", F.col("w") + 1), ["l_orderkey"], "v", "w", "ok", 0.6, PLACE)
    return out.select("l_orderkey", rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("valid_fraction"), 6).alias("valid_fraction"), "reason")


def dominant_class_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = rings.dominant_class(table(spark, d, "part"), ["p_brand"], "p_type", "p_size", F.lit(2500.0), LEGEND)
    return out.select("p_brand", "dominant", F.round("coverage", 6).alias("coverage"), *[F.round(f"frac_{i}", 6).alias(f"frac_{i}") for i in range(1, len(LEGEND) + 1)])


def radius_hits_list(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("centre"), lat("n_nationkey").alias("lat"), lon("n_nationkey").alias("lon"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("feature"), (lat("s_suppkey") + 0.01).alias("lat"), lon("s_suppkey").alias("lon"))
    return rings.any_ring(rings.radius_hits(n, s, RADII))


def apportion_density_delta(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    u = o.join(c, o["o_custkey"] == c["c_custkey"]).select("c_nationkey", F.year("o_orderdate").alias("year"), "o_totalprice", (F.col("o_orderkey") % 4 + 1).cast("double").alias("inter"), F.lit(8.0).alias("area"), F.lit(200.0).alias("land"))
    out = rings.apportion_density(u, "c_nationkey", "year", "o_totalprice", "inter", "area", "land")
    return out.select("c_nationkey", "year", F.round("population", 1).alias("population"), F.round("density", 3).alias("density"), F.round("delta", 3).alias("delta"), "reason")


def _bands(spark: SparkSession, d: str) -> DataFrame:
    dn = lambda i: F.floor(F.abs(F.element_at("embedding", i).cast("double")) * 100000).alias(f"b{i}")
    return table(spark, d, "embeddings").select("vec_id", "label", dn(1), dn(2), dn(3), (F.col("vec_id") % 64).cast("int").alias("qa"))


def band_indices(spark: SparkSession, d: str) -> DataFrame:
    r = [bands.reflectance(F.col(f"b{i}")) for i in (1, 2, 3)]
    nd = lambda a, b: F.round(bands.normalised_difference(a, b), 5)
    return _bands(spark, d).select("vec_id", nd(r[1], r[0]).alias("ndvi"), nd(r[2], r[1]).alias("ndbi"), bands.is_clear(F.col("qa")).alias("clear"))


def median_composite_top8(spark: SparkSession, d: str) -> DataFrame:
    top = composite.first_scenes(_bands(spark, d), "label", [F.col("vec_id")])
    return composite.median_composite(top.withColumn("clear", F.col("qa") < 60), ["label"], ["b1", "b2"], "clear")


def season_decade_filter(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").where(bands.in_season(F.col("l_shipdate")))
    platform = F.when(F.year("l_shipdate") < 2000, "landsat-5").otherwise("landsat-7")
    return l.groupBy(bands.decade(F.year("l_shipdate")).alias("decade"), bands.sensor(platform).alias("sensor")).agg(F.count(F.lit(1)).alias("n"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws("\n", cycled("doc_id", TEXTS), "text")
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 17 != 0, text).otherwise(" \n").alias("text"), cycled("doc_id", SITES).alias("site"))


def citation_fields(spark: SparkSession, d: str) -> DataFrame:
    return textrules.citation_fields(_texts(spark, d)).drop("text", "site")


def name_normalise_match(spark: SparkSession, d: str) -> DataFrame:
    a, b = textrules.normalised_site(F.col("site")), textrules.normalised_site(textrules.cited_site(F.col("text")))
    return _texts(spark, d).select("doc_id", a.alias("site"), b.alias("cited"), textrules.names_match(a, b).alias("matches"))


def admission_cascade(spark: SparkSession, d: str) -> DataFrame:
    judged = textrules.admission(_texts(spark, d).withColumns({"fetched": F.col("doc_id") % 19 != 0, "has_key": F.col("doc_id") % 13 != 0}))
    return judged.groupBy("reason", "reason_detail", "admitted_pre_1975").agg(F.count(F.lit(1)).alias("n"), F.min("first_notified_year").alias("first_year"))


_JOINED = "orders JOIN customer ON o_custkey = c_custkey"
_BANDS = "SELECT vec_id, label, floor(abs(embedding[1]::DOUBLE) * 100000)::BIGINT AS b1, floor(abs(embedding[2]::DOUBLE) * 100000)::BIGINT AS b2, floor(abs(embedding[3]::DOUBLE) * 100000)::BIGINT AS b3, (vec_id % 64)::INTEGER AS qa FROM embeddings"
_R = "({0} * 0.0000275::DOUBLE - 0.2::DOUBLE)"
_TEXTS = f"SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN concat_ws(chr(10), {sql_cycled('doc_id', TEXTS)}, text) ELSE ' ' || chr(10) END AS text, {sql_cycled('doc_id', SITES)} AS site FROM documents"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(upper({0}), '\b(SSSI|NNR|S\.S\.S\.I\.)\b', ' ', 'g'), '\(.*?\)', ' ', 'g'), '[^A-Z0-9]+', ' ', 'g'))"
_MATCH = "(a <> '' AND b <> '' AND (starts_with(a, b) OR starts_with(b, a)))"
# RE2's \s is ASCII alone: the white space of Unicode is spelled out
_WS = r"[\s\x1c-\x1f\x{85}\pZ]"
_STRIP = rf"^{_WS}+|{_WS}+$"
_LABELS = dict(zip(("act49", "first", "act81", "again", "revised"), (f"(?i){p}".replace(r"\s", _WS) for p in (*(p for _, p in textrules.ORIGINAL_FIELDS), *textrules.RENOTIFIED_FIELDS, textrules.REVISION_FIELD)), strict=True))
_NOTE = f"(?i){textrules.BOUNDARY_NOTE}".replace(r"\s", _WS)
_SITE = f"(?i){textrules.SITE_NAME}".replace(r"\s", _WS)
_HEADER = textrules.HEADER_LINE.replace(r"\s", _WS)
# without look-ahead: what follows a label line by line, up to the first line that opens a field, or the fourth
_AFTER = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN string_split(substr(text, strpos(text, regexp_extract(text, '{p}')) + length(regexp_extract(text, '{p}'))), chr(10))[1:4] END AS {n}" for n, p in _LABELS.items())
_YEARS = ", ".join(
    f"try_cast(regexp_extract(array_to_string({n}[1:coalesce(list_min(list_filter([2, 3, 4], lambda i: regexp_matches(coalesce({n}[i], ''), '{textrules.LABEL_LINE.replace(chr(92) + 's', _WS)}'))) - 1, 4)], ' '), '{textrules.YEAR}', 1) AS INTEGER) AS y_{n}"
    for n in _LABELS
)
_FIELDS = rf"""
SELECT doc_id, text, site,
       CASE WHEN regexp_matches(text, '{_SITE}') THEN regexp_replace(regexp_extract(text, '{_SITE}', 1), '{_STRIP}', '', 'g')
            ELSE regexp_replace(regexp_extract(regexp_replace(coalesce(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_WS}', '', 'g') <> '')[1], ''), '{_STRIP}', '', 'g'), '{_HEADER}', 1), '{_STRIP}', '', 'g') END AS citation_site_name,
       coalesce(y_act49, y_first) AS first_notified_year, CASE WHEN y_act49 IS NOT NULL THEN '1949-act' WHEN y_first IS NOT NULL THEN 'first-notified' END AS original_field,
       act49 IS NOT NULL OR first IS NOT NULL AS original_field_seen, coalesce(y_act81, y_again) AS renotified_year, y_revised AS revision_year,
       CASE WHEN regexp_matches(text, '{_NOTE}') THEN regexp_replace(
         coalesce(string_split(substr(text, 1, spot - 1), chr(10))[-1], '') || found || string_split(substr(text, spot + length(found)), chr(10))[1], '{_STRIP}', '', 'g') END AS boundary_note
FROM (SELECT *, {_YEARS}, regexp_extract(text, '{_NOTE}') AS found, strpos(text, regexp_extract(text, '{_NOTE}')) AS spot FROM (SELECT *, {_AFTER} FROM t))"""

_BLANK = f"regexp_replace(text, '{_WS}', '', 'g') = ''"
#: The relation j: texts with what they say and how they are judged.
_JUDGED = rf"""
WITH t AS ({_TEXTS}), f AS (SELECT *, {_NORM.format('site')} AS a, {_NORM.format('citation_site_name')} AS b FROM ({_FIELDS})),
r AS (
  SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'no-citation-key' WHEN doc_id % 19 = 0 THEN 'fetch-failed' WHEN {_BLANK} THEN 'no-original-date'
    WHEN NOT {_MATCH} THEN 'identity-unverified' WHEN first_notified_year IS NULL THEN 'no-original-date'
    WHEN revision_year > first_notified_year OR boundary_note IS NOT NULL THEN 'boundary-history-unresolved' ELSE 'ok' END AS reason FROM f),
j AS (
  SELECT *, CASE WHEN reason = 'no-original-date' THEN CASE WHEN {_BLANK} THEN 'no-text' WHEN original_field_seen THEN 'original-field-blank' WHEN renotified_year IS NOT NULL THEN 'renotification-only' ELSE 'original-field-absent' END END AS reason_detail,
    CASE WHEN reason = 'ok' THEN first_notified_year < 1975 END AS admitted_pre_1975, CASE WHEN reason IN ('ok', 'boundary-history-unresolved') THEN first_notified_year END AS year FROM r)"""
#: The citations of a review, each beside its site's row in the register.
REVIEW_SQL = f"""
{_JUDGED},
s AS (
  SELECT a AS site_name, count(*) AS n_citations, count(year) FILTER (WHERE reason = 'ok') AS n_admitted, min(year) FILTER (WHERE reason = 'ok') AS site_year,
         count(DISTINCT year) FILTER (WHERE reason = 'ok') AS n_years, max(revision_year) AS last_revision FROM j GROUP BY a)
SELECT doc_id::VARCHAR AS key, length(text) AS n_chars, site_name, citation_site_name, year AS first_notified_year, CASE WHEN year IS NOT NULL THEN original_field END AS original_field, renotified_year, revision_year,
       boundary_note, reason_detail, admitted_pre_1975, reason, n_citations, n_admitted, site_year, n_years, last_revision,
       CASE WHEN n_years > 1 THEN 'conflicting' WHEN site_year < 1975 THEN 'admitted' WHEN n_years = 1 THEN 'later' ELSE 'unresolved' END AS status
FROM j JOIN s ON a = site_name"""

SQL = {
    "epoch_provenance": """
WITH e AS (SELECT DISTINCT (1960 + o_orderkey % 75)::INTEGER AS epoch FROM orders),
o(y, s) AS (VALUES (1975, 'MSS'), (1990, 'TM'), (2000, 'ETM+'), (2014, 'OLI'), (2018, 'S2')),
n AS (FROM e, o QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY abs(y - epoch), y) = 1)
SELECT epoch, CASE WHEN epoch = y THEN 'sensor-anchored' WHEN epoch > 2018 THEN 'projected' ELSE 'interpolated' END AS tag, CASE WHEN epoch = y THEN s END AS anchor_sensor,
       y AS nearest_obs_year, s AS nearest_obs_sensor, abs(epoch - y)::INTEGER AS obs_offset_years FROM n""",
    "grid_completion": f"""
WITH f AS (SELECT c_mktsegment AS segment, year(o_orderdate)::INTEGER AS year, o_orderpriority AS priority, count(*) AS n FROM {_JOINED} GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer), (SELECT DISTINCT year(o_orderdate)::INTEGER AS year FROM orders), (SELECT DISTINCT o_orderpriority AS priority FROM orders))
SELECT segment, year, priority, coalesce(n, 0) AS n FROM g LEFT JOIN f USING (segment, year, priority)""",
    "point_in_cell": f"""
WITH c AS (SELECT floor((59 - {SQL_LAT.format('c_custkey')}) / 0.5)::INTEGER AS row, floor(({SQL_LON.format('c_custkey')} + 6) / 0.5)::INTEGER AS col, count(*) AS value FROM customer GROUP BY ALL),
p AS (SELECT s_suppkey, floor((59 - {SQL_LAT.format('s_suppkey')}) / 0.5)::INTEGER AS row, floor(({SQL_LON.format('s_suppkey')} + 6) / 0.5)::INTEGER AS col FROM supplier)
SELECT s_suppkey, row, col, CASE WHEN value <> 1 THEN value END AS value FROM p LEFT JOIN c USING (row, col)""",
    "ring_cell_weights": """
WITH s AS (SELECT s_suppkey AS src_id, r, s_suppkey * 37 % 900 + 0.5::DOUBLE AS x, s_suppkey * 53 % 800 + 0.25::DOUBLE AS y FROM supplier, (VALUES (500.0::DOUBLE), (1500.0::DOUBLE)) v(r)),
a AS (SELECT src_id, r, 'col' AS axis, x AS c, y AS o FROM s UNION ALL SELECT src_id, r, 'row', y, x FROM s),
n AS (SELECT *, unnest(range(floor((c - r) / 100)::INTEGER, floor((c + r) / 100)::INTEGER + 1)) AS nth FROM a),
e AS (SELECT *, greatest(-r, least(r, nth * 100 - c)) AS lo, greatest(-r, least(r, nth * 100 + 100 - c)) AS hi, greatest(abs(nth * 100 - c), abs(nth * 100 + 100 - c)) AS far FROM n),
k AS (SELECT *, CASE WHEN far <= r THEN sqrt(r * r - far * far) END AS reach, round((hi * sqrt(r * r - hi * hi) + r * r * asin(hi / r) - lo * sqrt(r * r - lo * lo) - r * r * asin(lo / r)) / 10000, 6) AS cells FROM e)
SELECT src_id, r AS ring_m, axis, nth::INTEGER AS nth, cells, greatest(coalesce(floor((o + reach) / 100) - ceil((o - reach) / 100), 0), 0)::BIGINT AS whole FROM k WHERE cells > 0.00001""",
    "ring_weighted_fraction": """
WITH s AS (SELECT l_orderkey, sum(l_discount * l_quantity) AS b, sum(l_discount * (l_quantity + l_linenumber)) AS l, bool_and(l_returnflag <> 'A') AS ok FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN ok THEN round(b, 6) END AS built_sum, CASE WHEN ok THEN round(l, 6) END AS land_sum, CASE WHEN ok AND l > 0 THEN round(b / l, 6) END AS fraction,
       CASE WHEN NOT ok THEN 'no-coverage' WHEN l <= 0 THEN 'no-land-in-ring' END AS reason FROM s""",
    "ring_weighted_mean_gate": """
WITH s AS (SELECT l_orderkey, sum((l_discount + 1) * l_quantity) FILTER (WHERE l_returnflag <> 'A') AS s, sum(l_discount + 1) FILTER (WHERE l_returnflag <> 'A') AS ok, sum(l_discount + 1) AS a FROM lineitem GROUP BY 1),
f AS (SELECT *, coalesce(ok / a, 0) AS share FROM s)
SELECT l_orderkey, CASE WHEN share >= 0.6 THEN round(s / ok, 6) END AS mean, round(share, 6) AS valid_fraction, CASE WHEN share < 0.6 THEN 'insufficient-clear-coverage' END AS reason FROM f""",
    "dominant_class_pivot": f"""
WITH k AS (SELECT p_brand, p_type, list_position({LEGEND}, p_type) AS place, sum(p_size)::DOUBLE AS a FROM part WHERE list_contains({LEGEND}, p_type) GROUP BY ALL)
SELECT p_brand, arg_max(p_type, a * 100 - place) AS dominant, round(least(sum(a) / 2500.0, 1.0), 6) AS coverage,
       {', '.join(f"round(coalesce(sum(a) FILTER (WHERE place = {i}) / 2500.0, 0.0), 6) AS frac_{i}" for i in range(1, 6))} FROM k GROUP BY p_brand""",
    "radius_hits_list": f"""
WITH n AS (SELECT n_nationkey AS centre, {SQL_LAT.format('n_nationkey')} AS lat, {SQL_LON.format('n_nationkey')} AS lon FROM nation),
s AS (SELECT s_suppkey AS feature, {SQL_LAT.format('s_suppkey')} + 0.01::DOUBLE AS lat, {SQL_LON.format('s_suppkey')} AS lon FROM supplier),
r AS (SELECT * FROM (VALUES (50.0::DOUBLE), (200.0::DOUBLE), (1000.0::DOUBLE)) v(ring_km)),
h AS (SELECT centre, ring_km, feature FROM n, s, r WHERE {SQL_KM.format('n.lat', 'n.lon', 's.lat', 's.lon')} <= ring_km),
l AS (SELECT centre, ring_km, count(*) AS n, string_agg(feature, ';' ORDER BY feature) AS feature_ids FROM h GROUP BY ALL)
SELECT n.centre, r.ring_km, coalesce(l.n, 0) AS n, feature_ids, bool_or(coalesce(l.n, 0) > 0) OVER (PARTITION BY n.centre) AS flagged
FROM n CROSS JOIN r LEFT JOIN l ON l.centre = n.centre AND l.ring_km = r.ring_km""",
    "apportion_density_delta": f"""
WITH s AS (SELECT c_nationkey, year(o_orderdate)::INTEGER AS year, sum(o_totalprice * (o_orderkey % 4 + 1) / 8.0::DOUBLE) AS population, sum(o_orderkey % 4 + 1)::DOUBLE AS covered FROM {_JOINED} GROUP BY ALL),
x AS (SELECT *, CASE WHEN covered >= 0.8::DOUBLE * 200 THEN population / 200 END AS density FROM s)
SELECT c_nationkey, year, round(population, 1) AS population, round(density, 3) AS density,
       round(density - last_value(density IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3) AS delta,
       CASE WHEN covered < 0.8::DOUBLE * 200 THEN 'insufficient-boundary-coverage' END AS reason FROM x""",
    "band_indices": f"""
WITH b AS ({_BANDS}), r AS (SELECT vec_id, qa, {_R.format('b1')} AS r1, {_R.format('b2')} AS r2, {_R.format('b3')} AS r3 FROM b)
SELECT vec_id, round(CASE WHEN r2 + r1 <> 0 THEN (r2 - r1) / (r2 + r1) END, 5) AS ndvi, round(CASE WHEN r3 + r2 <> 0 THEN (r3 - r2) / (r3 + r2) END, 5) AS ndbi, (qa & 31) = 0 AS clear FROM r""",
    "median_composite_top8": f"""
WITH b AS ({_BANDS}), t AS (FROM b QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 8)
SELECT label, count(*) FILTER (WHERE qa < 60) AS n_clear, quantile_cont(b1, 0.5) FILTER (WHERE qa < 60) AS b1_median, quantile_cont(b2, 0.5) FILTER (WHERE qa < 60) AS b2_median FROM t GROUP BY label""",
    "season_decade_filter": """
SELECT (year(l_shipdate) // 10 * 10)::INTEGER AS decade, CASE WHEN year(l_shipdate) < 2000 THEN 'TM' ELSE 'ETM+' END AS sensor, count(*) AS n
FROM lineitem WHERE month(l_shipdate) BETWEEN 5 AND 9 GROUP BY ALL""",
    "citation_fields": f"WITH t AS ({_TEXTS}) SELECT * EXCLUDE (text, site) FROM ({_FIELDS})",
    "name_normalise_match": f"""
WITH t AS ({_TEXTS}), n AS (SELECT doc_id, {_NORM.format('site')} AS a, {_NORM.format('citation_site_name')} AS b FROM ({_FIELDS}))
SELECT doc_id, a AS site, b AS cited, {_MATCH} AS matches FROM n""",
    "admission_cascade": f"""
{_JUDGED}
SELECT reason, reason_detail, admitted_pre_1975, count(*) AS n, min(year) AS first_year FROM j GROUP BY ALL""",
}
QUERIES = {name: globals()[name] for name in SQL}
