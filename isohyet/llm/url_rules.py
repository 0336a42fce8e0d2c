"""Operator 1, URL filters: host-suffix and path-prefix expressions matched by hash prefix, then by full digest.

Every URL is expanded into the expressions that some rule could equal: a host suffix with as many labels as a
rule has, followed by a path prefix as long as a rule's path. Expressions join the rules on the first 32 bits of
their SHA-256; the full digest confirms; the longest confirmed rule decides. No Python runs on executors.

Defined cases: null urls and urls without '://' have empty host and path and take the default verdict; urls of any length
are matched whole; equal rows each return a row; an empty rule table leaves every page to the default verdict; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm.text import ascii_lower

#: Hex digits of the digest that the equi-join uses: 32 bits.
PREFIX_HEX = 8
#: Rule tables of up to this many rows (some 10 MB) are broadcast; larger ones are shuffled with salted pages.
BROADCAST_RULES = 50_000
#: Copies of each rule in the shuffled plan, so that a host that holds a third of the pages spreads out.
SALTS = 16

#: The production policy: (host, path, action).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; then up to '?' or '#'."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    pick = lambda group: F.coalesce(F.regexp_extract(url, pattern, group), F.lit(""))
    return ascii_lower(pick(1)), pick(2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as literals of the plan; large rule sets come as tables of their own."""
    rows = [F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("host", "path", "action"), rule, strict=True)]) for rule in rules]
    made = F.array(*rows) if rows else F.lit(None).cast("array<struct<host:string,path:string,action:string>>")
    return spark.range(1).select(F.inline(made))


def _digested(rules: DataFrame) -> DataFrame:
    text = F.concat("host", "path")
    return (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(text.alias("rule"), "action", F.sha2(text, 256).alias("rule_digest"), F.length("host").alias("host_len"))
        # of equal rules with both actions, block stands
        .groupBy("rule", "rule_digest", "host_len")
        .agg(F.max("action").alias("action"))
        .withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    )


def _expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    labels = F.size(F.split(host, r"\.", -1))
    made = [
        F.when((labels >= k) & (F.length(path) >= n), F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n)))
        for k, n in shapes
    ]
    return F.filter(F.array(*made), lambda e: e.isNotNull()) if made else F.array().cast("array<string>")


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of pages; rules: (host, path, action allow or block)."""
    digested = _digested(rules)
    # Label counts and path lengths that occur among the rules: a few integers, whatever the number of rules.
    shapes = sorted(
        (r.labels, r.length)
        for r in rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("length"))
        .distinct()
        .collect()
    )
    n_rules = digested.count()
    host, path = split_url(F.col("__url"))
    base = (
        pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"))
        .select("__key", host.alias("host"), path.alias("path"), F.spark_partition_id().alias("part"))
        .select("*", F.posexplode_outer(_expressions(F.col("host"), F.col("path"), shapes)).alias("pos", "expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    on = [F.col("prefix") == F.col("rule_prefix")]
    if n_rules <= BROADCAST_RULES:
        digested = F.broadcast(digested)
    else:
        base = base.withColumn("salt", F.pmod(F.xxhash64("__key", "host", "path"), F.lit(SALTS)).cast("int"))
        digested = digested.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on.append(F.col("salt") == F.col("rule_salt"))
    joined = base.join(digested, reduce(Column.__and__, on), "left")
    fits = F.col("digest") == F.col("rule_digest")
    rank = F.when(fits, F.struct(F.length("rule").alias("len"), "host_len", "rule", "action"))
    # part keeps copies of a row that fill a third of the table from meeting in one task; matches go by page, not by rule.
    found = joined.groupBy("__key", "host", "path", "part").agg(
        F.max(rank).alias("best"), F.count(F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, 1)).alias("copies")
    )
    return found.select(
        F.col("__key").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("__copy"),
    ).drop("__copy")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


_VALUES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
SQL = rf"""
WITH rules(host, path, action) AS (VALUES {_VALUES}),
split AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '') AS raw_host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path, row_number() OVER () AS rn
  FROM pages),
parts AS (
  SELECT page_id, rn, path,
         translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM split),
fit AS (
  SELECT rn, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(action, length(r.host || r.path)) AS action
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY rn)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parts p LEFT JOIN fit f USING (rn)
"""
