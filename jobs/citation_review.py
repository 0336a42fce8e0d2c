"""Job 2: texts of citations become a reviewed table and a register of sites.

    python -m jobs.citation_review --texts FOLDER --out FOLDER [--config jobs/citation_review.json]

Every text is searched for what a citation says (site, years of notification, renotification and revision, boundary notes) and judged: admitted,
or the first reason that stands against it. The job writes

* out/citations, by reason: a row for every text, without the text;
* out/register, by status: a row for every site, as its citations agree or not;
* out/tally: how many texts each reason and detail has.

The register and the tally are made from the citations as written, so that texts are read and searched once, in one pass without a shuffle of texts. Each
table is replaced as a whole: a rerun over the same texts leaves the same rows, and one over changed texts leaves no partition of the earlier run behind.

A site goes by its normalised name. Its status is 'conflicting' if admitted citations name different years, 'admitted' if one names a year before the limit,
'later' if they name later years, 'unresolved' without an admitted citation. Config: the texts' format and SQL expressions for key, site, text, has_key and
fetched. Null sites are reviewed (no citation is theirs) and stand in the register under an empty name.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.textrules import ADMITTED_BEFORE, admission, normalised_site

log = logging.getLogger("citation_review")

COLUMNS = {"key": "string", "site": "string", "text": "string", "has_key": "boolean", "fetched": "boolean"}
FIELDS = "site_name string, citation_site_name string, first_notified_year int, original_field string, original_field_seen boolean, renotified_year int, revision_year int, boundary_note string, reason_detail string, admitted_pre_1975 boolean"
CITATIONS = f"key string, site string, n_chars long, {FIELDS}, reason string"
REGISTER = "site_name string, n_citations long, n_admitted long, first_notified_year int, n_years long, last_revision int, status string"


def reviewed(texts: DataFrame) -> DataFrame:
    """A row for every text (COLUMNS), judged, without the text."""
    sure = texts.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_key", "fetched")})
    named = admission(sure).withColumns({"site_name": F.coalesce(normalised_site(F.col("site")), F.lit("")), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")})
    return named.select(*[c.split()[0] for c in CITATIONS.split(", ")])


def register(citations: DataFrame) -> DataFrame:
    """A row for every site."""
    year = F.when(F.col("reason") == "ok", F.col("first_notified_year"))
    sites = citations.groupBy("site_name").agg(
        F.count(F.lit(1)).alias("n_citations"), F.count(year).alias("n_admitted"), F.min(year).alias("first_notified_year"), F.count_distinct(year).alias("n_years"), F.max("revision_year").alias("last_revision")
    )
    status = F.when(F.col("n_years") > 1, "conflicting").when(F.col("first_notified_year") < ADMITTED_BEFORE, "admitted").when(F.col("n_years") == 1, "later").otherwise("unresolved")
    return sites.withColumn("status", status)


def put(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the table; its partitions are evened out over tasks, whatever their size."""
    rows.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).parquet(path)


def run(spark: SparkSession, texts: str, out: str, config: dict) -> dict[str, int]:
    """Reviews all texts and returns the number of texts of every reason."""
    log.info("reading %s", texts)
    rows = spark.read.format(config["format"]).load(texts)
    put(reviewed(rows.select(*[F.expr(config["columns"][c]).cast(t).alias(c) for c, t in COLUMNS.items()])), f"{out}/citations", "reason")
    citations = spark.read.schema(CITATIONS).parquet(f"{out}/citations")
    put(register(citations), f"{out}/register", "status")
    tally = citations.groupBy("reason", "reason_detail").agg(F.count(F.lit(1)).alias("n"))
    tally.coalesce(1).write.mode("overwrite").json(f"{out}/tally")
    numbers: dict[str, int] = {}
    for r in spark.read.schema("reason string, reason_detail string, n long").json(f"{out}/tally").collect():
        log.info("%s (%s): %d texts", r.reason, r.reason_detail or "-", r.n)
        numbers[r.reason] = numbers.get(r.reason, 0) + r.n
    log.info("%d texts read, citations, register and tally written to %s", sum(numbers.values()), out)
    return numbers


def main() -> None:
    parser = argparse.ArgumentParser(description="Review of citation texts and a register of their sites.")
    for name in ("texts", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=f"{__file__.removesuffix('.py')}.json")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config) as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("citation_review").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.texts, args.out, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
