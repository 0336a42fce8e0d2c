"""The jobs as registered queries: each runs twice over the whole tables into one new folder and returns the output as it stands then."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.plans import layer_queries
from isohyet.session import shared_dir
from jobs import citation_review, daily_observations


def config_of(job) -> dict:
    return json.loads(Path(job.__file__).with_suffix(".json").read_text())


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_daily_observations(spark: SparkSession, d: str) -> DataFrame:
    folder, config = new_folder(spark, "job1"), config_of(daily_observations)
    for _ in range(2):
        # a pattern, as a stream's plain path must be a folder, and the table may be one file
        daily_observations.run(spark, f"{d}/events.parque[t]", f"{folder}/out", f"{folder}/checkpoint", config)
    daily = spark.read.schema(daily_observations.DAILY).parquet(f"{folder}/out/daily")
    return daily.withColumn("mean", F.round("mean", 6))


def quoted(text: str | None) -> str:
    """A string of Spark SQL."""
    return "NULL" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def picked(values: list[str]) -> str:
    return f"element_at(array({', '.join(map(quoted, values))}), cast(doc_id % {len(values)} + 1 AS int))"


#: Documents as citations: a header before each whole text, and the site that it is asked about.
CITATION_COLUMNS = {
    "key": "doc_id",
    "site": picked(layer_queries.SITES),
    "text": f"CASE WHEN doc_id % 17 <> 0 THEN concat_ws('\\n', {picked(layer_queries.TEXTS)}, text) ELSE ' \\n' END",
    "has_key": "doc_id % 13 <> 0",
    "fetched": "doc_id % 19 <> 0",
}


def job2_citation_review(spark: SparkSession, d: str) -> DataFrame:
    """The citations, each beside its site's row in the register."""
    folder, config = new_folder(spark, "job2"), config_of(citation_review) | {"columns": CITATION_COLUMNS}
    for _ in range(2):
        citation_review.run(spark, f"{d}/documents.parquet", f"{folder}/out", config)
    citations = spark.read.schema(citation_review.CITATIONS).parquet(f"{folder}/out/citations")
    sites = spark.read.schema(citation_review.REGISTER).parquet(f"{folder}/out/register").withColumnRenamed("first_notified_year", "site_year")
    return citations.drop("site", "original_field_seen").join(sites, "site_name")


QUERIES = {"job1_daily_observations": job1_daily_observations, "job2_citation_review": job2_citation_review}

SQL = {
    "job1_daily_observations": """
WITH r AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT day, user_id, event_type, count(DISTINCT (hour, event_id)) AS n_reports FROM r GROUP BY ALL),
h AS (SELECT day, user_id, event_type, CASE WHEN NOT isnan(value) THEN value END AS value FROM r QUALIFY row_number() OVER (PARTITION BY day, user_id, event_type, hour ORDER BY ts, event_id::VARCHAR) = 1),
f AS (SELECT day, user_id, event_type, count(*) AS n_hours, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM h GROUP BY ALL)
SELECT user_id::VARCHAR AS station, event_type AS kind, n_reports, n_hours, low, high, mean,
       CASE WHEN n_hours <= 1 THEN '1' WHEN n_hours <= 3 THEN '2-3' WHEN n_hours <= 11 THEN '4-11' WHEN n_hours <= 19 THEN '12-19' ELSE '20-24' END AS band, day
FROM f JOIN n USING (day, user_id, event_type)""",
    "job2_citation_review": layer_queries.REVIEW_SQL,
}
