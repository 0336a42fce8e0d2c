"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, each stage on what the last one kept.

Defined cases of every stage: null and empty texts are documents without words, which the quality rules reject; should they come to a
later stage, it keeps them (mixing takes nothing of them); texts of any length are read whole; repeated rows are documents of their
own, but one document to line dedup and near-dedup, which keep or change all of them alike; ties fall as the stage's operator says; an
empty table gives an empty one; extra columns, whatever their names, pass all stages but the last, which returns pieces.
The tables between the stages are written to the shared folder and go with the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from isohyet.llm.text import free_prefix
from isohyet.session import scratch_dir


def _beside(docs: DataFrame, used: list[str], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """operator(docs), with the columns that it doesn't use out of the way of its own ones; returns the columns of docs."""
    rest, beside = [c for c in docs.columns if c not in used], f"{free_prefix(docs.columns)}rest"
    out = operator(docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias(beside)))
    return out.select(*[F.col(c) if c in used else F.col(beside).getField(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality_rules.keep_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    kept = _beside(docs, ["doc_id", "text"], line_dedup.dedup_lines)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 and more."""
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every whole copy of a document that the mix takes."""
    return _beside(docs, ["doc_id", "source", "text"], lambda d: mixing.repeat_documents(mixing.mix(d)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix with their token ids and places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: The seeded choices of mixing and packing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
