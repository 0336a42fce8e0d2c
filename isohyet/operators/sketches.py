"""Distinct counts that merge: sketches kept by group, united over groups and over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The logarithm of a sketch's registers: 2**12 of them, a few kilobytes, have a relative standard error of 1.04 / 2**6.
LOG_REGISTERS = 12


def standard_error(log_registers: int = LOG_REGISTERS) -> float:
    return 1.04 / 2 ** (log_registers / 2)


def sketched(rows: DataFrame, by: list[str], column: Column, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(by, sketch): one for every group; nulls are in none."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(column, F.lit(log_registers)).alias("sketch"))


def united(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, sketch) of coarser groups, or of the same ones over several runs (unionByName of their tables); the values are not read again."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))


def estimated(sketches: DataFrame, name: str = "n_distinct") -> DataFrame:
    """sketches with their estimates instead."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")
