"""Text primitives shared by the native operators: all are plain Column expressions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of maximal runs of non-white-space characters; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+", -1), "")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII strings take the byte-wise path of lower()."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    )


def free_prefix(columns: list[str]) -> str:
    """Underscores that no column's name begins with: an operator's own columns beside a user's."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes that the session lets a join broadcast (spark.sql.autoBroadcastJoinThreshold)."""
    said = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(said)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row.

    A plain reference inside a lambda would be inlined by the optimizer and recomputed for every array
    element; a one-element transform binds it as a lambda variable instead.
    """
    return F.transform(F.array(value), body).getItem(0)
