import pytest
from pyspark.sql import functions as F

from isohyet.functions import coerce

INTS = {"300": 300, "300.0": 300, "-5": -5, "0": 0, "9223372036854775807": 2**63 - 1, "-9223372036854775808": -(2**63), "300.5": None, "/": None, "&": None, "": None, "1e30": None, "-1e30": None, "inf": None, "-inf": None, "NaN": None, "9223372036854775808.0": None, "abc": None, "1.5d": None}
FLOATS = {"1.5": 1.5, "-2": -2.0, "1e3": 1000.0, ".5": 0.5, "inf": None, "NaN": None, "1e39": None, "1.5f": None, "0x1p3": None, "infinity": None, "": None}


@pytest.mark.parametrize("parse,table", [(coerce.lenient_int, INTS), (coerce.finite_float, FLOATS)])
def test_tokens(spark, parse, table):
    df = spark.createDataFrame([(t,) for t in table], "t string").select("t", parse(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == table


def test_causes(spark):
    cases = [("NA", "na"), ("", "empty"), (" ", "empty"), ("abc", "coerced"), ("12", None)]
    got = spark.createDataFrame(cases, "t string, want string").select("want", coerce.cause(F.col("t"), "int").alias("c")).collect()
    assert all(r.want == r.c for r in got)


def test_types_of_columns(spark):
    cases = [("int", False, "x", "int"), ("char", False, "x", "char"), (None, False, "x", "char"), ("char", True, "at", "time"), ("int", True, "x_q", "char"), ("float", False, "x_j", "char")]
    got = spark.createDataFrame(cases, "d string, t boolean, n string, want string").select("want", coerce.resolved_type(F.col("d"), F.col("t"), F.col("n")).alias("k")).collect()
    assert all(r.want == r.k for r in got)
