"""Lenient typing of raw tokens: a value, or null with the cause of the null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plain decimal notation; rules out suffixes and hexadecimal forms that a cast would take.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
#: What a token of that format can look like: parsing others costs an exception each.
TIME_LOOK = r"^[+-]?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01]) ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"
TWO_63 = 9.223372036854775808e18


def lenient_int(token: Column) -> Column:
    """A 64-bit integer, or a finite integral number within its range; else null. Never saturates."""
    plain = F.when(token.rlike(r"^[+-]?[0-9]+$"), token.try_cast("bigint"))
    number = F.when(token.rlike(NUMBER), token.try_cast("double"))
    integral = (number >= -TWO_63) & (number < TWO_63) & (F.floor(number).cast("double") == number)
    return F.coalesce(plain, F.when(integral, number.cast("bigint")))


def finite_float(token: Column) -> Column:
    """A finite 32-bit float, or null."""
    value = F.when(token.rlike(NUMBER), token.try_cast("float"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def utc_time(token: Column) -> Column:
    return F.when(token.rlike(TIME_LOOK), F.try_to_timestamp(token, F.lit(TIME_FORMAT)))


PARSERS = {"int": lenient_int, "float": finite_float, "time": utc_time, "char": lambda token: token}


def cause(token: Column, kind: str) -> Column:
    """Why a token has no value: 'na', 'empty' or 'coerced'; null where it has one."""
    token = F.trim(token)
    return (
        F.when(token.isNull() | (token == ""), "empty").when(token == "NA", "na").when(PARSERS[kind](token).isNull(), "coerced")
    )


def value(token: Column, kind: str) -> Column:
    token = F.trim(token)
    return F.when((token != "NA") & (token != ""), PARSERS[kind](token))


def resolved_type(declared: Column, is_time: Column, name: Column) -> Column:
    """Declared type, promoted to time for time coordinates, and text for quality and descriptor columns whatever is declared."""
    numeric = F.when(declared.isin("int", "float"), declared).otherwise("char")
    return F.when(name.rlike("_[qj]$"), "char").when(is_time, "time").otherwise(F.coalesce(numeric, F.lit("char")))


def decimal_places(text: Column) -> Column:
    """Digits behind the point in the text of a number."""
    return F.length(F.coalesce(F.get(F.split(text, r"\."), F.lit(1)), F.lit(""))).cast("int")


def finite(value: Column) -> Column:
    """value as a double, null where it is NaN or infinite."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
