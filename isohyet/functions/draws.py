"""Draws that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | int | str) -> Column:
    """A number from 0 to 2**32 - 1: the first eight digits of the MD5 of the parts as text, with bars between them."""
    text = F.concat_ws("|", *[(F.lit(p) if not isinstance(p, Column) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sql_draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(f'({p})::VARCHAR' for p in parts)})), 1, 8))::BIGINT"
