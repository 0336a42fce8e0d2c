"""Audits: report keys, table reconciliation, quality-control effects, flags, observation density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.coerce import finite

#: Magnitude bands of quality-control changes and hours-a-day bins.
MAGNITUDES = ((0.2, "<=0.2"), (1.0, "0.2-1"), (5.0, "1-5"), (20.0, "5-20"))
DAY_BINS = ((1, "1"), (3, "2-3"), (11, "4-11"), (19, "12-19"))


def banded(value: Column, bands: tuple, above: str) -> Column:
    out = F.lit(above)
    for limit, name in reversed(bands):
        out = F.when(value <= limit, name).otherwise(out)
    return out


def one_per_key(reports: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first report of each key in order."""
    return reports.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def duplicate_check(reports: DataFrame, keys: list[str]) -> DataFrame:
    """(n_rows, n_keys, n_surplus)."""
    per_key = reports.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), (F.sum("n") - F.count(F.lit(1))).alias("n_surplus"))


def fingerprint(table: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, column, n_rows, n_values, low, high, total): a row for every column of every group."""
    measured = table.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (("v", F.count), ("lo", F.min), ("hi", F.max), ("sum", F.sum))],
    )
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__v").alias("n_values"), F.col(f"{c}__lo").alias("low"), F.col(f"{c}__hi").alias("high"), F.col(f"{c}__sum").alias("total")) for c in columns]
    return measured.select(by, "n_rows", F.explode(F.array(*structs)).alias("s")).select(by, "n_rows", "s.*")


def reconcile(old: DataFrame, new: DataFrame, by: str, columns: list[str], digits: int = 4) -> DataFrame:
    """(by, column, status): groups and columns whose fingerprints differ, or that one side lacks, and those that agree."""
    side = lambda t, n: fingerprint(t, by, columns).select(F.col(by).alias(f"{n}_by"), F.col("column").alias(f"{n}_column"), F.struct("n_rows", "n_values", F.round("low", digits).alias("low"), F.round("high", digits).alias("high"), F.round("total", digits).alias("total")).alias(n))
    a, b = side(old, "old"), side(new, "new")
    both = a.join(b, a["old_by"].eqNullSafe(b["new_by"]) & (a["old_column"] == b["new_column"]), "full_outer")
    status = F.when(F.col("old").isNull(), "only-new").when(F.col("new").isNull(), "only-old").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("differs")
    return both.select(F.coalesce("old_by", "new_by").alias(by), F.coalesce("old_column", "new_column").alias("column"), status.alias("status"))


def qc_effects(before: DataFrame, after: DataFrame, keys: list[str], value: str, order: list) -> DataFrame:
    """Rows of after with matched, outcome, delta, changed and band; duplicate keys settle on the first in order.

    outcome: 'created' where control gave a value to a report without one, 'deleted' where it took it, 'changed', 'unchanged' (missing in
    both as well) or 'unmatched', where before lacks the key. delta is 0 but for changed values; created and deleted ones have none. NaN is missing.
    """
    a = one_per_key(after, keys, order).withColumn(value, finite(F.col(value)))
    b = one_per_key(before, keys, order).select(*[F.col(k).alias(f"b_{k}") for k in keys], finite(F.col(value)).alias("b_value"), F.lit(True).alias("b_there"))
    on = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    had, has = F.col("b_value").isNotNull(), F.col(value).isNotNull()
    outcome = F.when(~F.col("matched"), "unmatched").when(~had & has, "created").when(had & ~has, "deleted").when(had & has & (F.col(value) != F.col("b_value")), "changed").otherwise("unchanged")
    joined = a.join(b, on, "left").withColumn("matched", F.coalesce("b_there", F.lit(False))).withColumn("outcome", outcome).withColumn("changed", F.col("outcome") == "changed")
    delta = F.when(F.col("changed"), F.col(value) - F.col("b_value")).when(~F.col("outcome").isin("created", "deleted"), 0.0)
    joined = joined.withColumn("delta", delta)
    return joined.withColumn("band", F.when(F.col("changed"), banded(F.abs("delta"), MAGNITUDES, ">20"))).drop(*[f"b_{k}" for k in keys], "b_value", "b_there")


def two_part(effects: DataFrame, by: str) -> DataFrame:
    """(by, n, n_created, n_deleted, n_changed, p_changed, mean_when_changed, mean_delta): probability of a change times its mean.

    Values created and deleted are counted apart: n and the two parts are over the others.
    """
    compared = ~F.col("outcome").isin("created", "deleted")
    return effects.groupBy(by).agg(
        F.count_if(compared).alias("n"), F.count_if(F.col("outcome") == "created").alias("n_created"), F.count_if(F.col("outcome") == "deleted").alias("n_deleted"),
        F.count_if("changed").alias("n_changed"), F.try_divide(F.count_if("changed"), F.count_if(compared)).alias("p_changed"),
        F.avg(F.when(F.col("changed"), F.col("delta"))).alias("mean_when_changed"), F.avg("delta").alias("mean_delta"),
    )


def flag_digits(flag: Column) -> dict[str, Column]:
    """The five positional digits of a quality flag, padded on the left, and its residual class."""
    padded = F.lpad(flag.cast("string"), 5, "0")
    digits = {f"d{i}": F.substring(padded, i, 1).cast("int") for i in range(1, 6)}
    return digits | {"residual": F.when(F.length(flag.cast("string")) > 5, "overlong").when(padded.rlike("^[0-9]{5}$"), "clean").otherwise("malformed")}


def day_density(events: DataFrame, station: str, time: str) -> DataFrame:
    """(bin, n_days, share): station-days by their number of observations."""
    days = events.groupBy(station, F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    bins = days.groupBy(banded(F.col("n"), DAY_BINS, "20-24").alias("bin")).agg(F.count(F.lit(1)).alias("n_days"))
    return bins.withColumn("share", F.col("n_days") / F.sum("n_days").over(Window.partitionBy()))
