"""Whether leaving rows out changes a distribution: gaps of cumulative shares, differences of means and spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.coerce import finite
from isohyet.session import shared_dir

#: The factor of the two-sample critical gap at 5 %.
CRITICAL = 1.3581


def exclusion_gaps(rows: DataFrame, by: list[str], covariates: list[str], excluded: str) -> DataFrame:
    """(by, covariate, n_kept, n_excluded, gap, gap_at, mean_difference, spread_ratio, critical, neutral): kept against excluded rows.

    gap: the largest difference of the shares up to a value, gap_at the least value that has it; equal values step together. mean_difference: of
    excluded less kept, in units of their pooled standard deviation; spread_ratio: of standard deviations. neutral: the gap is below the
    critical one at 5 %. Undefined figures are null, without rows of one side all are. Rows with a null flag are kept ones; missing and
    non-finite values don't count.

    Values are counted first, dealt to ranges, and each range's running counts start from what the ranges before it hold: no task
    sorts a whole covariate.
    """
    shared_dir(rows.sparkSession)
    out = F.coalesce(F.col(excluded), F.lit(False))
    each = rows.select(*by, out.alias("__out"), F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), finite(F.col(c)).alias("__v")) for c in covariates])).alias("__x"))
    each = each.select(*by, "__out", "__x.covariate", "__x.__v").where("__v IS NOT NULL")
    keys = [*by, "covariate"]
    counted = each.groupBy(*keys, "__v").agg(F.count_if(~F.col("__out")).alias("__a"), F.count_if("__out").alias("__b"))
    laid = counted.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()).checkpoint()
    # a row for every key of every range
    held = laid.groupBy(*keys, "__part").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(
        *[F.col(c).alias(f"__key_{c}") for c in keys], F.col("__part").alias("__p"), F.coalesce(F.sum("__a").over(before), F.lit(0)).alias("__a0"), F.coalesce(F.sum("__b").over(before), F.lit(0)).alias("__b0"),
        F.sum("__a").over(of_key).alias("n_kept"), F.sum("__b").over(of_key).alias("n_excluded"),
    )
    on = (F.col("__part") == F.col("__p")) & F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    inside = Window.partitionBy("__part", *keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = laid.withColumns({"__ra": F.sum("__a").over(inside), "__rb": F.sum("__b").over(inside)}).join(starts, on)
    share = F.abs(F.try_divide(F.col("__a0") + F.col("__ra"), F.col("n_kept")) - F.try_divide(F.col("__b0") + F.col("__rb"), F.col("n_excluded")))
    # the gap as a ratio of integers, so that equal gaps are equal whatever the order of division
    gaps = ran.withColumn("__g", F.round(share, 12)).groupBy(*keys, "n_kept", "n_excluded").agg(F.max("__g").alias("gap"), F.min_by("__v", F.struct(-F.col("__g"), "__v")).alias("gap_at"))
    side = lambda name: F.when(F.col("__out") == (name == "b"), F.col("__v"))
    moments = each.groupBy(*[F.col(c).alias(f"__key_{c}") for c in keys]).agg(*[f(side(s)).alias(f"__{n}_{s}") for s in "ab" for n, f in (("mean", F.avg), ("var", F.var_samp))])
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    pooled = F.sqrt((F.col("__var_a") + F.col("__var_b")) / 2)
    critical = CRITICAL * F.sqrt(F.try_divide(F.col("n_kept") + F.col("n_excluded"), (F.col("n_kept") * F.col("n_excluded")).cast("double")))
    both = (F.col("n_kept") > 0) & (F.col("n_excluded") > 0)
    return gaps.join(moments, match).select(
        *keys, "n_kept", "n_excluded", F.when(both, F.col("gap")).alias("gap"), F.when(both, F.col("gap_at")).alias("gap_at"), F.try_divide(F.col("__mean_b") - F.col("__mean_a"), pooled).alias("mean_difference"),
        F.try_divide(F.sqrt("__var_b"), F.sqrt("__var_a")).alias("spread_ratio"), F.when(both, critical).alias("critical"), F.when(both, F.col("gap") < critical).alias("neutral"),
    )
