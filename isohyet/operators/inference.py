"""Inference over many tests and layers: false discovery rate, familywise tolerance, votes, terciles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.coerce import finite
from isohyet.operators.ranking import ranked


def benjamini_hochberg(tests: DataFrame, key: str, p: str, alpha: float = 0.05, family: str | None = None) -> DataFrame:
    """tests with rank and significant: all up to the largest rank k with p <= k / m * alpha, within each family.

    A missing or NaN p is no test: it has no rank, counts in no m and isn't significant.
    """
    done = finite(F.col(p)).isNotNull()
    placed = ranked(tests.where(done), [p, key], family)
    group = [F.col(family).alias("__family")] if family else []
    sizes = tests.where(done).groupBy(*group).agg(F.count(F.lit(1)).alias("__m"))
    on = F.col(family).eqNullSafe(F.col("__family")) if family else F.lit(True)
    tried = placed.join(sizes, on)
    cut = tried.where(F.col(p) <= F.col("rank") * alpha / F.col("__m")).groupBy(*[F.col("__family").alias("__f")] * bool(family)).agg(F.max("rank").alias("__top"))
    back = F.col(family).eqNullSafe(F.col("__f")) if family else F.lit(True)
    judged = tried.join(cut, back, "left").withColumn("significant", F.coalesce(F.col("rank") <= F.col("__top"), F.lit(False))).drop("__m", "__family", "__f", "__top")
    return judged.unionByName(tests.where(done.isNull() | ~done).withColumns({"rank": F.lit(None).cast("long"), "significant": F.lit(False)}))


def familywise_tolerance(draws: DataFrame, draw: str, z: Column, level: float = 0.99) -> DataFrame:
    """(critical, n_draws): the quantile of the largest absolute statistic of each draw."""
    worst = draws.groupBy(draw).agg(F.max(F.abs(z)).alias("worst"))
    return worst.agg(F.percentile("worst", level).alias("critical"), F.count(F.lit(1)).alias("n_draws"))


def tolerances(worst: DataFrame, spreads: DataFrame, of: str, spread: str) -> DataFrame:
    """(of, tolerance): the familywise critical value times each pair's own spread."""
    return spreads.join(F.broadcast(worst.select("critical"))).select(of, (F.col("critical") * F.col(spread)).alias("tolerance"))


def agreement(layers: DataFrame, layer_columns: list[str], one_way: list[str]) -> DataFrame:
    """layers with status, voters, abstained and disagreeing: null abstains; a one-way layer votes only when it is true."""
    votes = {c: F.when(F.col(c), F.lit(True)) if c in one_way else F.col(c) for c in layer_columns}
    cast = F.array_compact(F.array(*votes.values()))
    yes = F.size(F.filter(cast, lambda v: v))
    n = F.size(cast)
    status = F.when(n == 0, "unclassified").when((yes == n) | (yes == 0), "confirmed").otherwise("disputed")
    # with a majority for either side, the others disagree
    minority = F.when(yes * 2 >= n, False).otherwise(True)
    against = F.array_compact(F.array(*[F.when((v == minority) & (status == "disputed"), c) for c, v in votes.items()]))
    return layers.withColumns({"status": status, "voters": n, "abstained": len(layer_columns) - n, "disagreeing": F.array_join(against, ";")})


def terciles(rows: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """rows with tercile 1 to 3 of value within by."""
    return rows.withColumn("tercile", F.ntile(3).over(Window.partitionBy(*by).orderBy(value, tie)))
