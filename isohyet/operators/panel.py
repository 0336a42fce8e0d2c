"""Panels of stations and periods: regressions with effects of both, event studies around treatment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.functions.coerce import finite
from isohyet.session import shared_dir

#: Period means, as parts of a column's spread, that count as none; rounds before a fit is given up.
TOLERANCE, ROUNDS = 1e-11, 500
#: Tables of period means of up to this many rows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 50_000


def without_effects(rows: DataFrame, unit: str, period: str, columns: list[str], tolerance: float = TOLERANCE, most: int = ROUNDS) -> tuple[DataFrame, int]:
    """rows with the columns less their unit's and period's effects, and the number of rounds.

    Rounds of two steps: the unit's mean is taken off, then the period's. When the periods' means vanish behind the units' the
    columns are free of both. A balanced panel takes two rounds; each round is written, so that a lost executor costs one.
    """
    shared_dir(rows.sparkSession)
    spread = rows.agg(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in columns]).first()
    own = Window.partitionBy(unit)
    for done in range(1, most + 1):
        rows = rows.withColumns({c: F.col(c) - F.avg(c).over(own) for c in columns}).checkpoint()
        means = rows.groupBy(F.col(period).alias("__period")).agg(*[F.avg(c).alias(f"__{c}") for c in columns]).checkpoint()
        size = means.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.max(F.abs(f"__{c}")), F.lit(0.0)).alias(c) for c in columns]).first()
        if all(size[c] <= tolerance * spread[c] for c in columns):
            return rows, done
        means = F.broadcast(means) if size.n <= BROADCAST_ROWS else means
        rows = rows.join(means, F.col(period) == F.col("__period")).withColumns({c: F.col(c) - F.col(f"__{c}") for c in columns}).drop("__period", *[f"__{c}" for c in columns])
    raise ArithmeticError(f"no convergence within {most} rounds")


def two_way_fit(panel: DataFrame, unit: str, period: str, value: str, regressors: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(term, coefficient, stderr, n, n_units, rounds) of the least squares of value on the regressors beside unit and period effects.

    Errors are robust to any dependence within a unit: scores are summed by unit, and G / (G - 1) corrects for G units. A regressor that
    the effects or the others explain has neither coefficient nor error. Rows without a unit, a period or finite numbers don't count.
    """
    spark = panel.sparkSession
    columns = ["__y", *[f"__x{i}" for i in range(len(regressors))]]
    rows = panel.select(F.col(unit).alias("__unit"), F.col(period).alias("__t"), *[finite(F.col(c)).alias(a) for c, a in zip([value, *regressors], columns, strict=True)])
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in ("__unit", "__t", *columns)))
    free, rounds = without_effects(rows, "__unit", "__t", columns, tolerance)
    k = len(columns)
    moments = free.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__unit").alias("units"), *[F.coalesce(F.sum(F.col(columns[i]) * F.col(columns[j])), F.lit(0.0)).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    gram = np.array([[moments[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    a, b = gram[1:, 1:], gram[1:, 0]
    # in order, those that the ones before leave something of
    before = rows.agg(*[F.coalesce(F.sum(F.pow(F.col(c) - m, 2)), F.lit(0.0)).alias(c) for c, m in zip(columns, rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in columns]).first(), strict=True)]).first()
    use: list[int] = []
    for i in range(k - 1):
        left = a[i, i] - (a[i, use] @ np.linalg.solve(a[np.ix_(use, use)], a[use, i]) if use else 0.0)
        if left > 1e-9 * max(before[columns[i + 1]], 1e-300):
            use.append(i)
    beta, error = np.full(k - 1, np.nan), np.full(k - 1, np.nan)
    if use:
        beta[use] = np.linalg.solve(a[np.ix_(use, use)], b[use])
        residual = F.col("__y") - sum((F.lit(float(beta[i])) * F.col(columns[i + 1]) for i in use), F.lit(0.0))
        scores = free.withColumn("__e", residual).groupBy("__unit").agg(*[F.sum(F.col(columns[i + 1]) * F.col("__e")).alias(f"s{i}") for i in use])
        sums = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"s{i}_{j}") for i in use for j in use]).first()
        middle, inverse = np.array([[sums[f"s{i}_{j}"] for j in use] for i in use]), np.linalg.inv(a[np.ix_(use, use)])
        if moments.units > 1:
            error[use] = np.sqrt(np.diag(inverse @ middle @ inverse) * moments.units / (moments.units - 1))
    null = lambda v: None if np.isnan(v) else float(v)
    made = [(name, null(beta[i]), null(error[i]), moments.n, moments.units, rounds) for i, name in enumerate(regressors)]
    return spark.createDataFrame(made, "term string, coefficient double, stderr double, n long, n_units long, rounds int")


def event_study(panel: DataFrame, unit: str, period: str, value: str, treated_in: str, leads: int = 3, lags: int = 3) -> DataFrame:
    """two_way_fit() of a value on the periods since treatment, from leads before it to lags after it; the period before treatment is the base.

    Periods beyond either end count as the end. Units never treated (null) are controls throughout.
    """
    since = F.greatest(F.lit(-leads), F.least(F.lit(lags), F.col(period) - F.col(treated_in)))
    terms = {f"t{k:+d}": k for k in range(-leads, lags + 1) if k != -1}
    dummies = {name: F.coalesce((since == k).cast("double"), F.lit(0.0)) for name, k in terms.items()}
    return two_way_fit(panel.withColumns(dummies), unit, period, value, list(terms))
