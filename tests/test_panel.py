import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import neutrality, panel, sketches


def panel_rows(seed=2, units=14, periods=9, gaps=True):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        first = None if u % 4 == 0 else 3 + u % 4
        for t in range(periods):
            if gaps and rng.random() < 0.25:
                continue
            effect = 0.0 if first is None or t < first else 1.5 + 0.2 * (t - first)
            rows.append((f"u{u}", t, first, float(u * 0.7 + np.sin(t) + effect + rng.normal() * 0.3), float(rng.normal() + u % 3)))
    return rows


def dummies_fit(rows, x):
    """Least squares with a dummy for every unit and period, errors summed by unit."""
    units, periods = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    design = np.array([[*xi, *[r[0] == u for u in units], *[r[1] == t for t in periods[1:]]] for r, xi in zip(rows, x, strict=True)], float)
    y = np.array([r[3] for r in rows])
    inverse = np.linalg.pinv(design.T @ design)
    beta = inverse @ design.T @ y
    e = y - design @ beta
    scores = np.array([design[[r[0] == u for r in rows]].T @ e[[r[0] == u for r in rows]] for u in units])
    variance = inverse @ scores.T @ scores @ inverse * len(units) / (len(units) - 1)
    k = len(x[0])
    return beta[:k], np.sqrt(np.diag(variance)[:k])


@pytest.mark.parametrize("gaps", [False, True])
def test_event_study_against_dummies(spark, gaps):
    rows = panel_rows(gaps=gaps)
    df = spark.createDataFrame([*rows, ("u1", None, 4, 1.0, 1.0), (None, 2, 4, 1.0, 1.0), ("u1", 2, 4, float("nan"), 1.0)], "u string, t int, first int, y double, z double")
    got = panel.event_study(df, "u", "t", "y", "first", leads=2, lags=3).collect()
    terms = [-2, 0, 1, 2, 3]
    x = [[float(r[2] is not None and max(-2, min(3, r[1] - r[2])) == k) for k in terms] for r in rows]
    beta, error = dummies_fit(rows, x)
    assert [r.term for r in got] == [f"t{k:+d}" for k in terms] and {(r.n, r.n_units) for r in got} == {(len(rows), 14)}
    assert [r.coefficient for r in got] == pytest.approx(list(beta), abs=1e-8) and [r.stderr for r in got] == pytest.approx(list(error), abs=1e-8)
    assert got[0].rounds == 2 if not gaps else got[0].rounds > 2


def test_regressors_that_effects_explain(spark):
    rows = panel_rows(5)
    df = spark.createDataFrame(rows, "u string, t int, first int, y double, z double").withColumns({"of_unit": F.length("u").cast("double"), "of_time": F.col("t") * 2.0, "twice": F.col("z") * 2})
    got = {r.term: r for r in panel.two_way_fit(df, "u", "t", "y", ["of_unit", "z", "of_time", "twice"]).collect()}
    beta, error = dummies_fit(rows, [[r[4]] for r in rows])
    assert got["z"].coefficient == pytest.approx(beta[0], abs=1e-8) and got["z"].stderr == pytest.approx(error[0], abs=1e-8)
    assert all(got[t].coefficient is None and got[t].stderr is None for t in ("of_unit", "of_time", "twice"))
    empty = panel.two_way_fit(df.limit(0), "u", "t", "y", ["z"]).collect()
    assert [tuple(r)[:5] for r in empty] == [("z", None, None, 0, 0)]


def test_gaps_of_distributions(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(v), bool(o) if o < 2 else None) for g in "ab" for v, o in zip(rng.integers(0, 12, 300), rng.integers(0, 3, 300), strict=True)]
    rows += [("only", 1.0, False), ("only", 2.0, None), ("none", None, True), ("a", float("inf"), True), (None, 1.0, True), (None, 5.0, False)]
    got = {r.g: r for r in neutrality.exclusion_gaps(spark.createDataFrame(rows, "g string, v double, o boolean"), ["g"], ["v"], "o").collect()}
    assert set(got) == {"a", "b", "only", None}
    for g in "ab":
        kept, out = (np.array([v for h, v, o in rows if h == g and bool(o) == side and np.isfinite(v)]) for side in (False, True))
        at = np.arange(12)
        gaps = np.abs([(kept <= x).mean() - (out <= x).mean() for x in at])
        r = got[g]
        assert (r.n_kept, r.n_excluded) == (len(kept), len(out)) and r.gap == pytest.approx(gaps.max()) and r.gap_at == at[np.argmax(gaps.round(12))]
        assert r.mean_difference == pytest.approx((out.mean() - kept.mean()) / np.sqrt((out.var(ddof=1) + kept.var(ddof=1)) / 2)) and r.spread_ratio == pytest.approx(out.std(ddof=1) / kept.std(ddof=1))
        assert r.neutral == (r.gap < r.critical) and r.critical == pytest.approx(1.3581 * np.sqrt((len(kept) + len(out)) / len(kept) / len(out)))
    assert (got["only"].n_excluded, got["only"].gap, got["only"].neutral) == (0, None, None) and (got[None].gap, got[None].spread_ratio) == (1.0, None)


def test_sketches_over_runs(spark, tmp_path):
    """A table of sketches by county; a second run's table is united with it."""
    first, second = spark.range(0, 30_000), spark.range(20_000, 50_000)
    county = lambda df: df.withColumn("county", F.col("id") % 3).union(df.limit(5).selectExpr("CAST(NULL AS long) AS id", "0 AS county"))
    for name, df in (("one", first), ("two", second)):
        sketches.sketched(county(df), ["county"], F.col("id")).write.parquet(str(tmp_path / name))
    kept = spark.read.parquet(str(tmp_path / "one")).unionByName(spark.read.parquet(str(tmp_path / "two")))
    whole = sketches.estimated(sketches.united(kept, [])).first().n_distinct
    assert abs(whole - 50_000) <= 4 * sketches.standard_error() * 50_000
    assert all(abs(r.n_distinct - 50_000 / 3) <= 4 * sketches.standard_error() * 50_000 / 3 for r in sketches.estimated(sketches.united(kept, ["county"])).collect())
