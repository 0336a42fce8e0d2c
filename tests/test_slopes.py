import numpy as np
import pytest

from isohyet.operators import slopes


def pairs_of(t, y):
    i, j = np.triu_indices(len(t), 1)
    apart = t[i] != t[j]
    return np.sort((y[j] - y[i])[apart] / (t[j] - t[i])[apart])


@pytest.mark.parametrize("n", [1, 2, 3, 31, 64, 100])
def test_inversions(n):
    p = np.random.default_rng(n).permutation(n)
    want = [(i, j) for i in range(n) for j in range(i + 1, n) if p[i] > p[j]]
    assert slopes.inversions(p) == len(want) and sorted(zip(*(x.tolist() for x in slopes.inversions(p, listed=True)), strict=True)) == want


@pytest.mark.parametrize("kind", range(6))
def test_median_of_all_pairs(kind, monkeypatch):
    monkeypatch.setattr(slopes, "ALL_PAIRS", 2)
    monkeypatch.setattr(slopes, "LISTED", 50)
    rng = np.random.default_rng(kind)
    for n in (2, 3, 5, 17, 60, 150):
        t = np.arange(n) * 1.0 if kind < 3 else rng.integers(0, n, n) * 1.0
        y = [rng.normal(size=n), rng.integers(0, 4, n) * 1.0, np.full(n, 3.0), t * 0.3 + rng.integers(0, 2, n), 1e9 + rng.normal(size=n) * 1e-3, np.round(rng.normal(size=n), 1)][kind]
        s = pairs_of(t, y)
        slope, count = slopes.median_slope(t.copy(), y.copy())
        assert count == len(s) and (count == 0) == (slope is None)
        if count:
            assert slope == pytest.approx(np.median(s), rel=1e-12, abs=1e-12 * max(1.0, np.abs(y).max()))


def test_a_long_series():
    """10^5 hourly values: five thousand million pairs are counted, few are laid out."""
    rng = np.random.default_rng(6)
    t = np.arange(100_000) * 1.0
    slope, count = slopes.median_slope(t, 2e-5 * t + rng.normal(size=100_000))
    assert count == 100_000 * 99_999 // 2 and slope == pytest.approx(2e-5, rel=0.02)


def test_series_without_pairs(spark):
    from isohyet.operators import trend

    rows = [("one", 3, 1.0), ("twins", 3, 1.0), ("twins", 3, 2.0), (None, 1, 1.0), (None, 2, 3.0), ("gone", 4, None)]
    got = {r.station: (r.slope, r.n_pairs) for r in trend.theil_sen(spark.createDataFrame(rows, "station string, m int, v double"), "station", "m", "v").collect()}
    assert got == {"one": (None, 0), "twins": (None, 0), None: (240.0, 1)}
