import math
import random

import numpy as np
import pytest

from isohyet.llm import hard_negatives as hn
from tests.llm.test_topk import struct_float

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row string, bundle string, cluster string"


def brute(rows, step=50, positives=5, negatives=3, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in rows if g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, q, g in ok:
        if i is None or i % step:
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), j, h) for j, v, h in ok]
        for p, pid, _ in sorted((s for s in scored if s[2] == g and s[1] != i), key=order)[:positives]:
            fits = sorted((s for s in scored if s[2] != g and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:negatives]
            out += [(i, pid, r, j, p, s) for r, (s, j, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def vectors(seed=5):
    rng = random.Random(seed)
    f = struct_float
    centres = [[rng.gauss(0, 0.4) for _ in range(12)] for _ in range(9)]
    rows = [(i, [f(x + rng.gauss(0, 0.25)) for x in centres[i % 9]], i % 4) for i in range(500)]
    rows += [(1_000 + i, rows[50][1], 2 if i % 3 else 1) for i in range(400)]  # copies of a vector under two labels, anchors among them
    rows += [(100, rows[100][1], 0)] * 12 + [(None, rows[7][1], 3)] * 9  # repeated rows, with and without an id
    rows += [(5_000, None, 1), (5_050, [1.0, None], 1), (5_100, [float("nan")] * 12, 1), (5_150, [float("-inf")] * 12, 2), (5_200, rows[3][1], None), (5_250, [], 1), (5_300, [1.0, -1.0], 2), (5_350, [0.0] * 12, 3)]
    return rows


def mined(spark, rows, **how):
    df = spark.createDataFrame([(i, v, g, *"abcd") for i, v, g in rows], SCHEMA)
    return sorted(map(tuple, hn.mine(df, **how).collect()), key=repr)


@pytest.mark.parametrize("probes,bundle,slices,broadcast,tile", [(8, (1_024, 131_072), 65_536, 50_000, 4_096), (1, (40, 40), 3, 0, 7), (3, (64, 64), 65_536, 50_000, 16)])
def test_by_brute_force(spark, monkeypatch, probes, bundle, slices, broadcast, tile):
    for name, value in (("PROBES", probes), ("BUNDLE_ROWS", bundle), ("SLICE_ROWS", slices), ("BROADCAST_ROWS", broadcast)):
        monkeypatch.setattr(hn, name, value)
    want = brute(vectors())
    assert len(want) > 50 and mined(spark, vectors()) == want


def test_other_numbers_and_large_components(spark):
    rows = [(i, [struct_float(x * 3e4) for x in v], g) for i, v, g in vectors(9) if i is not None and i < 200 and v and all(x is not None and math.isfinite(x) for x in v)]
    assert mined(spark, rows, step=20, positives=2, negatives=4) == brute(rows, 20, 2, 4)


def test_few_rows_and_empty(spark):
    assert mined(spark, [(50, [1.0, 0.0], 1)]) == []
    assert mined(spark, []) == []
    assert mined(spark, [(50, [], 1), (51, [], 1), (52, [], 2)]) == brute([(50, [], 1), (51, [], 1), (52, [], 2)]) == [(50, 51, 1, 52, 0, 0)]


def test_scores_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(50, [2e7, 1e9], 1), (51, [2e7, 1e9], 1)])


def test_bounds_hold_and_prune():
    """No score lies outside its list's bounds, and clustered vectors leave most lists unvisited."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32)) * 100
    of = rng.integers(0, 40, 4_000)
    x = np.floor(centres[of] + rng.normal(size=(4_000, 32)) * 15)
    radius = np.array([np.sqrt(((x[of == i] - centres[i]) ** 2).sum(1)).max() for i in range(40)])
    least, greatest = hn.bounds(x[:80], np.arange(40), radius, centres)
    scores = x[:80] @ x.T
    assert all((scores[:, of == i] <= greatest[:, [i]]).all() and (scores[:, of == i] >= least[:, [i]]).all() for i in range(40))
    fifth = np.sort(scores, axis=1)[:, -5].astype(np.int64)[:, None]
    assert hn.reaches(least, greatest, fifth, np.full((80, 1), 2**62)).mean() < 0.1
    high = fifth * 95 // 100
    window = hn.reaches(least, greatest, -(-fifth // 2), high)
    inside = (scores >= -(-fifth // 2)) & (scores <= high)
    assert all(window[a, of[c]] for a, c in zip(*np.nonzero(inside)))


def test_recall_is_whole_whatever_the_sample(spark, monkeypatch):
    monkeypatch.setattr(hn, "SAMPLE_ROWS", 20)
    assert mined(spark, vectors(3)) == brute(vectors(3))
