import math
import random

import numpy as np
import pytest

from isohyet.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, block string"


def brute(rows, k=5, step=50, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is not None and i % step == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, c)), j is None, j or 0, j) for b, (j, c) in enumerate(ok) if j != i)
            out += [(i, r, j, -s) for r, (s, _, _, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def vectors(seed=3):
    rng = random.Random(seed)
    f = lambda x: struct_float(x)
    rows = [(i, [f(rng.gauss(0, 1) * (1 + i % 4) / 4) for _ in range(12)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(300)]  # a common vector, with queries among its copies
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (2200, []), (2250, [1.0, -1.0]), (2300, [0.0] * 12), (None, [f(0.3)] * 12), (50, rows[7][1])]
    return rows


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("block,slices,broadcast,sparse", [(32_768, 16_384, 50_000, 1 / 32), (64, 8, 0, 1.0), (64, 8, 0, 0.0)])
def test_by_brute_force(spark, monkeypatch, block, slices, broadcast, sparse):
    for name, value in (("SPARSE", sparse), ("BLOCK_ROWS", block), ("SLICE_ROWS", slices), ("BROADCAST_ROWS", broadcast), ("SEED_ROWS", 40), ("FIRST_TILES", (0, 8)), ("TILE_ROWS", 16)):
        monkeypatch.setattr(topk, name, value)
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in vectors()], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df).collect()), key=repr) == brute(vectors())


def test_large_components_and_few_rows(spark):
    rows = [(0, [1e6, -3e5]), (50, [2e6, 5.5]), (3, [-1e6, 1e6])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df).collect()), key=repr) == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_pruning_carries_the_result():
    """Unit vectors without any direction of their own, the worst case for the bounds: few pairs are left to confirm."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(6_000, 64))
    ints = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    norm = np.linalg.norm(ints, axis=1)
    order = np.argsort(-norm, kind="stable")
    rotation = np.linalg.eigh((ints.T @ ints).astype(float))[1][:, ::-1]
    block = topk.Rotated(order, ints[order], rotation)
    queries = topk.Rotated(np.arange(0, 6_000, 50), ints[::50], rotation)
    confirmed = []
    row, at, score = topk.best(queries, block, 5, np.full(120, np.iinfo(np.int64).min), confirmed)
    exact = ints[::50] @ ints.T
    exact[np.arange(120), np.arange(0, 6_000, 50)] = np.iinfo(np.int64).min
    assert all(sorted(score[row == i], reverse=True) == sorted(exact[i], reverse=True)[:5] for i in range(120))
    assert sum(confirmed) < 0.2 * exact.size


def test_components_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e30]), (50, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df).collect()
