from collections import Counter, defaultdict

import pytest

from isohyet.llm import sharding


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_sizes_slots_and_rows(docs, rows, monkeypatch, broadcast):
    monkeypatch.setattr(sharding, "BROADCAST_COUNTS", broadcast)
    got = sharding.shuffle_to_shards(docs.drop("shard"), 7).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(7)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert got and sorted(map(repr, got)) == sorted(map(repr, sharding.shuffle_to_shards(docs.drop("shard"), 7).collect()))


def test_edges(docs, empty):
    assert sharding.shuffle_to_shards(empty).count() == 0
    few = sharding.shuffle_to_shards(docs.limit(3), 40, pin=True).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert set(sharding.shuffle_to_shards(docs, 5).columns) == set(docs.columns) | {"slot"}


def test_matrix_sums_and_law():
    counts, sizes = [5, 0, 9, 40], [14, 14, 13, 13]
    total = [[0] * 4 for _ in counts]
    for seed in range(400):
        m = sharding.communication_matrix(counts, sizes, seed)
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == sizes
        total = [[a + b for a, b in zip(x, y)] for x, y in zip(total, m)]
    for p, c in enumerate(counts):
        for s, z in enumerate(sizes):
            assert total[p][s] / 400 == pytest.approx(c * z / 54, abs=0.35)


def test_uniform_slots(spark):
    """Over seeds, a row is as often in one place as in another."""
    from isohyet.session import shared_dir

    shared_dir(spark)
    df = spark.range(0, 8, 1, 2).checkpoint()
    seen = Counter()
    for seed in range(40):
        seen.update((r.id, r.shard) for r in sharding.shuffle_to_shards(df, 2, seed * 10).collect())
    assert all(8 <= seen[i, s] <= 32 for i in range(8) for s in range(2))


def test_hypergeometric_beyond_numpy():
    import numpy as np

    rng = np.random.default_rng(1)
    drawn = [sharding._hypergeometric(rng, 10**9, 3 * 10**9, 1_000) for _ in range(200)]
    assert 240 < sum(drawn) / 200 < 260


def test_mass_beyond_numpy_has_its_digits():
    import math

    for n in (10, 100, 10**6, 10**11):
        exact = float(sharding._log_factorial(n))
        assert exact == pytest.approx(math.lgamma(n + 1), rel=1e-12)
    # ln (n + 1)! - ln n! is ln (n + 1), to all digits, where floats have lost most of theirs
    n = 10**11
    assert float(sharding._log_factorial(n + 1) - sharding._log_factorial(n)) == pytest.approx(math.log(n + 1), rel=1e-14)


def test_matrix_in_groups(monkeypatch):
    """Groups of partitions are drawn first: sums hold, and means are those of the law, in NumPy's range and beyond."""
    monkeypatch.setattr(sharding, "EXACT_ROWS", 20)
    counts, sizes, total = [5, 17, 0, 9, 23], [14, 14, 13, 13], 0
    for seed in range(400):
        m = sharding.communication_matrix(counts, sizes, seed)
        assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes
        total = total + m
    assert abs(total / 400 - [[c * z / 54 for z in sizes] for c in counts]).max() < 0.35
    monkeypatch.setattr(sharding, "EXACT_ROWS", 500_000_000)
    big = sharding.communication_matrix([400_000_000] * 6, [600_000_000] * 4, 3)
    assert big.sum(1).tolist() == [400_000_000] * 6 and big.sum(0).tolist() == [600_000_000] * 4
    assert abs(big - 100_000_000).max() < 6 * (400_000_000 * 0.25 * 0.75) ** 0.5


def test_query_columns(spark):
    """The query's rows by brute force: size, checksum, law, sizes one apart, gapless slots."""
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = sharding.op4_hypergeometric_sharding(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {len(v) for v in by.values()} <= {len(docs) // 40, len(docs) // 40 + 1}


def test_no_python_on_executors_and_clashing_names(spark, docs):
    df = docs.withColumnRenamed("kept", "__scan").withColumnRenamed("word", "__range")
    placed = sharding.shuffle_to_shards(df, 5)
    assert "Python" not in placed._jdf.queryExecution().executedPlan().toString() and "PythonRDD" not in placed._jdf.rdd().toDebugString()
    assert set(placed.columns) == set(df.columns) | {"slot"} and placed.where("__scan = 'x' and __range = 'x'").count() == df.count()
