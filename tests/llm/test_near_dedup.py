import itertools
import random

import numpy as np
import pytest

from isohyet.llm import near_dedup


def sets_of(rows, width):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset([tuple(w)] if 0 < len(w) < width else zip(*[w[k:] for k in range(width)]))
    return out


def brute(rows, width, percent):
    sets = sets_of(rows, width)
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i, *_ in rows)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_by_brute_force(docs, rows, width, percent):
    got = sorted(map(tuple, near_dedup.near_duplicates(docs, width=width, percent=percent).collect()))
    assert got == brute(rows, width, percent)


def variants(n=150, seed=2):
    """Edits of a text that is not there itself: chains of links, many pairs under the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(0, 9)):
            words[at] = f"e{rng.randint(0, 3)}"
        rows.append((i * 7 % 1009, " ".join(words)))
    return rows


def test_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 16)
    monkeypatch.setattr(near_dedup, "PRODUCT", 64)
    monkeypatch.setattr(near_dedup, "ONE_TASK_LINKS", 0)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(df, width=3, percent=85).collect())) == brute(rows, 3, 85)


def test_keeps_one_of_each_group(docs, rows, empty):
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted(r[0] for r in brute(rows, 5, 80) if r[3])
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(docs.where("text is null")).count() == 1


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        extra = rng.integers(0, 2**63, n // 3).astype(np.uint64)
        a, b = np.unique(common), np.unique(np.concatenate([common, extra]))
        s = near_dedup.sketches([a, b], 280)
        assert (s != near_dedup._FULL).all()
        assert abs((s[0] == s[1]).mean() - len(a) / len(b)) < 0.12


def test_banding_bounds_misses():
    for percent in (50, 80, 85, 95):
        bands, rows = near_dedup.banding(percent)
        assert bands * rows <= near_dedup.COORDINATES and (1 - (percent / 100) ** rows) ** bands < near_dedup.MISS
    assert near_dedup.banding(85) == (40, 7)


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, one_task):
    from isohyet.session import shared_dir

    shared_dir(spark)
    monkeypatch.setattr(near_dedup, "ONE_TASK_LINKS", one_task)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (139, 150)]
    nodes = sorted({x for p in links for x in p})
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: 0 if n <= 40 else 100 if n < 200 else 200 for n in nodes}
