"""Bootstraps against NumPy on the same picks: the hashes choose, everything else is computed again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import analysis, inference, ranking, trend

DRAW = "cast(conv(substring(md5({}), 1, 8), 16, 10) AS bigint)"
ROWS = [(c, float((c * 7 + i * 3) % 11) + c / 10, float(i % 5), i) for c in range(12) for i in range(3 + c % 4)]


def frame(spark):
    return spark.createDataFrame(ROWS, "c int, y double, x double, i int")


def test_clustered_bootstrap(spark):
    got = trend.clustered_bootstrap(frame(spark), "c", "y", draws=50, seed=3).first()
    sums = np.array([[sum(r[1] for r in ROWS if r[0] == c), sum(r[0] == c for r in ROWS)] for c in range(12)])
    picks = spark.range(12).select(F.col("id").alias("i")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(49)))).selectExpr("i", "b", f"{DRAW.format("concat_ws('|', 3, b, i)")} % 12 AS pick").collect()
    means = []
    for b in range(50):
        own = sums[[r["pick"] for r in picks if r.b == b]]
        means.append(own[:, 0].sum() / own[:, 1].sum())
    assert (got["mean"], got.lower, got.upper) == pytest.approx((sums[:, 0].sum() / sums[:, 1].sum(), np.percentile(means, 2.5), np.percentile(means, 97.5)))


def test_block_bootstrap(spark):
    series = [("s", m, float(m * 13 % 17)) for m in range(100)] + [("t", m, float(m % 3)) for m in range(10, 50)]
    df = spark.createDataFrame(series, "s string, m long, v double")
    got = {r.s: r for r in analysis.block_bootstrap(df, "s", "m", "v", block=8, draws=40, seed=5).collect()}
    for name in "st":
        blocks = sorted({m // 8 for s, m, _ in series if s == name})
        sums = np.array([[sum(v for s, m, v in series if s == name and m // 8 == k), sum(s == name and m // 8 == k for s, m, _ in series)] for k in blocks])
        n = len(blocks)
        picks = spark.range(n).select(F.col("id").cast("int").alias("i")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(39)))).selectExpr("b", DRAW.format(f"concat_ws('|', 5, '{name}', b, i)") + f" % {n} AS pick").collect()
        means = [sums[[r["pick"] for r in picks if r.b == b]] for b in range(40)]
        means = [x[:, 0].sum() / x[:, 1].sum() for x in means]
        r = got[name]
        assert (r["mean"], r.lower, r.upper) == pytest.approx((sums[:, 0].sum() / sums[:, 1].sum(), np.percentile(means, 2.5), np.percentile(means, 97.5)))


def test_wild_cluster_bootstrap(spark):
    got = analysis.wild_cluster_bootstrap(frame(spark), "c", "x", "y", draws=99, seed=2).first()
    c, y, x = (np.array([r[k] for r in ROWS]) for k in (0, 1, 2))
    dx, dy = x - x.mean(), y - y.mean()
    slope = (dx * dy).sum() / (dx * dx).sum()
    signs = spark.range(12).selectExpr("cast(id AS int) AS c").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(98)))).selectExpr("c", "b", f"IF({DRAW.format("concat_ws('|', 2, b, c)")} % 2 = 0, 1, -1) AS sign").collect()
    drawn = []
    for b in range(99):
        sign = {r.c: r.sign for r in signs if r.b == b}
        star = y.mean() + np.array([sign[k] for k in c]) * dy  # the restricted residuals, turned by cluster
        drawn.append((dx * star).sum() / (dx * dx).sum())
    assert got.slope == pytest.approx(slope) and got.p_value == pytest.approx((sum(abs(t) >= abs(slope) * (1 - 1e-12) for t in drawn) + 1) / 100)


@pytest.mark.parametrize("by,one_task", [(None, 200_000), ("f", 200_000), (None, 10), ("f", 10)])
def test_ranks_without_one_sort(spark, monkeypatch, by, one_task):
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", one_task)
    df = spark.range(0, 1_000, 1, 7).selectExpr("id", "pmod(id * 37, 101) AS v", "IF(id % 5 = 0, NULL, id % 3) AS f")
    got = ranking.ranked(df, ["v", "id"], by).collect()
    groups = {}
    for r in sorted(got, key=lambda r: (r.v, r.id)):
        groups.setdefault(r.f if by else 0, []).append(r["rank"])
    assert all(v == list(range(1, len(v) + 1)) for v in groups.values())


def test_pairs_are_one_to_one(spark):
    a, b = spark.range(30).selectExpr("id AS s"), spark.range(100, 120).selectExpr("id AS s")
    rows = trend.make_pairs(a, b, seed=4).collect()
    assert len(rows) == 20 and len({r.a for r in rows}) == len({r.b for r in rows}) == 20 and sorted(r.pair for r in rows) == list(range(1, 21))
    m = trend.pair_mean(spark.createDataFrame([(1.0,), (2.0,), (None,), (6.0,)], "slope double")).first()
    assert (m.n_pairs, m.mean_slope) == (3, 3.0) and m.se == pytest.approx(np.std([1, 2, 6], ddof=1) / 3**0.5)


def test_null_family(spark):
    tests = spark.createDataFrame([(i, 0.001 * i, None if i % 2 else "a") for i in range(1, 41)], "k int, p double, f string")
    got = {r.k: r.significant for r in inference.benjamini_hochberg(tests, "k", "p", 0.05, "f").collect()}
    for f in (0, 1):
        own = [(0.001 * i, i) for i in range(1, 41) if i % 2 == f]
        top = max((n for n, (p, _) in enumerate(own, 1) if p <= n / len(own) * 0.05), default=0)
        assert all(got[i] == (n <= top) for n, (_, i) in enumerate(own, 1))


def test_picks_are_not_broadcast(spark):
    """Draws times clusters are dealt to tasks and shuffled; only single rows go to the driver."""
    series = [("s", m, float(m * 13 % 17)) for m in range(100)]
    blocks = analysis.block_bootstrap(spark.createDataFrame(series, "s string, m long, v double"), "s", "m", "v", block=8, draws=40)
    for df in (trend.clustered_bootstrap(frame(spark), "c", "y", draws=50), blocks):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "ShuffledHashJoin" in plan
    assert "Generate" not in trend.clustered_bootstrap(frame(spark), "c", "y", draws=50)._jdf.queryExecution().sparkPlan().toString()


def test_no_cluster_has_no_mean(spark):
    assert tuple(trend.clustered_bootstrap(frame(spark).where("c < 0"), "c", "y").first()) == (None, None, None)
