import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from isohyet.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_targets_and_takes(docs, rows, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want, got, taken = brute_targets(sizes), mixing.mix(docs, block=4).collect(), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size(r.text) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 8
    again = mixing.mix(docs, block=4).collect()
    key = lambda r: repr(r)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_apportionment_is_sainte_lague(spark):
    votes = [530, 240, 130, 60, 25, 15, 0]
    for seats in (0, 1, 7, 23, 100):
        df = spark.createDataFrame([(i, float(v), seats, 1) for i, v in enumerate(votes)], "i int, v double, seats long, one int")
        got = {r.i: r.won for r in mixing.apportion(df, "v", "seats", ["one"], ["i"], "won").collect()}
        want = dict.fromkeys(range(len(votes)), 0)
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert got == want


def test_copies_and_empty(docs, empty):
    again = mixing.repeat_documents(mixing.mix(docs))
    assert set(again.columns) == set(docs.columns) - {"size"}
    assert mixing.mix(empty).count() == 0
    nothing = mixing.mix(docs.where("doc_id in (300, 301, 302)")).collect()
    assert len(nothing) == 3 and all(r.taken == 0 and r.target == 0 for r in nothing)


def test_blocks_by_number(spark):
    """In every shard, whole passes and one run of numbered blocks: seen from the rows, with shards recomputed by hand."""
    n, block = 3_000, 8
    df = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 30 = 1 THEN 'b' ELSE 'c' END AS source", "repeat(concat('w', id, ' '), 1 + cast(id % 37 AS int)) AS text")
    df = df.withColumn("__mix", F.lit("mine")).withColumn("q_source", F.lit("mine"))
    mixed = mixing.mix(df, block=block)
    assert mixed.where("__mix = 'mine' and q_source = 'mine'").count() == n
    rows = mixed.withColumn("mix", F.xxhash64(F.lit(mixing.SEED), "doc_id", F.xxhash64("text"))).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for name, own in by.items():
        want = brute_targets({s: sum(r["size"] for r in x) for s, x in by.items()})[name]
        shards = 1
        while shards < len(own) / mixing.SHARD_ROWS[0]:
            shards *= 2
        assert abs(sum(r.taken for r in own) - want) <= block * (shards + 1) / 2
        for s in range(shards):
            here = sorted((r for r in own if r.mix % shards == s), key=lambda r: (r.mix, r.doc_id))
            passes = min(r.taken // r["size"] for r in here)
            extra = [(r.taken - passes * r["size"], r["size"]) for r in here]
            total, whole = sum(x for x, _ in extra), sum(size for _, size in extra)
            short = -whole % block
            assert total == whole or total % block == 0 or (total + short) % block == 0
            # one run around the circle of documents: begun after one that isn't taken, all but its ends are whole
            idle = next((i for i, (x, _) in enumerate(extra) if not x), None)
            if idle is not None:
                around = extra[idle:] + extra[:idle]
                runs = [i for i, (x, _) in enumerate(around) if x]
                assert not runs or all(x == size for x, size in around[runs[0] + 1 : runs[-1]])


def test_many_rows_make_more_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FINE", 4)
    monkeypatch.setattr(mixing, "SHARD_ROWS", (8, 16))
    df = spark.range(2_000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'x', 'y') AS source", "repeat('w ', 1 + cast(id % 50 AS int)) AS text")
    taken = {r.source: (r.t, r.want) for r in mixing.mix(df, block=2).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want")).collect()}
    assert all(abs(t - want) <= 0.01 * want for t, want in taken.values())


def test_every_block_is_as_likely(spark):
    """400 seeds: each block's share within three standard errors of the quota's; the last block is a short one."""
    held, some, block, words = 10, 4, 8, 75
    seeds = spark.range(400).select(F.lit(held).alias("held"), F.lit(some).alias("some"), "id")
    runs = seeds.select(F.struct(*mixing.run_of_blocks(F.col("held"), F.col("some"), block, F.col("id"))).alias("r"))
    blocks = runs.select("r.*", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("start"))
    taken = blocks.withColumn("n", mixing.words_in_run(F.col("start"), F.lit(1), F.col("low"), F.col("high"), F.col("wrapped")))
    shares = taken.groupBy(F.floor(F.col("start") / block).alias("block")).agg(F.avg("n").alias("share"), F.max("n").alias("most")).collect()
    assert len(shares) == held and all(r.most == 1 and abs(r.share - some / held) <= 3 * (0.4 * 0.6 / 400) ** 0.5 for r in shares)
    whole = seeds.select(F.struct(*mixing.run_of_blocks(F.col("held"), F.col("held"), block, F.col("id"))).alias("r")).select("r.*").distinct().collect()
    assert [tuple(r) for r in whole] == [(0, held * block, 0)]
