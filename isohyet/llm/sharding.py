"""Operator 4, sharding: a hypergeometric communication matrix gives a uniform shuffle with exact shard sizes.

The driver draws, for every input partition, how many of its rows go to every shard, from the multivariate
hypergeometric law, so that rows and columns of the matrix sum exactly. Draws are in two steps: for groups of partitions of some
hundred million rows, then within each group, where NumPy's own sampler is exact. Every partition permutes its rows locally (a
seeded sort, no exchange) and deals them out by its row of the matrix; one exchange moves the rows; within a shard, the
seeded order is cut into sub-ranges that are numbered on their own, so that no task holds a shard. No Python runs on
executors. The matrix has 4 bytes for every pair of an input partition and a shard, and nothing for documents: 800,000
partitions by 40 shards take 128 MB, which is broadcast; beyond BROADCAST_COUNTS it is joined by a shuffle.

The local order numbers rows by partition, so docs must keep its partitioning when it is read again, as a file scan or a
checkpoint does; pass pin=True for other inputs, which checkpoints them first. Rows beyond the counts, or shards that
don't get their size, fail the job rather than upset the sizes.

Defined cases: null text has no bytes and the checksum of nothing; a text of any length travels whole; repeated rows are rows like others; an empty table
gives an empty result; with fewer rows than shards, some shards stay empty; equal draws of the seeded order go by the row's number in its scan; columns of docs pass through, those
named like the operator's own (shard, slot) give way.
"""

from __future__ import annotations

import math
import random
from decimal import Decimal, localcontext
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.llm.text import free_prefix
from isohyet.session import shared_dir

SHARDS = 40
SEED = 20_251
#: Rows that one sub-range of a shard aims at.
ROWS_A_RANGE = 4_096
#: A matrix of up to this many counts (128 MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_COUNTS = 32_000_000
#: A shard has at least so many sub-ranges, so that exchanges stay even.
LEAST_RANGES = 32
#: Rows that NumPy's sampler is exact for, and that a group of partitions holds at most (but for one partition's own).
EXACT_ROWS = 500_000_000


@lru_cache(maxsize=4_096)
def _log_factorial(n: int) -> Decimal:
    """ln n! to some forty digits, by Stirling's series."""
    with localcontext() as c:
        c.prec = 60
        if n < 64:
            return Decimal(math.factorial(n)).ln()
        z, pi = Decimal(n + 1), Decimal("3.14159265358979323846264338327950288419716939937510582097494")
        # Bernoulli numbers B2 to B20
        bernoulli = ((1, 6), (-1, 30), (1, 42), (-1, 30), (5, 66), (-691, 2730), (7, 6), (-3617, 510), (43867, 798), (-174611, 330))
        series = sum(Decimal(p) / q / (2 * k * (2 * k - 1)) / z ** (2 * k - 1) for k, (p, q) in enumerate(bernoulli, 1))
        return (z - Decimal("0.5")) * z.ln() - z + (2 * pi).ln() / 2 + series


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Of draws from good + bad items without replacement, how many are good."""
    if draws == 0 or good == 0:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    # Beyond NumPy's range: invert the distribution outwards from its mode, whose mass has all its digits.
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    with localcontext() as c:
        c.prec = 60
        choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        mass = float((choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws)).exp())
    u = random.Random(int(rng.integers(2**62))).random() - mass
    up, down, a, b = mass, mass, mode, mode
    while u > 0 and (a < high or b > low):
        if a < high:
            up *= (good - a) * (draws - a) / ((a + 1) * (bad - draws + a + 1))
            a, u = a + 1, u - up
            if u <= 0:
                return a
        if b > low:
            down *= b * (bad - draws + b) / ((good - b + 1) * (draws - b + 1))
            b, u = b - 1, u - down
            if u <= 0:
                return b
    return mode


def _drawn(rng: np.random.Generator, count: int, left: np.ndarray) -> np.ndarray:
    """How many of count rows go to each shard that has left places."""
    if left.sum() < 10**9:
        return rng.multivariate_hypergeometric(left, count, method="marginals")
    row, pool = np.zeros(len(left), np.int64), int(left.sum())
    for s, room in enumerate(left.tolist()):
        pool -= room
        row[s] = _hypergeometric(rng, room, pool, count) if s + 1 < len(left) else count
        count -= int(row[s])
    return row


def communication_matrix(counts: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """matrix[p, s]: rows of partition p that go to shard s; row sums are counts, column sums are shard_sizes."""
    rng = np.random.default_rng(seed)
    left = np.array(shard_sizes, np.int64)
    rows = np.array(counts, np.int64)
    matrix = np.zeros((len(rows), len(left)), np.int32)
    # consecutive partitions share a group until it has EXACT_ROWS
    group = (np.cumsum(rows) - rows) // EXACT_ROWS
    for first, last in zip(*(np.searchsorted(group, np.unique(group), side) for side in ("left", "right")), strict=True):
        mine = _drawn(rng, int(rows[first:last].sum()), left)
        left -= mine
        for p in range(first, last):
            matrix[p] = row = _drawn(rng, int(rows[p]), mine)
            mine = mine - row
    return matrix


def _dealt(rows: DataFrame, plan: DataFrame, ranges: int, seed: int, own: str) -> DataFrame:
    """Adds shard, range and order (named after own): the local permutation, dealt out by the matrix."""
    scan, mix, at, part, k = (f"{own}{n}" for n in ("scan", "mix", "at", "part", "k"))
    local = (
        rows.withColumn(scan, F.monotonically_increasing_id())
        .withColumn(mix, F.xxhash64(F.lit(seed), scan))
        .sortWithinPartitions(mix)
        .withColumn(at, F.monotonically_increasing_id())
        .withColumn(part, F.shiftright(at, 33).cast("int"))
        .withColumn(k, F.col(at).bitwiseAND((1 << 33) - 1))
    )
    # ends: running sums of the partition's row of the matrix
    ends = f"{own}ends"
    shard = F.size(F.filter(ends, lambda e: e <= F.col(k)))
    order = F.xxhash64(F.lit(seed + 1), scan)
    dealt = local.join(plan.select(F.col("part").alias(part), F.col("ends").alias(ends)), part)
    return (
        dealt.withColumn("shard", F.when(F.col(k) < F.element_at(ends, -1), shard).otherwise(F.raise_error(F.lit("the input's partitions changed between two reads; pass pin=True"))).cast("int"))
        .withColumn(f"{own}order", order)
        .withColumn(f"{own}range", F.floor((F.shiftright(f"{own}order", 32) + F.lit(2**31)) * F.lit(ranges) / F.lit(2**32)).cast("int"))
        .drop(ends, at, k, mix, part)
    )


def shuffle_to_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, pin: bool = False) -> DataFrame:
    """docs in uniformly random order: shard (0 to shards - 1, sizes at most one apart) and slot (gapless from 0) are added."""
    spark = docs.sparkSession
    shared_dir(spark)
    docs = docs.drop("shard", "slot")
    if pin:
        docs = docs.checkpoint()
    own = free_prefix(docs.columns)
    counts = docs.groupBy(F.spark_partition_id().alias("part")).count().toArrow().sort_by("part")
    total = sum(counts.column("count").to_pylist())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(counts.column("count").to_pylist(), sizes, seed)
    # an Arrow table: it goes to the JVM as it is, and no Python runs where it is used
    ends = pa.FixedSizeListArray.from_arrays(pa.array(np.cumsum(matrix, 1, dtype=np.int32).ravel()), shards).cast(pa.list_(pa.int32()))
    plan = spark.createDataFrame(pa.table({"part": counts.column("part").combine_chunks(), "ends": ends}))
    if matrix.size <= BROADCAST_COUNTS:
        plan = F.broadcast(plan)
    ranges = max(LEAST_RANGES, math.ceil(total / shards / ROWS_A_RANGE))
    range_ = f"{own}range"
    narrow = _dealt(docs.select(F.lit(0).alias("none")), plan, ranges, seed, own).groupBy("shard", range_).count().checkpoint()
    got = {r[0]: r[1] for r in narrow.groupBy("shard").agg(F.sum("count")).collect()}
    if any(got.get(s, 0) != n for s, n in enumerate(sizes)):
        raise RuntimeError("the input's partitions changed between two reads; pass pin=True")
    before = Window.partitionBy("shard").orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = narrow.select("shard", range_, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(f"{own}offset"))
    order = Window.partitionBy("shard", range_).orderBy(f"{own}order", f"{own}scan")
    placed = _dealt(docs, plan, ranges, seed, own).withColumn(f"{own}n", F.row_number().over(order) - 1)
    return (
        placed.join(offsets, ["shard", range_])
        .withColumn("slot", F.col(f"{own}offset") + F.col(f"{own}n"))
        .select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "slot")
    )


def text_bytes(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def op4_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffle_to_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return placed.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(text_bytes(F.col("text"))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
