"""Operator 3, exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are quantised to integers and range-sorted by descending norm into blocks. A rotation from the eigenvectors of
the Gram matrix (summed over all vectors) packs most of every product into the first coordinates. Partial sums grow in
STEPS; after each, the product of the norms of what is left of both vectors bounds what the rest can add (Cauchy-Schwarz), and
pairs that can't reach their query's threshold go. While many are left in a tile, a step is one matrix product; of few, their own
coordinates. Only pairs that outlive the last step are confirmed, with exact integers. The vectors of greatest norm give every
query a first threshold, and a block skips the queries that its greatest norm can't lift over theirs.

Queries meet candidates in blocks: (candidate block, query slice), the queries travelling to each block of candidates. Each
pair returns its k best a query, and a window keeps the k best of all. Blocks are bounded, so that no task
holds more than a block and a slice; norms only order the work, so that equal vectors of any number spread over blocks.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; a shorter vector counts as
followed by zeros, an empty one scores 0; rows with an equal id are rows of their own, and all of them are excluded for
their own query; equal scores rank by smaller id; a null id can't be a query, and ranks last; an empty table gives an
empty result; extra columns are ignored. Components beyond 2**20 in size use Python integers, so that nothing rounds or overflows
on the way; a component or a score outside 64 bits is an error. Vectors of any width are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.session import shared_dir, ship_package

SCALE = 256
QUERY_STEP = 50
TOP = 5
#: Where partial sums pause, as parts of the width, and the part of a tile's pairs below which they go on pair by pair.
STEPS, SPARSE = (1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16), 1 / 32
#: Rows of a candidate block, and of a query slice: at a width of 64, some 16 and 32 MB as floats.
BLOCK_ROWS, SLICE_ROWS = 32_768, 65_536
#: Vectors of greatest norm that give the first thresholds.
SEED_ROWS = 2_048
#: Tables of blocks or slices of up to this many rows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 50_000
#: Products of this many candidates by this many queries at once.
TILE_ROWS, TILE_QUERIES = 4_096, 256
FIRST_TILES = (0, 32, 256, 1_024)
#: Pairs that are confirmed at once: some 30 MB of factors.
CONFIRM_PAIRS = 16_384


def quantise(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE, also: tuple[Column, ...] = ()) -> DataFrame:
    """(id, v, those of also, norm2) of the vectors that take part: v array<bigint>, floor(scale * component)."""
    finite = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() would saturate silently
    fits = F.forall(F.col(column), lambda x: F.abs(x.cast("double") * scale) < 2.0**63)
    held = F.when(fits, F.col(column)).otherwise(F.raise_error(F.lit("a scaled component exceeds 64 bits")))
    return (
        vectors.where(F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(F.col(key).cast("long").alias("id"), F.transform(held, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), *also)
        .withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    )


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Integer rows, padded with zeros to width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width), dtype=np.int64)
    if len(column) == 0 or width == 0:
        return out
    offsets = np.asarray(column.offsets)
    lengths = np.diff(offsets)
    flat = np.asarray(column.values)[offsets[0] : offsets[-1]]
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    out[np.repeat(np.arange(len(column)), lengths), at] = flat
    return out


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column("v"), width).astype(float)
            total += m.T @ m
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "x"])

    return run


def steps(width: int) -> list[tuple[int, int]]:
    """The spans of coordinates that the partial sums take in turn; the rest is left to the bound."""
    cuts = sorted({round(width * part) for part in STEPS} - {0, width})
    return list(pairwise([0, *cuts]))


class Rotated:
    """Vectors after rotation, with the norms of what each step leaves, and their exact integers."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, rotation: np.ndarray):
        self.ids, self.ints, floats = ids, ints, ints.astype(float)
        self.norm = np.sqrt((floats**2).sum(1))
        self.turned = floats @ rotation
        # norms of the rest after each step, a little more than they are, as the rotation rounds
        self.rest = [np.sqrt((self.turned[:, end:] ** 2).sum(1) + 1e-9 * self.norm**2) for _, end in steps(ints.shape[1])]

    def products(self, other: Rotated, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Exact inner products of rows mine of self with rows theirs of other, pair by pair."""
        out = np.zeros(len(mine), dtype=np.int64)
        for at in range(0, len(mine), CONFIRM_PAIRS):
            a, b = self.ints[mine[at : at + CONFIRM_PAIRS]], other.ints[theirs[at : at + CONFIRM_PAIRS]]
            big = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
            if big <= 2**20:  # sums of up to 2**13 products fit 53 bits
                out[at : at + CONFIRM_PAIRS] = np.einsum("ij,ij->i", a.astype(float), b.astype(float))
            else:
                out[at : at + CONFIRM_PAIRS] = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)]
        return out


def outlive(queries: Rotated, rows: np.ndarray, block: Rotated, tile: slice, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into rows, block row) of the pairs whose bound reaches low after every step of the partial sums."""
    mine, theirs = rows, np.arange(tile.start, tile.stop)
    at, sums, pairs = np.arange(len(rows)), None, None
    for nth, (start, end) in enumerate(steps(block.ints.shape[1])):
        if pairs is None:
            part = queries.turned[mine, start:end] @ block.turned[theirs, start:end].T
            sums = part if sums is None else sums + part
            stays = sums + queries.rest[nth][mine][:, None] * block.rest[nth][theirs] >= low[at][:, None]
            left = np.count_nonzero(stays)
            if left <= SPARSE * len(rows) * (tile.stop - tile.start):
                q, c = np.nonzero(stays)
                pairs, sums = (at[q], theirs[c]), sums[q, c]
            else:  # whole rows and columns that are out go
                q, c = stays.any(1), stays.any(0)
                if np.count_nonzero(q) * np.count_nonzero(c) < 0.75 * stays.size:
                    at, mine, theirs, sums, stays = at[q], mine[q], theirs[c], sums[np.ix_(q, c)], stays[np.ix_(q, c)]
        else:
            q, c = pairs
            sums = sums + np.einsum("ij,ij->i", queries.turned[rows[q], start:end], block.turned[c, start:end])
            stays = sums + queries.rest[nth][rows[q]] * block.rest[nth][c] >= low[q]
            pairs, sums = (q[stays], c[stays]), sums[stays]
    if pairs is not None:
        return pairs
    q, c = np.nonzero(stays) if sums is not None else np.indices((len(rows), tile.stop - tile.start)).reshape(2, -1)
    return at[q], theirs[c]


def best(queries: Rotated, block: Rotated, k: int, threshold: np.ndarray, confirmed: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, block row, score): the k best of block for every query, of those that reach the query's threshold.

    block is in order of descending norm. Scores at the threshold stay, so that ties are settled by id later.
    confirmed, if given, takes the number of exact products of every tile.
    """
    found = ([], [], [])
    limit = threshold.astype(float)
    for q0 in range(0, len(queries.ids), TILE_QUERIES):
        rows = np.arange(q0, min(q0 + TILE_QUERIES, len(queries.ids)))
        low = limit[rows].copy()
        own: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # the first tiles are small: they give the thresholds that thin out the others
        for c0, c1 in pairwise([*(x for x in FIRST_TILES if x < len(block.ids)), *range(FIRST_TILES[-1] + TILE_ROWS, len(block.ids), TILE_ROWS), len(block.ids)]):
            slack = 1e-9 * queries.norm[rows] * block.norm[c0] + 1e-6
            live = np.flatnonzero(queries.norm[rows] * block.norm[c0] + slack >= low)
            if not len(live):
                break  # nor can any later one, whose norms are smaller
            q, c = outlive(queries, rows[live], block, slice(c0, c1), (low - slack)[live])
            q = live[q]
            if confirmed is not None:
                confirmed.append(len(q))
            score = queries.products(block, rows[q], c)
            stays = score >= low[q]
            stays &= queries.ids[rows[q]] != block.ids[c]
            own.append((q[stays], c[stays], score[stays]))
            q, c, score = (np.concatenate(x) for x in zip(*own, strict=True))
            # ties go to the smaller id
            order = np.lexsort((block.ids[c], -score, q))
            q, c, score = q[order], c[order], score[order]
            starts = np.searchsorted(q, q, "left")
            keep = np.arange(len(q)) - starts < k
            q, c, score = q[keep], c[keep], score[keep]
            own = [(q, c, score)]
            n = np.bincount(q, minlength=len(rows))
            full = n >= k
            last = np.searchsorted(q, np.flatnonzero(full), "right") - 1
            low[full] = np.maximum(low[full], score[last])
        if own:
            q, c, score = own[0]
            for to, x in zip(found, (rows[q], c, score), strict=True):
                to.append(x)
    if not found[0]:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in found)


#: Stands for a null id in arrays: after every other id.
_NULL_ID = np.iinfo(np.int64).max


def _rotated(table: pa.Table, width: int, rotation: np.ndarray) -> Rotated:
    ids = np.asarray(table.column("id").combine_chunks().fill_null(_NULL_ID))
    norm = np.asarray(table.column("norm2").combine_chunks())
    order = np.lexsort((ids, -norm))
    return Rotated(ids[order], _matrix(table.column("v"), width)[order], rotation)


RESULT = "row long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", step: int = QUERY_STEP, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all vectors for those whose id is divisible by step."""
    spark = vectors.sparkSession
    ship_package(spark)
    shared_dir(spark)
    ready = quantise(vectors, key, column, scale)
    width = ready.agg(F.max(F.size("v"))).first()[0] or 0
    if width == 0:
        rotation = np.zeros((0, 0))
    else:
        gram = np.zeros((width, width))
        for i, j, x in ready.select("v").mapInArrow(_gram(width), "i long, j long, x double").groupBy("i", "j").agg(F.sum("x")).collect():
            gram[i, j] = x
        rotation = np.linalg.eigh(gram)[1][:, ::-1].copy()
    by_norm = ready.repartitionByRange(F.col("norm2").desc(), F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("norm2").desc(), F.col("id").asc_nulls_last()).checkpoint()
    n = by_norm.count()
    # Blocks of consecutive norms: the place within the sorted partition, cut every BLOCK_ROWS.
    at = F.monotonically_increasing_id()
    blocks = by_norm.withColumn("__at", at).select(
        "id", "v", "norm2", F.shiftright("__at", 33).cast("int").alias("part"), (F.col("__at").bitwiseAND((1 << 33) - 1) / BLOCK_ROWS).cast("int").alias("nth")
    )
    heads = by_norm.orderBy(F.col("norm2").desc(), F.col("id").asc_nulls_last()).limit(SEED_ROWS).collect()
    seeds = pa.table({"id": pa.array([r.id for r in heads], pa.int64()), "v": pa.array([r.v for r in heads], pa.list_(pa.int64())), "norm2": pa.array([r.norm2 for r in heads], pa.float64())})
    slices = max(1, -(-(n // step) // SLICE_ROWS))
    # some megabyte, sent once an executor
    longest = spark.sparkContext.broadcast((seeds, rotation))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, rotation = longest.value
        head = _rotated(seeds, width, rotation)
        for b in batches:
            ids = np.asarray(b.column("id"))
            q = Rotated(ids, _matrix(b.column("v"), width), rotation)
            row, _, score = best(q, head, k, np.full(len(ids), np.iinfo(np.int64).min))
            worst = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(worst, row, score)
            low = np.where(np.bincount(row, minlength=len(ids)) >= k, worst, np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "v", "norm2", "row", "slice")), pa.array(low)], ["id", "v", "norm2", "row", "slice", "low"])

    row = F.monotonically_increasing_id()
    queries = (
        by_norm.withColumn("row", row)
        .where(F.pmod("id", F.lit(step)) == 0)
        .withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
        .mapInArrow(thresholds, "id long, v array<bigint>, norm2 double, row long, slice int, low long")
        .checkpoint()
    )
    # A block of candidates meets a slice of queries unless its greatest norm can lift none of them over its threshold.
    # In order of norm, the blocks that a slice meets come first; in order of that number, so do the slices a block meets.
    block_rows = sorted(blocks.groupBy("part", "nth").agg(F.max("norm2").alias("top")).collect(), key=lambda r: (-r.top, r.part, r.nth))
    tops = np.array([r.top for r in block_rows])
    slice_rows = queries.groupBy("slice").agg(F.max("norm2").alias("top"), F.min("low").alias("low")).collect()
    reach = {r.slice: int(((tops * r.top) ** 0.5 * (1 + 1e-9) + 1 >= r.low).sum()) for r in slice_rows}
    nth_slice = sorted(reach, key=lambda s: (-reach[s], s))
    meets = np.searchsorted(-np.array([reach[s] for s in nth_slice]), -np.arange(len(block_rows)), "left").tolist()
    block_table = spark.createDataFrame([(r.part, r.nth, i, m) for i, (r, m) in enumerate(zip(block_rows, meets, strict=True)) if m], "part int, nth int, block int, meets int")
    slice_table = spark.createDataFrame([(s, i, reach[s]) for i, s in enumerate(nth_slice) if reach[s]], "slice int, nth_slice int, reach int")
    small = lambda table, rows: F.broadcast(table) if rows <= BROADCAST_ROWS else table
    left = queries.join(small(slice_table, len(nth_slice)), "slice").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)))
    right = blocks.join(small(block_table, len(block_rows)), ["part", "nth"]).withColumn("nth_slice", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    left = left.select("block", "nth_slice", "id", "row", "v", "norm2", "low")
    right = right.select("block", "nth_slice", "id", "v", "norm2")

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows == 0 or c.num_rows == 0:
            return pa.table({n: pa.array([], pa.int64()) for n in ("row", "query_id", "vec_id", "score")})
        rotation = longest.value[1]
        block = _rotated(c, width, rotation)
        qs = Rotated(np.asarray(q.column("id").combine_chunks()), _matrix(q.column("v"), width), rotation)
        at_query, at, score = best(qs, block, k, np.asarray(q.column("low").combine_chunks()))
        ids = block.ids[at]
        rows = np.asarray(q.column("row").combine_chunks())
        return pa.table({"row": rows[at_query], "query_id": qs.ids[at_query], "vec_id": pa.array(ids, mask=ids == _NULL_ID), "score": score})

    by = ["block", "nth_slice"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, RESULT)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
