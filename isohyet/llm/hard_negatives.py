"""Operator 11, hard-negative mining: k-means inverted lists, visited by Cauchy-Schwarz bounds.

Vectors are quantised to integers. k-means over a bounded sample gives the centroids; every vector goes to its nearest one's list, which
is laid out by distance and cut into bundles of consecutive rows. The part of a list in a bundle stores its radius r, the greatest distance
from the centroid c, so that an anchor q scores its vectors between qc - |q|r and qc + |q|r. One search serves both steps: the best vectors of an anchor's own label
are its positives; each positive opens a window of scores, in which the best vectors of other labels are its negatives. A search
visits an anchor's PROBES lists of greatest bound first, whose kth score then shuts out the lists with a bound strictly below; lists outside
the window are skipped, the rest is visited. Within a task, too, lists come in order of their bounds and stop at the kth scores.

Vectors stay with their bundle, anchors travel: both meet in one exchange sorted so that a bundle comes first and anchors stream past it;
a bundle that many anchors visit is copied once for every SLICE_ROWS of them. Of rows that are equal in vector and label only
the first few by id can be among the best of anything, so that no other is indexed: a group of copies of any size is a few rows. What
goes to the driver and, broadcast, to tasks is the centroids (LISTS at most) and a row for every list's part in a bundle.

Defined cases: rows with a null label, or a vector that is null or holds a null or non-finite component, take no part; a shorter vector
counts as followed by zeros; rows of an equal id are rows of their own, none of them is a positive for an anchor of
that id; equal scores go by smaller id, a null id last, and is no anchor; an anchor without positives, or whose windows are
empty, as those of negative scores are, has no row; a component or a score outside 64 bits is an error; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.llm.topk import _matrix, quantise
from isohyet.session import shared_dir, ship_package

STEP, POSITIVES, NEGATIVES = 50, 5, 3
#: The window of a negative's score, in hundredths of the positive's.
WINDOW = (50, 95)
#: Vectors that k-means sees (expected, at most twice as many), the most lists it makes, and its rounds.
SAMPLE_ROWS, LISTS, ROUNDS, SEED = 65_536, 1_024, 8, 11
#: Lists that a search visits before bounds are held against kth scores.
PROBES = 8
#: Rows of a bundle, and bytes of its vectors at most.
BUNDLE_ROWS, BUNDLE_BYTES = (1_024, 131_072), 64 << 20
#: Anchors that a copy of a bundle serves.
SLICE_ROWS = 65_536
#: Tables of bundles of up to this many rows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 50_000
#: Products of so many anchors by so many vectors at once.
TILE_QUERIES, TILE_ROWS = 256, 4_096

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
QUERY = "row long, id long, label long, v array<bigint>, low array<bigint>, high array<bigint>"
FOUND = "row long, goal int, vec_id long, score long"


class Index:
    """Candidates by bundle, and what bounds need to know of their lists (a row for every list's part in a bundle)."""

    def __init__(self, candidates: DataFrame, centroids: np.ndarray, lists: list, width: int):
        self.candidates, self.width = candidates, width
        # lists in order of (bundle, cluster)
        self.bundle = np.array([r.bundle for r in lists], np.int64)
        self.cluster = np.array([r.cluster for r in lists], np.int64)
        self.radius = np.array([r.radius for r in lists], float)
        self.centroids = centroids
        self.shared = candidates.sparkSession.sparkContext.broadcast((self.bundle, self.cluster, self.radius, centroids))


def bounds(vectors: np.ndarray, cluster: np.ndarray, radius: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that a list may hold for every vector, a little wider as products round."""
    norm = np.sqrt((vectors**2).sum(1))[:, None]
    centre = (vectors @ centroids.T)[:, cluster]
    reach = norm * radius
    slack = 1e-9 * (norm * np.sqrt((centroids**2).sum(1))[cluster] + reach) + 1e-6
    return centre - reach - slack, centre + reach + slack


def reaches(least: np.ndarray, greatest: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which lists can hold a score from low to high of any of a vector's goals."""
    out = np.zeros(greatest.shape, bool)
    for goal in range(low.shape[1]):
        out |= (greatest >= low[:, goal, None]) & (least <= high[:, goal, None]) & (low[:, goal] <= high[:, goal])[:, None]
    return out


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all of b."""
    big = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 0 <= big <= 2**20 and a.shape[1] <= 2**13:  # sums stay within 53 bits
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    if exact.size and max(map(abs, exact.ravel())) >= 2**63:
        raise OverflowError("a score exceeds 64 bits")
    return exact.astype(np.int64)


def _lists_of(column: pa.Array, lists: int) -> np.ndarray:
    """Rows of list numbers as booleans."""
    out = np.zeros((len(column), lists), bool)
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    out[np.repeat(np.arange(len(column)), lengths), flat] = True
    return out


def _router(index: Index, limit: int | None) -> Callable:
    """Deals queries to the bundles of the lists that they visit: the limit lists of greatest bound, or all that are left."""
    shared, width = index.shared, index.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, cluster, radius, centroids = shared.value
        rows_at_once = max(1, min(TILE_QUERIES, (1 << 22) // max(1, len(bundle))))
        for big in batches:
            for at in range(0, big.num_rows, rows_at_once):
                b = big.slice(at, rows_at_once)
                least, greatest = bounds(_matrix(b.column("v"), width).astype(float), cluster, radius, centroids)
                goes = reaches(least, greatest, *(_matrix(b.column(c), len(b.column(c)[0])) for c in ("low", "high")))
                goes &= ~_lists_of(b.column("seen"), len(bundle))
                if limit is not None and limit < goes.shape[1]:
                    order = np.where(goes, -greatest, np.inf)
                    chosen = np.argpartition(order, limit - 1, axis=1)[:, :limit]
                    few = np.zeros_like(goes)
                    np.put_along_axis(few, chosen, True, axis=1)
                    goes &= few
                row, nth = np.nonzero(goes)
                if not len(row):
                    continue
                first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(bundle[nth]) != 0)])
                made = b.take(pa.array(row[first]))
                columns = {c: made.column(c) for c in ("row", "id", "label", "v", "low", "high")}
                columns |= {"lists": pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(nth, pa.int32())), "bundle": pa.array(bundle[nth[first]])}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _best(k: int, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of every query, by descending score and id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
    return query[keep], ids[keep], score[keep]


class Bundle:
    """The vectors of one bundle, its lists one after another."""

    def __init__(self, pieces: list[pa.RecordBatch], bundle: int, shared: tuple, width: int):
        table = pa.Table.from_batches(pieces)
        in_order = np.argsort(np.asarray(table.column("cluster")), kind="stable")
        cluster = np.asarray(table.column("cluster"))[in_order]
        self.ids = np.asarray(table.column("id").combine_chunks().fill_null(_HIGH))[in_order]
        self.label, self.ints = np.asarray(table.column("label"))[in_order], _matrix(table.column("v"), width)[in_order]
        bundles, clusters, radius, self.centroids = shared
        self.first = int(np.searchsorted(bundles, bundle, "left"))
        here = slice(self.first, int(np.searchsorted(bundles, bundle, "right")))
        self.cluster, self.radius = clusters[here], radius[here]
        self.starts, self.ends = np.searchsorted(cluster, self.cluster, "left"), np.searchsorted(cluster, self.cluster, "right")

    def search(self, queries: pa.RecordBatch, k: int, same: bool, width: int) -> pa.RecordBatch:
        """The k best vectors for every goal of every query, from the lists that it asks for."""
        ints = _matrix(queries.column("v"), width)
        own, label = np.asarray(queries.column("id")), np.asarray(queries.column("label"))
        goals = len(queries.column("low")[0])
        low, high = (_matrix(queries.column(c), goals) for c in ("low", "high"))
        asks = _lists_of(queries.column("lists"), self.first + len(self.cluster))[:, self.first :]
        least, greatest = bounds(ints.astype(float), self.cluster, self.radius, self.centroids)
        none = np.zeros(0, np.int64)
        found = [(none, none, none)] * goals
        for nth in np.argsort(-np.where(asks, greatest, -np.inf).max(0), kind="stable"):
            one = slice(nth, nth + 1)
            rows = np.flatnonzero(asks[:, nth] & reaches(least[:, one], greatest[:, one], low, high)[:, 0])
            for at in range(self.starts[nth], self.ends[nth] if len(rows) else 0, TILE_ROWS):
                tile = slice(at, min(at + TILE_ROWS, self.ends[nth]))
                score = exact_scores(ints[rows], self.ints[tile])
                fits = (label[rows][:, None] == self.label[tile]) == same
                if same:
                    fits &= own[rows][:, None] != self.ids[tile]
                fits &= (score >= low[rows].min(1)[:, None]) & (score <= high[rows].max(1)[:, None])
                q, c = np.nonzero(fits)
                s, q, c = score[q, c], rows[q], self.ids[tile][c]
                for goal in range(goals):
                    inside = (s >= low[q, goal]) & (s <= high[q, goal])
                    if inside.any():
                        found[goal] = _best(k, *(np.concatenate(x) for x in zip(found[goal], (q[inside], c[inside], s[inside]), strict=True)))
                        full = np.flatnonzero(np.bincount(found[goal][0], minlength=len(own)) >= k)
                        kth = found[goal][2][np.searchsorted(found[goal][0], full, "right") - 1]
                        low[full, goal] = np.maximum(low[full, goal], kth)
        row = np.asarray(queries.column("row"))
        q, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
        goal = np.repeat(np.arange(goals, dtype=np.int32), [len(x[0]) for x in found])
        return pa.RecordBatch.from_pydict({"row": row[q], "goal": goal, "vec_id": pa.array(ids, mask=ids == _HIGH), "score": score})


def _meeting(index: Index, k: int, same: bool) -> Callable:
    shared, width = index.shared, index.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, bundle, pieces = None, None, []
        for big in batches:
            places, is_query = np.asarray(big.column("place")), np.asarray(big.column("is_query"))
            cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(is_query.astype(int)) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(places)], strict=True):
                part = big.slice(start, end - start)
                if places[start] != place:
                    place, bundle, pieces = places[start], None, []
                if not is_query[start]:
                    pieces.append(part.select(["id", "label", "v", "cluster"]))
                    continue
                if bundle is None:
                    bundle, pieces = Bundle(pieces, part.column("bundle")[0].as_py(), shared.value, width), []
                for at in range(0, part.num_rows, TILE_QUERIES):
                    yield bundle.search(part.slice(at, TILE_QUERIES), k, same, width)

    return run


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def search(queries: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """(row, goal, vec_id, score, nth): for every query (QUERY) and goal the k best candidates whose label is the query's, or isn't.

    A goal is a place of the arrays low and high, the least and greatest score that count.
    """
    spark = queries.sparkSession
    found = spark.createDataFrame([], f"{FOUND}, nth int")
    left = queries.withColumn("seen", F.array().cast("array<int>"))
    best = Window.partitionBy("row", "goal").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    for limit in (PROBES, None):
        visits = left.mapInArrow(_router(index, limit), f"{QUERY}, lists array<int>, bundle long").checkpoint()
        counts = visits.groupBy("bundle").count().orderBy("bundle").collect()
        if not counts:
            break
        slices = [-(-r["count"] // SLICE_ROWS) for r in counts]
        starts = np.cumsum([0, *slices]).tolist()
        dealt = spark.createDataFrame([(r.bundle, s, n) for r, s, n in zip(counts, starts, slices, strict=False)], "bundle long, start int, slices int")
        asking = visits.join(_small(dealt, len(counts)), "bundle").withColumn("place", (F.col("start") + F.pmod(F.xxhash64("row"), "slices")).cast("int")).withColumn("is_query", F.lit(True))
        asked = index.candidates.join(_small(dealt, len(counts)), "bundle").withColumn("place", F.explode(F.sequence("start", F.col("start") + F.col("slices") - 1))).withColumn("is_query", F.lit(False))
        both = asked.select("place", "is_query", "bundle", "id", "label", "v", "cluster").unionByName(asking.drop("start", "slices"), allowMissingColumns=True)
        met = both.repartitionById(starts[-1], "place").sortWithinPartitions("place", "is_query").mapInArrow(_meeting(index, k, same), FOUND)
        found = found.drop("nth").unionByName(met).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).checkpoint()
        if limit is not None:
            kth = found.where(F.col("nth") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("goal", "score"))).alias("kth"))
            seen = visits.groupBy("row").agg(F.flatten(F.collect_list("lists")).alias("lists"))
            low = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i), F.lit(_LOW))))
            left = left.join(seen, "row").join(kth, "row", "left").select("row", "id", "label", "v", low.alias("low"), "high", F.col("lists").alias("seen"))
    return found


def build_index(rows: DataFrame, keep: int) -> Index | None:
    """The index over (id, label, v) rows; of equal vectors of one label, those that can be among the first keep of all but one id."""
    spark = rows.sparkSession
    same_vector = Window.partitionBy("label", "hash", "v").orderBy(F.col("id").asc_nulls_last())
    distinct = rows.groupBy("label", F.xxhash64("v").alias("hash"), "v", "id").agg(F.count(F.lit(1)).alias("n"))
    first = distinct.withColumn("nth", F.row_number().over(same_vector)).where(F.col("nth") <= keep + 1)
    candidates = first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(keep))))).select("id", "label", "v", "hash").checkpoint()
    n, width = candidates.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if n == 0:
        return None
    drawn = candidates.where(F.pmod(F.xxhash64(F.lit(SEED), "id", "hash"), F.lit(1 << 40)) < F.lit(int(min(1.0, SAMPLE_ROWS / n) * (1 << 40)))).limit(2 * SAMPLE_ROWS)
    features = F.transform(F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))), lambda x: x.cast("double"))
    sample = drawn.select("v").distinct().select(array_to_vector(features).alias("features")).checkpoint()
    points = sample.count()
    if points >= 2:
        model = KMeans(k=min(max(2, round(n**0.5)), LISTS, points), maxIter=ROUNDS, seed=SEED, featuresCol="features").fit(sample)
        centroids = np.array(model.clusterCenters(), float).reshape(-1, width)
    else:
        centroids = np.zeros((1, width))
    given = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = given.value
        half = (middle**2).sum(1) / 2
        for big in batches:
            for at in range(0, big.num_rows, TILE_ROWS):
                b = big.slice(at, TILE_ROWS)
                x = _matrix(b.column("v"), width).astype(float)
                near = np.argmax(x @ middle.T - half, axis=1)
                distance = np.sqrt(((x - middle[near]) ** 2).sum(1)) * (1 + 1e-9)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "v")), pa.array(near.astype(np.int32)), pa.array(distance)], ["id", "label", "v", "cluster", "distance"])

    held = max(1, min(BUNDLE_ROWS[1], BUNDLE_BYTES // (8 * max(1, width)), max(BUNDLE_ROWS[0], n // (2 * spark.sparkContext.defaultParallelism))))
    order = ["cluster", "distance", "id"]
    assigned = candidates.mapInArrow(assign, "id long, label long, v array<bigint>, cluster int, distance double")
    laid = assigned.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # a bundle is so many consecutive rows of a sorted partition
    bundle = F.col("at") - F.pmod(F.col("at").bitwiseAND((1 << 33) - 1), F.lit(held))
    bundled = laid.select(*order, "label", "v", bundle.alias("bundle")).checkpoint()
    lists = bundled.groupBy("bundle", "cluster").agg(F.max("distance").alias("radius")).orderBy("bundle", "cluster").collect()
    return Index(bundled, centroids, lists, width)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _hundredths(part: int, up: bool) -> Column:
    """part hundredths of the integer score, rounded up or down, without overflow."""
    more = (F.ceil if up else F.floor)(F.pmod("score", F.lit(100)) * part / 100)
    return F.expr("(score - pmod(score, 100)) div 100") * part + more.cast("long")


def mine(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", step: int = STEP, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows whose id is divisible by step.

    An anchor's positives are the best rows of its label, their negatives the best of other labels that score within window, hundredths of the positive's score.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    shared_dir(spark)
    rows = quantise(vectors.where(F.col(label).isNotNull()), key, column, scale, (F.col(label).cast("long").alias("label"),)).select("id", "label", "v")
    index = build_index(rows, max(positives, negatives))
    if index is None:
        return spark.createDataFrame([], MINED)
    whole = lambda x: F.array(F.lit(x).cast("long"))
    anchors = rows.where(F.pmod("id", F.lit(step)) == 0).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    near = search(anchors.select("row", "id", "label", "v", whole(_LOW).alias("low"), whole(_HIGH).alias("high")), index, positives, same=True)
    spans = near.select("row", (F.col("nth") - 1).alias("goal"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    limits = near.select("row", F.struct(F.col("nth").alias("nth"), _hundredths(window[0], up=True).alias("low"), _hundredths(window[1], up=False).alias("high")).alias("span"))
    by_row = limits.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    goal = F.sequence(F.lit(0), F.lit(positives - 1))
    # a missing positive's window is empty
    at = lambda name, empty: F.transform(goal, lambda i: F.coalesce(F.get("spans", i)[name], F.lit(empty)))
    asked = anchors.join(by_row, "row").select("row", "id", "label", "v", at("low", _HIGH).alias("low"), at("high", _LOW).alias("high"))
    far = search(asked, index, negatives, same=False).select("row", "goal", F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(spans, ["row", "goal"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    return mine(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
