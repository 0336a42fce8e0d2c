"""Operator 5, MinHash near-dedup: fast similarity sketches, banding, exact verification, connected components.

A sketch has some 280 coordinates, filled in rounds: in round i every shingle is hashed to one coordinate (in the later half
of the rounds to coordinate i itself), a coordinate keeps the smallest value of its first round, and a text is
done once all its coordinates are filled; a few rounds do for most texts, and twice as many as coordinates for any. Bands (40 of
7 coordinates for a similarity of 0.85, 46 of 6 for 0.8) miss a pair at the threshold with a chance below one in a million.

Texts with one and the same shingle set become one node first. Buckets then never list their pairs: the smallest node of a
bucket is its hub, and members are verified against hubs on full sets. Verified links are contracted into components. Any
two nodes that share a bucket are in the group of its hub. A large group whose members lie in several components takes new hubs from
those that are apart, a round at a time, each linear in the group, as long as that helps. What is then still apart from its group's largest component
is settled in blocks, among itself and against that component, whose own pairs need no look: a task counts the shingles that
two blocks of bounded size share by matrix products and returns only links that join components, at most one for each
member. Large groups are cut into shells by their distance to the hub, and by the triangle inequality of the Jaccard distance
only neighbouring shells meet. So a link is lost only where no band meets.

Joins on hub, bucket and class are plain equi-joins on tables cut off from their lineage, whose hot keys adaptive execution splits;
what groups a key is pre-aggregated. Nothing but counts reaches the driver.

Defined cases: a text without words (or null) has an empty set, is its own component and stays; texts of any length are
shingled whole; a key is an integer, or a text of one (others are an error); fewer words than the
shingle width make one shingle; rows with equal doc_id and text are alike and share their result; rows with equal doc_id
but other texts are texts of their own under one name; a null doc_id names a component only if no other can; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm.text import free_prefix
from isohyet.operators import entity
from isohyet.session import shared_dir, ship_package

#: Words in a shingle and similarity of a link in hundredths, as op5's contract has them; near_duplicates() defaults to 5 and 80.
WIDTH, PERCENT = 3, 85
#: Coordinates of a sketch at most, and the chance at most that no band meets a pair at the similarity of a link.
COORDINATES, MISS = 280, 1e-6
#: Texts that are sketched together, and the words of a task's cache before it starts anew.
TOGETHER = 128
#: Rounds of new hubs for groups with more members apart than a block holds, while that falls to such a part a round.
ROUNDS, PROGRESS = 8, 0.9
#: Nodes and bytes of text of a block at most (a longer text is a block of its own), and shingles in one matrix product.
BLOCK_NODES, BLOCK_BYTES, PRODUCT = 512, 2 << 20, 8_192
#: Tables of up to this many rows (some 2 MB) are broadcast, larger ones shuffled.
BROADCAST_ROWS = 50_000
#: Links that one task joins (some 50 MB) before rounds of joins take over.
ONE_TASK_LINKS = 200_000
CACHE_WORDS = 1_000_000

_FULL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
_LOW = np.uint64(0xFFFF_FFFF)
_MULTIPLIERS = np.array([0x9E37_79B9_7F4A_7C15, 0xC2B2_AE3D_27D4_EB4F, 0x1656_67B1_9E37_79F9, 0x27D4_EB2F_1656_67C5, 0x85EB_CA77_C2B2_AE63], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8_FEB8_6659_FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8_FEB8_6659_FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts: A-Z lower-cased, words cut at ASCII white space."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.known, self.digest = width, {}, xxhash.xxh3_64_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known, digest = self.known, self.digest
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = digest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        out = np.full(len(codes) - width + 1, width, np.uint64)
        for i in range(width):
            out = _mix(out * _MULTIPLIERS[i % len(_MULTIPLIERS)] + codes[i : i + len(out)])
        return np.unique(out)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that still meet pairs of that similarity."""
    for rows in range(COORDINATES, 0, -1):
        bands = COORDINATES // rows
        if (1 - (percent / 100) ** rows) ** bands < MISS:
            return bands, rows
    return COORDINATES, 1


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row of size values for each set (none empty); the upper half of a value is the round it comes from."""
    n = len(sets)
    values = np.full(n * size, _FULL, np.uint64)
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    for turn in range(2 * size):
        hashed = _mix(items ^ _mix(np.uint64([turn + 1]) * _MULTIPLIERS[0]))
        place = ((hashed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if turn < size else turn - size
        # earlier rounds are smaller, so that a coordinate keeps its first round's minimum
        np.minimum.at(values, owner * size + place, (hashed & _LOW) | np.uint64(turn << 32))
        open_ = (values.reshape(n, size) == _FULL).any(1)
        if not open_.any():
            break
        if not open_.all():
            stays = open_[owner]
            items, owner = items[stays], owner[stays]
    return values.reshape(n, size)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key (signed) for every band of each sketch; a key tells its band."""
    parts = values.reshape(len(values), bands, rows)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for j in range(rows):
        key = _mix(key * _MULTIPLIERS[1] + parts[:, :, j])
    return key.view(np.int64)


SKETCHED = "doc long, text_hash long, n_shingles long, d1 long, d2 long, bands array<bigint>"


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle = Shingler(width)
        for big in batches:
            for at in range(0, big.num_rows, TOGETHER):
                b = big.slice(at, TOGETHER)
                sets = [shingle(t) for t in b.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(sketches([sets[i] for i in full], bands * rows), bands, rows)
                buckets: list = [None] * len(sets)
                for i, row in zip(full, keys, strict=True):
                    buckets[i] = row
                digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(buckets, pa.list_(pa.int64()))],
                    ["doc", "text_hash", "n_shingles", "d1", "d2", "bands"],
                )

    return run


VERIFIED = "hub long, node long, shared long, either long"


def _verify(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, hub, mine = Shingler(width), None, None
        for big in batches:
            for at in range(0, big.num_rows, TOGETHER):
                b = big.slice(at, TOGETHER)
                shared, either = [], []
                hubs = b.column("hub").to_pylist()
                for i, (h, text) in enumerate(zip(hubs, b.column("node_text").to_pylist(), strict=True)):
                    if h != hub:  # rows of a hub follow each other
                        hub, mine = h, shingle(b.column("hub_text")[i].as_py())
                    other = shingle(text)
                    both = np.concatenate([mine, other])
                    both.sort()
                    k = int((both[1:] == both[:-1]).sum())
                    shared.append(k)
                    either.append(len(both) - k)
                yield pa.RecordBatch.from_arrays([b.column("hub"), b.column("node"), pa.array(shared, pa.int64()), pa.array(either, pa.int64())], ["hub", "node", "shared", "either"])

    return run


SETTLED = "a long, b long"


def _settle(width: int, percent: int):
    """Links between the two blocks of a group (or within one) that join different components, as far as the group knows."""

    def run(table: pa.Table) -> pa.Table:
        nodes = np.asarray(table.column("node").combine_chunks())
        found: list[tuple[int, int]] = []
        root = {c: c for c in table.column("component").to_pylist()}
        comp = table.column("component").to_pylist()

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        if len(root) > 1:
            shingle = Shingler(width)
            sets = [shingle(t) for t in table.column("text").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            side = np.asarray(table.column("side").combine_chunks())
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            shared = _shared(sets, left, right)
            either = sizes[left][:, None] + sizes[right][None, :] - shared
            for i, j in zip(*np.nonzero(100 * shared >= percent * either), strict=True):
                a, b = top(comp[left[i]]), top(comp[right[j]])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((int(nodes[left[i]]), int(nodes[right[j]])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of left shares with each of right."""
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(items, return_inverse=True, return_counts=True)
    new = np.cumsum(times > 1) - 1  # what one set alone holds isn't shared
    keep = times[column] > 1
    column, owner = new[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    end = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, end, PRODUCT):
        lo, hi = np.searchsorted(column, [at, at + PRODUCT])
        dense = np.zeros((len(sets), min(PRODUCT, end - at)), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        out += dense[left] @ dense[right].T
    return out.astype(np.int64)


def _small(table: DataFrame, rows: int) -> DataFrame:
    """The table, marked for broadcast if its rows are few."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) for nodes (node): the smallest node reachable over links (a, b), itself if it has none."""
    joined, n = entity.cut_off(entity.components(links, ONE_TASK_LINKS, BROADCAST_ROWS).withColumnsRenamed({"node": "root", "component": "top"}))
    to = _small(joined, n)
    return entity.cut_off(nodes.join(to, F.col("node") == F.col("root"), "left").select("node", F.coalesce("top", "node").alias("component")))[0]


def _joined_by(reach: DataFrame, links: DataFrame) -> DataFrame:
    """reach (node, component) once new links (a, b) between nodes have joined components."""
    of = lambda name: reach.select(F.col("node").alias(f"{name}_node"), F.col("component").alias(name))
    between = links.withColumnsRenamed({"a": "x", "b": "y"}).join(of("a"), F.col("x") == F.col("a_node")).join(of("b"), F.col("y") == F.col("b_node")).select("a", "b")
    top, n = entity.cut_off(entity.components(between, ONE_TASK_LINKS, BROADCAST_ROWS).withColumnsRenamed({"node": "root", "component": "top"}))
    return entity.cut_off(reach.join(_small(top, n), F.col("component") == F.col("root"), "left").select("node", F.coalesce("top", "component").alias("component")))[0]


def _open_groups(group: DataFrame) -> tuple[DataFrame, int]:
    """(o_hub, main, n, apart) of groups (hub, node, component) of several components: the largest one, members, members outside it."""
    parts = group.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("component")).alias("low")))
    found = parts.groupBy("hub").agg(best.alias("best"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return entity.cut_off(found.select(F.col("hub").alias("o_hub"), (-F.col("best.low")).alias("main"), "n", (F.col("n") - F.col("best.n")).alias("apart")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row; kept: the document that names its component."""
    spark = docs.sparkSession
    ship_package(spark)
    shared_dir(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    every = rows.select("doc", "text_hash", "text").mapInArrow(_sketch(width, *banding(percent)), SKETCHED).checkpoint()
    # Equal sets are one node; its text is that of its smallest document.
    classes = every.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc", "text_hash")).alias("first"), F.min("doc").alias("id"), F.max("n_shingles").alias("n"))
    nodes = classes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "id", "n", F.col("first.doc").alias("doc"), F.col("first.text_hash").alias("text_hash")).checkpoint()
    chosen = nodes.select("node", "n", F.col("d1").alias("n1"), F.col("d2").alias("n2"), F.col("doc").alias("n_doc"), F.col("text_hash").alias("n_hash"))
    placed = every.join(
        chosen, (F.col("d1") == F.col("n1")) & (F.col("d2") == F.col("n2")) & F.col("doc").eqNullSafe(F.col("n_doc")) & (F.col("text_hash") == F.col("n_hash"))
    ).select("node", "n", F.explode("bands").alias("bucket"))
    # Buckets of several nodes, with their smallest as the first hub.
    shared = placed.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select(F.col("bucket").alias("b"), "hub").checkpoint()
    members = placed.join(shared, F.col("bucket") == F.col("b")).select("hub", "node").distinct().checkpoint()
    met, _ = entity.cut_off(members.select("node").distinct())
    texts = (
        rows.join(
            nodes.join(met, "node", "left_semi").select("node", F.col("doc").alias("n_doc"), F.col("text_hash").alias("n_hash")),
            F.col("doc").eqNullSafe(F.col("n_doc")) & (F.col("text_hash") == F.col("n_hash")),
        ).select("node", "text").dropDuplicates(["node"]).checkpoint()
    )

    hub_texts = texts.select(F.col("node").alias("t_hub"), F.col("text").alias("hub_text"))

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hub, node, shared, either) of pairs, and the links (a, b) among them."""
        with_node = pairs.join(texts, "node").select("hub", "node", F.col("text").alias("node_text"))
        with_both = with_node.join(hub_texts, F.col("hub") == F.col("t_hub")).select("hub", "node", "node_text", "hub_text")
        tested, _ = entity.cut_off(with_both.mapInArrow(_verify(width), VERIFIED))
        return tested, tested.where(F.expr(f"100 * shared >= {percent} * either")).select(F.col("hub").alias("a"), F.col("node").alias("b"))

    # Every member against its hubs.
    tested, links = verified(members.where("hub <> node"))
    reach = components(met, links)

    # Groups of a hub with open pairs: members (the hub is linked with or ruled out for all of them) of several components.
    away = tested.select("hub", "node", (1 - F.col("shared") / F.col("either")).alias("d"))
    still = None
    for turn in range(ROUNDS + 1):
        group = away.join(reach.select(F.col("node").alias("c_node"), "component"), F.col("node") == F.col("c_node")).drop("c_node")
        open_, n_open = _open_groups(group)
        large, n_large = entity.cut_off(open_.where(F.col("apart") > BLOCK_NODES))
        was, still = still, large.agg(F.sum("apart")).first()[0]
        if n_large == 0 or turn == ROUNDS or (was is not None and still > PROGRESS * was):
            break
        # a new hub from those that are apart, for all of the group that isn't joined with it yet
        among = group.join(_small(large, n_large), F.col("hub") == F.col("o_hub"))
        probes = among.where("component <> main").groupBy(F.col("hub").alias("p_hub")).agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node"), "node", "component")).alias("probe"))
        asked = group.join(_small(probes, n_large), F.col("hub") == F.col("p_hub")).where(F.col("component") != F.col("probe.component"))
        reach = _joined_by(reach, verified(asked.select(F.col("probe.node").alias("hub"), "node").distinct())[1])
    far = 1 - percent / 100 + 1e-9
    sized = group.join(_small(open_, n_open), F.col("hub") == F.col("o_hub")).join(texts.select(F.col("node").alias("t_node"), F.octet_length("text").alias("bytes")), F.col("node") == F.col("t_node"))
    # twice the shell, and one more for members apart from the largest component
    shell = F.when(F.col("n") <= BLOCK_NODES, 0).otherwise(F.floor(F.col("d") / far)) * 2 + F.when(F.col("component") == F.col("main"), 0).otherwise(1)
    placed_in = sized.select("hub", "node", "component", "bytes", shell.cast("int").alias("shell")).checkpoint()
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    shells, n_shells = entity.cut_off(placed_in.groupBy("hub", "shell").agg(blocks.alias("blocks")).groupBy(F.col("hub").alias("s_hub")).agg(F.map_from_entries(F.collect_list(F.struct("shell", "blocks"))).alias("blocks")))
    there = lambda shell: F.coalesce(F.try_element_at("blocks", shell), F.lit(0))
    numbers = lambda n: F.filter(F.sequence(F.lit(0), n), lambda v: v < n)
    own = F.struct(F.col("shell").alias("shell"), F.col("block").alias("block"))
    in_shell = lambda shell: F.transform(numbers(there(shell)), lambda v: F.struct(shell.cast("int").alias("shell"), v.cast("int").alias("block")))
    odd = F.col("shell").bitwiseAND(1)
    partners = F.concat(*[in_shell(F.col("shell") - odd + 1 + 2 * step) for step in (-1, 0, 1)], *[F.when(odd == 1, in_shell(F.col("shell") - odd + 2 * step)).otherwise(F.array().cast("array<struct<shell:int,block:int>>")) for step in (-1, 0, 1)])
    dealt = (
        placed_in.join(_small(shells, n_shells), F.col("hub") == F.col("s_hub"))
        .withColumn("block", F.pmod(F.xxhash64("node"), there(F.col("shell"))).cast("int"))
        .withColumn("with", F.explode(partners))
        .select("hub", F.least(own, F.col("with")).alias("low"), F.greatest(own, F.col("with")).alias("high"), F.when(own == F.col("with"), 2).otherwise(F.when(own < F.col("with"), 0).otherwise(1)).alias("side"), "node", "component")
    )
    with_text = dealt.join(texts, "node").select("hub", F.concat_ws("-", "low.shell", "low.block", "high.shell", "high.block").alias("blocks"), "side", "node", "component", "text")
    more, n_more = entity.cut_off(with_text.groupBy("hub", "blocks").applyInArrow(_settle(width, percent), SETTLED))
    if n_more:
        reach = _joined_by(reach, more)
    comp = reach.select(F.col("node").alias("c_node"), "component")
    named = nodes.join(comp, F.col("node") == F.col("c_node"), "left").select("d1", "d2", "id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id")).withColumnRenamed("component", "l_component").checkpoint()
    by_set = named.join(least, F.col("component") == F.col("l_component")).select(F.col("d1").alias("s1"), F.col("d2").alias("s2"), "component_id").checkpoint()
    full = every.where("n_shingles > 0").join(by_set, (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2"))).select("doc", "n_shingles", "component_id")
    empty = every.where("n_shingles = 0").select("doc", "n_shingles", F.col("doc").alias("component_id"))
    return full.unionByName(empty).select(F.col("doc").alias(key), "n_shingles", "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document names its component; columns as they are."""
    name = f"{free_prefix(docs.columns)}kept"
    kept = near_duplicates(docs, key, text, width, percent).where("kept").select(F.col(key).alias(name))
    return docs.join(kept, F.col(key).cast("long").eqNullSafe(F.col(name)), "left_semi")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=WIDTH, percent=PERCENT)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""
