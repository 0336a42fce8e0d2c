"""Operator 10, line dedup: range-partitioned line hashes, sorted by document and position, give keep bitmaps.

Lines travel as a 128-bit hash of their key, never as text. As the hash is uniform, ranges of equal width hold equally many
different lines: no sample is taken, and a row's range is its number. Ranges that hold more rows than their share hold a
frequent line; the excess, as counted, gives the number of salts that their rows are dealt by. A secondary sort by document and
position streams each run: whatever follows the run's first document is a repeat. Only the first documents of salted runs
meet once more, a few for every salt, to settle the smallest. Repeats come back as sparse 64-bit bitmap words by document,
and only apply_bitmaps() touches a text again: bitmaps within the session's broadcast limit, as counted, are broadcast, others meet the texts in a
hash join that sorts no text. No Python runs on executors.

Defined cases: a null or empty text is one empty line and stays so; texts of any length are split whole; rows with an equal
doc_id are one document for the rule, and each row gets the bitmap of its own text; a null doc_id counts as one document after
all others; keys shorter than min_chars never drop; an empty table gives an empty result; extra columns pass through
apply_bitmaps() untouched, whatever their names, but for n_lines and n_dropped, which give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.llm.text import WS_CHARS, ascii_lower, broadcast_limit, free_prefix
from isohyet.session import shared_dir

#: Rows that a range of hashes aims at (some 60 MB), where the session's partitions would leave more.
ROWS_A_RANGE = 1_000_000
#: A range of more than this many times the mean is dealt by salts.
UNEVEN = 2
#: Tables of frequent ranges of up to this many rows are broadcast; bitmaps up to the session's own limit.
BROADCAST_ROWS = 50_000


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(WS_CHARS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """(key, row_hash, words): for each text with repeats, array of (word, bits); bit i of word w set: line 64 w + i goes."""
    spark = docs.sparkSession
    shared_dir(spark)
    found = (
        docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("row_hash"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
        .select("doc", "row_hash", "pos", line_key(F.col("line")).alias("line"))
        .where(F.length("line") >= min_chars)
        .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "doc", "row_hash", "pos")
        .checkpoint()
    )
    n = found.count()
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_A_RANGE))
    place = F.floor((F.shiftright("h1", 32) + F.lit(2**31)) * F.lit(ranges) / F.lit(2**32)).cast("int")
    ranged = found.withColumn("range", place)
    crowded = ranged.groupBy(F.col("range").alias("crowd")).count().where(F.col("count") * ranges > UNEVEN * n)
    crowded = crowded.select("crowd", F.ceil(F.col("count") * ranges / n).cast("int").alias("salts")).checkpoint()
    if crowded.count() <= BROADCAST_ROWS:
        crowded = F.broadcast(crowded)
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc", "row_hash"), F.col("salts"))).cast("int")
    dealt = ranged.join(crowded, F.col("range") == F.col("crowd"), "left").withColumn("salt", salt)
    dealt = dealt.withColumn("part", F.pmod(F.col("range") + F.coalesce("salt", F.lit(0)), F.lit(ranges)))
    in_order = [F.col("doc").asc_nulls_last(), "pos"]
    run = Window.partitionBy("part", "h1", "h2", "salt").orderBy(*in_order)
    runs = dealt.select("part", "h1", "h2", "salt", "doc", "row_hash", "pos").repartitionById(ranges, "part").withColumn("first", F.first("doc").over(run))
    is_first = F.col("doc").eqNullSafe(F.col("first"))
    over = Window.partitionBy("part", "h1", "h2").orderBy(*in_order)
    settled = (
        runs.where(is_first & F.col("salt").isNotNull())
        .select(place.alias("part"), "h1", "h2", "doc", "row_hash", "pos")
        .repartitionById(ranges, "part")
        .withColumn("first", F.first("doc").over(over))
        .where(~is_first)
    )
    repeats = runs.where(~is_first).select("doc", "row_hash", "pos").unionByName(settled.select("doc", "row_hash", "pos"))
    return (
        repeats.groupBy("doc", "row_hash", F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
        .groupBy("doc", "row_hash")
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
        .withColumnRenamed("doc", key)
    )


def apply_bitmaps(docs: DataFrame, marks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with dropped lines taken out of the text, and with n_lines and n_dropped (columns of docs by those names give way)."""
    own = free_prefix(docs.columns)
    row, doc, hash_, words = (f"{own}{n}" for n in ("row", "doc", "hash", "words"))
    shared_dir(docs.sparkSession)
    marks = marks.checkpoint()
    # a row takes some 64 bytes, a word of its bitmap 32
    size = marks.agg(F.sum(64 + 32 * F.size("words"))).first()[0] or 0
    m = marks.select(F.col(key).alias(doc), F.col("row_hash").alias(hash_), F.map_from_entries("words").alias(words))
    m = F.broadcast(m) if size <= broadcast_limit(docs.sparkSession) else m.hint("shuffle_hash")
    joined = docs.withColumn(row, F.xxhash64(F.col(text))).join(m, F.col(key).eqNullSafe(F.col(doc)) & (F.col(row) == F.col(hash_)), "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    # The lambda only touches the map, which try_element_at scans: one entry for every 64 lines at most.
    stays = F.array_join(
        F.filter(lines_of(F.col(text)), lambda _, i: F.coalesce(F.try_element_at(words, F.shiftright(i, 6)), F.lit(0).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(63))) == 0),
        "\n",
    )
    dropped = F.aggregate(F.map_values(words), F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x))
    return joined.withColumns({
        "n_lines": (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_dropped": F.coalesce(dropped, F.lit(0).cast("long")),
        text: F.when(F.col(words).isNull(), F.col(text)).otherwise(stays),
    }).drop(row, doc, hash_, words)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    return apply_bitmaps(docs, bitmaps(docs, key, text, min_chars), key, text)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT rn, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rn, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT l.*, coalesce(l.doc_id > f.first, false) AS gone FROM l LEFT JOIN f USING (k)),
g AS (
  SELECT rn, doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM m GROUP BY rn, doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g
"""
