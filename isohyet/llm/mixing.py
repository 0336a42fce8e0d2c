"""Operator 9, mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Targets share the mix by weight and stop at a multiple of their source. Blocks of BLOCK_WORDS words go to sources by
highest quotients (target / 1, 3, 5, ...), a source's blocks go to its shards by highest quotients of the
shards' sizes, and a source at its cap takes all its blocks as often as it may. The words of a shard, in a seeded order of its
documents, are numbered blocks; its quota is so many passes over all of them and, of the rest, a run of blocks from a seeded
number on, which goes on with the first after the last: every block is as likely as any other. Quotients are never listed: rounding by the mean divisor leaves a remainder smaller than the number of
parties, and only that many seats are ranked. A source of any share is dealt into shards of some hundred rows, of
SHARD_ROWS at most, however many rows there are, before anything is ordered. No Python runs on executors.

Defined cases: a null text has no words and is taken 0 times; a text of any length counts whole; a null source is a source of its
own, last in order; equal quotients go by name; repeated rows are documents of their own, beside each other in one shard; an
empty table gives an empty result; with no words at all, targets are 0; columns of docs pass through, whatever their names,
but those named like the operator's own (OWN), which give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.llm.text import free_prefix, words
from isohyet.session import shared_dir

BLOCK_WORDS = 64
WEIGHTS = (3, 1, 2)
MIX_RATIO = 1.5
MAX_REPEATS = 2
SEED = 77
#: The least number of parts of a source in its finest dealing; shards are unions of these.
FINE = 4_096
#: Rows that a shard aims at, between these bounds.
SHARD_ROWS = (128, 500_000)
#: Tables of quotas of up to this many rows (some 5 MB) are broadcast, larger ones shuffled.
BROADCAST_ROWS = 50_000

OWN = ("size", "source_size", "target", "taken", "copies")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = MIX_RATIO, repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds target and capped to (source, source_size): ratio times all words by weight, none above repeats times its source.

    What a capped source can't hold goes to the others by weight, again and again. In order of cap over weight the capped ones
    come first, so that one running sum settles all rounds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")).cast("double"))
    cap = F.col("source_size") * F.lit(float(repeats))
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    later = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("goal") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    return (
        weighed.withColumn("cap", cap)
        .withColumn("goal", F.sum("source_size").over(everything) * F.lit(ratio))
        .withColumn("level", level)
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
        .withColumn("held", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("free_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("goal") - F.col("held")) / F.col("free_weight") * F.col("weight")))
        .drop("cap", "goal", "level", "held", "free_weight")
    )


def apportion(parties: DataFrame, votes: str, seats: str, by: list[str], name: list[str], out: str) -> DataFrame:
    """Sainte-Lague: adds out, the seats of every party (a row), by highest quotients; seats: the number for each group of by.

    Rounding votes by the mean divisor misses the number of seats by at most half the parties. A party's further seats are
    no more than its share of that, so that ranking a few next quotients of each settles the rest. Ties go in order of name.
    """
    group = Window.partitionBy(*by)
    total, n = F.sum(votes).over(group), F.count(F.lit(1)).over(group)
    start = (
        parties.withColumn("__total", total.cast("double"))
        .withColumn("__n", n)
        .withColumn("__first", F.when(F.col("__total") > 0, F.round(F.col(votes) * F.col(seats) / F.col("__total"))).otherwise(0).cast("long"))
        .withColumn("__rest", F.col(seats) - F.sum("__first").over(group))
        .withColumn("__place", F.row_number().over(group.orderBy(*[F.col(c).asc_nulls_last() for c in name])))
    )
    span = F.ceil(F.coalesce(F.col(votes) / F.col("__total"), F.lit(0.0)) * (F.abs("__rest") + F.col("__n"))).cast("long") + 1
    grow = F.col("__rest") > 0
    # quotients of the next seats where some are missing, of the last seats where there are too many
    steps = F.when(F.col("__rest") == 0, F.array().cast("array<bigint>")).when(grow, F.sequence(F.lit(0).cast("bigint"), span)).otherwise(
        F.when(F.col("__first") > 0, F.sequence(F.lit(1).cast("bigint"), F.least(span, F.col("__first")))).otherwise(F.array().cast("array<bigint>"))
    )
    seat = F.when(grow, F.col("__first") + F.col("__step")).otherwise(F.col("__first") - F.col("__step"))
    quotient = F.col(votes) / (2 * seat + 1)
    ranked = start.select("*", F.explode(steps).alias("__step")).where(F.col("__total") > 0).withColumn("__q", quotient)
    # seats go to the greatest quotients, and are taken back from the least; of equal ones the first in order of name is the last to lose
    order = [F.when(grow, -F.col("__q")).otherwise(F.col("__q")), F.when(grow, F.col("__place")).otherwise(-F.col("__place"))]
    chosen = (
        ranked.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order, "__step")))
        .where(F.col("__rank") <= F.abs("__rest"))
        .groupBy(*[F.col(c).alias(f"__{c}") for c in dict.fromkeys([*by, *name])])
        .agg(F.count(F.lit(1)).alias("__more"))
    )
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in dict.fromkeys([*by, *name])]
    return start.join(chosen, on, "left").withColumn(
        out, F.col("__first") + F.signum("__rest").cast("long") * F.coalesce("__more", F.lit(0))
    ).select(*parties.columns, out)


def run_of_blocks(held: Column, some: Column, block: int, *seeds: Column) -> tuple[Column, Column, Column]:
    """(low, high, wrapped): some of held blocks, those from a seeded number on, as words low to high and the first wrapped words."""
    first = F.when(some < held, F.pmod(F.xxhash64(*seeds), held)).otherwise(0)
    return (first * block).alias("low"), ((first + some) * block).alias("high"), F.greatest(F.lit(0), (first + some - held) * block).alias("wrapped")


def words_in_run(start: Column, size: Column, low: Column, high: Column, wrapped: Column) -> Column:
    """How many of a document's words, size from start on, lie in the run. The last block may be short: no document has words beyond it."""
    within = lambda a, b: F.greatest(F.lit(0), F.least(start + size, b) - F.greatest(start, a))
    return within(low, high) + F.when(high > low, within(F.lit(0), wrapped)).otherwise(0)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, block: int = BLOCK_WORDS) -> DataFrame:
    """docs with size, source_size, target, taken (words, repeats counted) and copies (whole documents, for uses that can't cut)."""
    spark = docs.sparkSession
    shared_dir(spark)
    docs = docs.drop(*OWN)
    own = free_prefix(docs.columns)
    row_source, row_mix, row_fine, row_shard, row_start = (f"{own}{n}" for n in ("source", "mix", "fine", "shard", "start"))
    # a power of two, so that shards are unions of fine parts
    parts = max(FINE, 1 << (docs.count() // SHARD_ROWS[1]).bit_length())
    rows = docs.withColumns({
        "size": F.size(words(F.col(text))).cast("long"),
        row_source: F.col(source),
        row_mix: F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text))),
    }).withColumn(row_fine, F.pmod(row_mix, F.lit(parts)).cast("int"))
    fine = (
        rows.groupBy(F.col(row_source).alias("__source"), F.col(row_fine).alias("__fine"))
        .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        .checkpoint()
    )
    per_source = fine.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows"))
    everything = Window.partitionBy()
    aim = F.greatest(F.lit(SHARD_ROWS[0]), F.least(F.lit(SHARD_ROWS[1]), F.sum("rows").over(everything) / parts))
    n_shards = F.least(F.lit(parts), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("rows") / aim)))).cast("int"))
    planned = targets(per_source.withColumn("n_shards", n_shards)).withColumn("all_blocks", F.round(F.sum("target").over(everything) / block).cast("long"))
    seated = apportion(planned.withColumn("__one", F.lit(1)), "target", "all_blocks", ["__one"], ["source"], "blocks").drop("__one")
    by_source = seated.select(
        F.col("source").alias("__source"), "source_size", "target", "capped", "n_shards", "blocks"
    ).checkpoint()
    shards = (
        fine.join(_small(by_source), fine["__source"].eqNullSafe(by_source["__source"]))
        .select(by_source["__source"], "source_size", "target", "capped", "n_shards", "blocks", F.col("__fine").bitwiseAND(F.col("n_shards") - 1).alias("__shard"), "words")
        .groupBy("__source", "source_size", "target", "capped", "n_shards", "blocks", "__shard")
        .agg(F.sum("words").alias("shard_words"))
    )
    # a quota in blocks: whole passes, then some blocks from the first on
    held = F.ceil(F.col("shard_words") / block)
    quota = F.when(F.col("capped"), F.col("shard_words") * MAX_REPEATS).otherwise(F.least(F.col("shard_blocks") * block, F.col("shard_words") * MAX_REPEATS))
    rest = F.col("quota") - F.col("passes") * F.col("shard_words")
    quotas = (
        apportion(shards, "shard_words", "blocks", ["__source"], ["__shard"], "shard_blocks")
        .withColumn("held", held)
        .withColumn("quota", quota)
        .withColumn("passes", F.when(F.col("shard_words") > 0, F.expr("quota div shard_words")).otherwise(0))
        .withColumn("some", F.round(rest / block).cast("long"))
        .select(F.struct("source_size", "target", "passes", *run_of_blocks(F.col("held"), F.col("some"), block, F.lit(seed), F.col("__source"), F.col("__shard"))).alias(f"{own}quota"), F.col("__source").alias(f"{own}q_source"), F.col("__shard").alias(f"{own}q_shard"))
        .checkpoint()
    )
    ns = _small(by_source.select(F.col("__source").alias(f"{own}n_source"), F.col("n_shards").alias(f"{own}n")))
    order = Window.partitionBy(row_source, row_shard).orderBy(row_mix, F.col(key), "size")
    dealt = (
        rows.join(ns, F.col(row_source).eqNullSafe(F.col(f"{own}n_source")))
        .withColumn(row_shard, F.col(row_fine).bitwiseAND(F.col(f"{own}n") - 1))
        .withColumn(row_start, F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(_small(quotas), F.col(row_source).eqNullSafe(F.col(f"{own}q_source")) & (F.col(row_shard) == F.col(f"{own}q_shard")))
    )
    of = lambda name: F.col(f"{own}quota.{name}")
    part = words_in_run(F.col(row_start), F.col("size"), of("low"), of("high"), of("wrapped"))
    return dealt.withColumns({
        "source_size": of("source_size"),
        "target": of("target"),
        "taken": (of("passes") * F.col("size") + part).cast("long"),
        "copies": (of("passes") + F.when((F.col("size") > 0) & (2 * part >= F.col("size")), 1).otherwise(0)).cast("int"),
    }).select(*[F.col(f"`{c}`") for c in docs.columns], *OWN)


def _small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """A row for every whole copy that the mix takes."""
    nth = f"{free_prefix(mixed.columns)}nth"
    n: Column = F.sequence(F.lit(1), F.col("copies"))
    return mixed.where(F.col("copies") > 0).select("*", F.explode(n).alias(nth)).drop(nth, *OWN)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
