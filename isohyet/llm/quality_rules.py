"""Operator 2, quality rules: a ledger of failure bits and measurements, under versioned policies.

ledger() evaluates every rule once and stores one bit a rule beside the measurements; apply_policy() masks the
bits, so that a new policy version never reads a text again; ablations() counts by bitwise aggregation what each
rule alone, and each rule removed, would change. Everything is a Column expression over one row: no shuffle, and no
Python on executors.

Defined cases: null and empty texts have no words and fail the word minimum; repeated rows are judged each for
itself; a text of any length is read whole; an empty table gives an empty ledger; columns other than the key and
the text are left out of the ledger, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm.text import let, words

#: Rules in bit order: (a, x, b, y) fails a document where a * x > b * y, x and y being measurements, or 1 for None.
#: Only integers are compared, so engines can't differ.
RULES = {
    "few_words": (50, None, 1, "n_words"),
    "repeated_windows": (100, "n_repeat_words", 50, "n_words"),
    "short_words": (2, "n_words", 1, "word_chars"),
    "long_words": (1, "word_chars", 20, "n_words"),
    "symbols": (10, "n_symbols", 3, "n_words"),
    "duplicate_lines": (2, "n_dup_lines", 1, "n_lines"),
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


#: The production policy and an older, laxer one for comparison.
POLICY = Policy("2", tuple(RULES))
POLICY_1 = Policy("1", ("few_words", "repeated_windows"))


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found at least twice; w: the word array."""
    windows = lambda a: F.transform(
        F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2))
    )
    # Sorted primitive hashes tell cheaply whether any window repeats; most texts end there.
    repeats = lambda h: let(F.sort_array(h), lambda s: F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) == F.get(s, i - 1)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twin = lambda s: F.transform(
            F.filter(
                F.transform(s, lambda x, i: F.struct(
                    x["i"].alias("at"),
                    (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("twin"),
                )),
                lambda x: x["twin"],
            ),
            lambda x: x["at"],
        )
        shift = lambda p, d: F.transform(p, lambda x: x + d)
        return let(let(placed, twin), lambda p: F.size(F.array_union(F.array_union(p, shift(p, 1)), shift(p, 2))))

    many = lambda a: let(windows(a), lambda h: F.when(repeats(h), covered(h)).otherwise(0))
    return F.when(F.size(w) >= 4, many(w)).otherwise(0)


def measurements(text: Column) -> Column:
    """A struct of n_words, word_chars, n_repeat_words, n_lines, n_dup_lines and n_symbols (all long)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    ))
    by_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    ))
    n_symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    flat = lambda m: F.struct(*[m["w"][c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words")], *[m["l"][c].alias(c) for c in ("n_lines", "n_dup_lines")], m["n_symbols"].alias("n_symbols"))
    return let(F.struct(by_words.alias("w"), by_lines.alias("l"), n_symbols.alias("n_symbols")), flat)


def fail_bits(m: Column) -> Column:
    """The bits of the rules that a struct of measurements fails."""
    side = lambda factor, name: m[name] * factor if name else F.lit(factor)
    return sum((F.when(side(a, x) > side(b, y), BIT[name]).otherwise(0) for name, (a, x, b, y) in RULES.items()), F.lit(0))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measurements, fail_bits): every rule evaluated once for every document."""
    judged = let(measurements(F.col(text)), lambda m: F.struct(m.alias("m"), fail_bits(m).alias("fail_bits")))
    return docs.select(F.col(key).alias("__key"), judged.alias("j")).select(F.col("__key").alias(key), "j.m.*", "j.fail_bits")


def keep_documents(docs: DataFrame, policy: Policy = POLICY, text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, judged where they are scanned."""
    return docs.where(let(measurements(F.col(text)), fail_bits).bitwiseAND(policy.mask) == 0)


def apply_policy(entries: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Adds kept and policy_version to a ledger."""
    return entries.withColumns({"kept": F.col("fail_bits").bitwiseAND(policy.mask) == 0, "policy_version": F.lit(policy.version)})


def ablations(entries: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """(rule, failed, failed_alone, kept_without): one pass of bitwise aggregation over a ledger."""
    masked = F.col("fail_bits").bitwiseAND(policy.mask)
    aggregates = []
    for name in policy.rules:
        aggregates += [
            F.count_if(masked.bitwiseAND(BIT[name]) != 0).alias(f"{name}_failed"),
            F.count_if(masked == BIT[name]).alias(f"{name}_alone"),
            F.count_if(masked.bitwiseAND(policy.mask & ~BIT[name]) == 0).alias(f"{name}_without"),
        ]
    row = entries.agg(*aggregates)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"{n}_failed").alias("failed"), F.col(f"{n}_alone").alias("failed_alone"), F.col(f"{n}_without").alias("kept_without"))
        for n in policy.rules
    ])).alias("r")).select("r.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(BASE) != 0).alias("base_failed"), "kept", "fail_bits",
    )


_WS = r"[\x20\x09-\x0D]"
_FAILS = " + ".join(f"CASE WHEN {a} * {x or 1} > {b} * {y or 1} THEN {BIT[name]} ELSE 0 END" for name, (a, x, b, y) in RULES.items())
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rn, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (
  SELECT rn, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT rn, i FROM grams QUALIFY count(*) OVER (PARTITION BY rn, g) >= 2),
spots AS (SELECT DISTINCT rn, i + k AS at FROM twice, (VALUES (0), (1), (2)) AS o(k)),
rep AS (SELECT rn, count(*) AS n FROM spots GROUP BY rn),
lines AS (
  SELECT rn, count(*) AS n, count(DISTINCT line) AS nd
  FROM (SELECT rn, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rn),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '{_WS}', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_lines,
         coalesce(lines.n - lines.nd, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (rn) LEFT JOIN lines USING (rn)),
b AS (SELECT *, ({_FAILS})::INTEGER AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE}) <> 0 AS base_failed,
       (fail_bits & {POLICY.mask}) = 0 AS kept, fail_bits
FROM b
"""
