"""Operator 12, document fingerprints: Lempel-Ziv phrases, their hashes' least as a signature, likeness of signatures.

A text's UTF-8 bytes are parsed as in LZ78: a phrase is the shortest piece that the dictionary doesn't hold yet. A phrase is known by its
rolling hash, so that the dictionary is one set of integers; the SIGNATURE least of the mixed hashes are the fingerprint, and the share
of the least hashes of two texts' union that both hold estimates the likeness of their phrase sets, as a shared dictionary would shorten
one text given the other. A text of fewer phrases is compared in full. The dictionary starts anew once it holds DICTIONARY
phrases, so that memory stays bounded on texts of any length; the signature covers all phrases of all dictionaries.

`fingerprints` adds the fingerprint to any table, without a shuffle. `compare_with_next` takes documents in descending order of their
keys: documents are dealt to ranges of that order, each range's last document is given a copy of the next range's first, and a task walks
its range holding one document at a time. An edit shares the parse of what it leaves unchanged.

Defined cases: a null text is empty, an empty text has an empty fingerprint; two empty fingerprints have likeness 1, an empty one and
another 0; equal texts have equal fingerprints; the next of the last document is the first, of a single one itself; rows of equal
keys go by the hash of their texts, null keys come last; repeated rows are neighbours; texts of any length are read whole; an empty table gives an
empty result; extra columns are ignored by `compare_with_next` and pass through `fingerprints`, but for one named like its result, which gives way.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.session import shared_dir, ship_package

#: Hashes that a fingerprint holds: a likeness of j has a standard error of the root of j (1 - j) / SIGNATURE.
SIGNATURE = 128
#: Phrases that a dictionary holds before a new one is begun (some 30 MB), looked at every PIECE bytes of a text.
DICTIONARY, PIECE = 1 << 18, 1 << 16
#: Bytes of text that a range of documents aims at.
RANGE_BYTES = 32 << 20
_FACTOR, _MASK = 1_000_003, (1 << 61) - 1


def _mixed(phrases: set[int]) -> np.ndarray:
    """48 well mixed bits of every phrase's hash."""
    x = np.fromiter(phrases, np.uint64, len(phrases))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(16)


def _least(values: np.ndarray) -> np.ndarray:
    return np.unique(np.partition(values, SIGNATURE - 1)[:SIGNATURE] if len(values) > 4 * SIGNATURE else values)[:SIGNATURE]


class Parse:
    """The state of a parse: a text may be fed in pieces, and a copy may go on with another text."""

    def __init__(self) -> None:
        self.phrases: set[int] = set()
        self.hash, self.at, self.kept = 1, 0, np.zeros(0, np.uint64)

    def copy(self) -> Parse:
        other = Parse()
        other.phrases, other.hash, other.at, other.kept = self.phrases.copy(), self.hash, self.at, self.kept
        return other

    def feed(self, data: bytes) -> Parse:
        start = 0
        while start < len(data):
            # pieces end at fixed places of the text, however it is fed
            end = start + PIECE - self.at % PIECE
            part = data[start:end]
            phrases, add, h = self.phrases, self.phrases.add, self.hash
            for b in part:
                h = (h * _FACTOR + b) & _MASK
                if h not in phrases:
                    add(h)
                    h = 1
            self.hash, self.at, start = h, self.at + len(part), end
            if self.at % PIECE == 0 and len(phrases) >= DICTIONARY:
                self.kept, self.phrases, self.hash = self.signature(), set(), 1
        return self

    def signature(self) -> np.ndarray:
        """The least mixed hashes of all phrases so far, in order."""
        return _least(np.concatenate([self.kept, _mixed(self.phrases)]))


def encode(signature: np.ndarray) -> str:
    """Six bytes a hash, in base64."""
    return base64.b64encode(signature.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the least hashes of the union that both signatures hold."""
    if not len(a) and not len(b):
        return 1.0
    union, n = np.unique(np.concatenate([a, b]), return_counts=True)
    return float(np.mean(n[:SIGNATURE] == 2))


def fingerprint(text: str | None) -> str:
    return encode(Parse().feed((text or "").encode()).signature())


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column fingerprint."""
    ship_package(docs.sparkSession)

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py()) for t in texts], pa.string())

    return docs.withColumn("fingerprint", of(F.col(text)))


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """Likeness of two columns of fingerprints; null where either is."""

    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if p is None or q is None else likeness(decode(p), decode(q)) for p, q in pairs], pa.float64())

    return of(a, b)


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


class _Document:
    """A document with the parse of what an edit leaves unchanged, and its signature."""

    def __init__(self, key: int | None, text: str):
        self.key, self.n = key, len(text)
        self.cut = self.n - self.n // 3
        self.head = text[: self.cut].encode()
        self.parse = Parse().feed(self.head)
        self.signature = self.parse.copy().feed(text[self.cut :].encode()).signature()

    def row(self, following: _Document, text: str) -> dict:
        """The result's row, given the next document and its text; called once, as it uses up the parse."""
        tail = text[: self.n - self.cut].encode()
        edited = self.parse.feed(tail).signature()
        return {
            "doc_id": self.key, "n_chars": self.n, "edited_sha256": hashlib.sha256(self.head + tail).hexdigest(), "fingerprint": encode(self.signature), "edited_fingerprint": encode(edited),
            "near_edited": likeness(self.signature, edited), "near_next": likeness(self.signature, following.signature),
        }


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order, after them the first of the next range, marked as a copy."""
    last, done, ended = None, [], False
    for big in batches:
        for at in range(0, big.num_rows, 64):
            b = big.slice(at, 64)
            for key, text, copied in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("copied").to_pylist(), strict=True):
                if ended or (copied and last is None):
                    continue
                here = _Document(key, text)
                if last is not None:
                    done.append(last.row(here, text))
                last, ended = here, bool(copied)
            if len(done) >= 256:
                yield pa.RecordBatch.from_pylist(done, schema=_SCHEMA)
                done = []
    yield pa.RecordBatch.from_pylist(done, schema=_SCHEMA)


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs.

    The edited text has the last third of its code points replaced by the first as many of the next document, in descending order of key.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared_dir(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # descending keys as ascending numbers that no key overflows
    rows = rows.select("*", F.col("key").isNull().alias("none"), F.coalesce(F.bitwise_not("key"), F.lit(0)).alias("down"), F.xxhash64("text").alias("hash"))
    order = ["none", "down", "hash"]
    narrow = rows.select(*order, F.octet_length("text").cast("long").alias("bytes")).checkpoint()
    n, held = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-held // range_bytes))))
    firsts = narrow.repartitionByRange(parts, *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)).alias("first")).collect()
    bounds = sorted(tuple(r.first) for r in firsts)

    @F.arrow_udf("array<int>")
    def places(none: pa.Array, down: pa.Array, hashed: pa.Array) -> pa.Array:
        """Twice the row's range, and of a range's first row twice the range before and one."""
        out = []
        for row in zip(none.to_pylist(), down.to_pylist(), hashed.to_pylist(), strict=True):
            at = bisect_right(bounds, row) - 1
            out.append([2 * at, 2 * ((at - 1) % len(bounds)) + 1] if row == bounds[at] else [2 * at])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = rows.withColumn("place", F.explode(places(*order))).select("key", "text", *order, F.expr("place div 2").cast("int").alias("part"), (F.col("place") % 2 == 1).alias("copied"))
    laid = dealt.repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("copied", *order)
    return laid.select("key", "text", "copied").mapInArrow(_walk, COMPARED).withColumnRenamed("doc_id", key)


def op12_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
