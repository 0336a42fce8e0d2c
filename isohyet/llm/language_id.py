"""Operator 6, language identification: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge regression.

k(x, y) averages, over byte n-grams of 1 to 4, the number of n-grams present in both over the root of the numbers in
each: a cosine of presence sets, so that text length drops out. n-grams are hashed to fixed widths. Landmarks, an equal share
of every language's sample, span the Nystroem space; one ridge regression for each language is solved there. The training sample
is bounded: about TRAIN_A_LANGUAGE documents of each language, drawn by their hash. Executors turn it into sets of fixed size and sum its
moments in the Nystroem space; only landmarks and moments reach the driver, some 150 KB a landmark. No language is left out,
however many there are. As the kernel is linear in presence features, landmarks and weights fold into one matrix, and a batch is
scored by one matrix product.

Defined cases: a null text, or one without a letter, is 'und' with score 0; lang, source and doc_id of the document to
judge are no inputs of its prediction; repeated rows are judged alike; texts of any length are read whole; of languages with equal
values the first in order of name is predicted; with nothing to learn from, every text is 'und'; a null doc_id is never learnt from
nor held out; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.session import shared_dir, ship_package

#: Bits of the hashed presence set for byte n-grams of 1, 2, 3 and 4.
WIDTHS = (8, 12, 14, 14)
#: Bound of the training sample: documents expected for each language.
TRAIN_A_LANGUAGE = 300
#: Landmarks in all; with more languages than that, one for each.
LANDMARKS = 256
#: Tables of languages of up to this many rows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 50_000
#: Rows of the sample that one task sums, and the fixed point of the sums: integers add up alike in any order.
ROWS_A_SUM, FIXED = 2_048, 2.0**24
RIDGE = 1e-3
#: Softness of the score: larger is sharper.
SHARPNESS = 8.0
HELD_OUT_OF = 5
BATCH = 64

_OFFSETS = np.cumsum([0, *(1 << w for w in WIDTHS)])
_SIZE = int(_OFFSETS[-1])


def presence(text: str) -> np.ndarray:
    """Booleans: which hashed n-grams of the lower-cased text occur, n = 1 to 4 in turn."""
    out = np.zeros(_SIZE, bool)
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    code = np.zeros(len(raw), np.uint32)
    for n, width in enumerate(WIDTHS, 1):
        if len(raw) < n:
            break
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        place = code if n == 1 else (code * np.uint32(2_654_435_761)) >> np.uint32(32 - width)
        out[_OFFSETS[n - 1] + place.astype(np.intp)] = True
    return out


def features(sets: np.ndarray) -> np.ndarray:
    """Presence sets scaled so that an inner product of two rows is the blended kernel."""
    x = sets.astype(np.float32)
    for n in range(len(WIDTHS)):
        part = x[:, _OFFSETS[n] : _OFFSETS[n + 1]]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(WIDTHS))
    return x


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [np.packbits(presence(t)).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(packed, pa.binary())], ["lang", "bits"])


def _unpacked(bits: pa.Array) -> np.ndarray:
    return features(np.array([np.unpackbits(np.frombuffer(x, np.uint8), count=_SIZE) for x in bits.to_pylist()], bool).reshape(-1, _SIZE))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, folded weights, intercepts), learnt from documents outside the held-out fold whose lang is given.

    One-versus-rest kernel ridge regressions in the Nystroem space of the landmarks; a language counts as much as any other.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared_dir(spark)
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    usable = rows.where((F.crc32("key") % HELD_OUT_OF != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # each document by its own hash, at a rate that leaves about TRAIN_A_LANGUAGE of a language; equal sets count once
    rates = usable.groupBy(F.col("lang").alias("of")).agg(F.least(F.lit(1.0), TRAIN_A_LANGUAGE / F.count(F.lit(1))).alias("rate")).checkpoint()
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    place = F.pmod(F.xxhash64(F.lit("train"), "key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = usable.withColumn("place", place).join(rates, F.col("lang") == F.col("of")).where(F.col("place") < F.col("rate"))
    sample = chosen.select("text", "lang").mapInArrow(_sets, "lang string, bits binary").distinct().checkpoint()
    held = {r[0]: r[1] for r in sample.groupBy("lang").count().collect()}
    names, n = sorted(held), sum(held.values())
    if not names:
        return [], np.zeros((_SIZE, 0), np.float32), np.zeros(0)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("bits"), "bits"))
    share = max(1, LANDMARKS // len(names))
    got = sample.withColumn("nth", nth).where(F.col("nth") <= share).orderBy("lang", "nth").select("bits").toArrow()
    marks = _unpacked(got.column("bits").combine_chunks())
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    use = values > 1e-8 * values.max()
    whiten = vectors[:, use] / np.sqrt(values[use])
    size = whiten.shape[1]
    at = {name: i for i, name in enumerate(names)}
    weight = np.array([n / len(names) / held[name] for name in names])
    shared = spark.sparkContext.broadcast((marks, whiten))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows 0 to size - 1: the weighted second moments; row size + i: the sum over language i."""
        marked, white = shared.value
        total = np.zeros((size + len(names), size))
        for big in batches:
            for start in range(0, big.num_rows, BATCH):
                b = big.slice(start, BATCH)
                phi = (_unpacked(b.column("bits")) @ marked.T).astype(float) @ white
                own = np.array([at[x] for x in b.column("lang").to_pylist()])
                total[:size] += phi.T @ (weight[own][:, None] * phi)
                np.add.at(total, size + own, phi)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.rint(total[i, j] * FIXED).astype(np.int64))], ["i", "j", "x"])

    # the same rows in the same order for the same sample, so that reruns agree
    ordered = sample.repartition(-(-n // ROWS_A_SUM), "bits").sortWithinPartitions("bits", "lang")
    summed = ordered.mapInArrow(moments, "i long, j long, x long").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros((size + len(names), size))
    total[np.asarray(summed.column("i")), np.asarray(summed.column("j"))] = np.asarray(summed.column("x")) / FIXED
    shared.unpersist()
    second, by_language = total[:size], total[size:] * weight[:, None]
    # the weights of all rows sum to n; a language's target is 1 on its own rows and -1 on others
    phi_mean, y_mean = by_language.sum(0) / n, 2 / len(names) - 1
    cross = 2 * by_language.T - by_language.sum(0)[:, None] - n * phi_mean[:, None] * y_mean
    solved = np.linalg.solve(second - n * np.outer(phi_mean, phi_mean) + RIDGE * n * np.eye(size), cross)
    return names, (marks.T @ (whiten @ solved).astype(np.float32)), y_mean - phi_mean @ solved


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row; score is the softmax of the regressions' values."""
    ship_package(docs.sparkSession)
    names, weights, intercepts = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a column a language, of fixed length
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            live = [i for i, t in enumerate(texts) if names and has_letter(t)]
            for at in range(0, len(live), BATCH):
                some = live[at : at + BATCH]
                value = features(np.array([presence(texts[i]) for i in some])) @ folded + intercepts
                soft = np.exp(SHARPNESS * (value - value.max(1, keepdims=True)))
                top = value.argmax(1)
                for i, j, p in zip(some, top, soft[np.arange(len(some)), top] / soft.sum(1), strict=True):
                    pred[i], score[i] = names[j], p
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["key", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF == 0, F.lit(False))
    return identify(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
