import hashlib
import string

from pyspark.sql import functions as F

from isohyet.llm import line_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first, order = {}, lambda i: (i is None, i or 0)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= least:
                first[k] = min(first.get(k, i), i, key=order)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(docs):
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return sorted(map(tuple, got.collect()), key=repr)


def test_by_brute_force(docs, rows):
    assert run(docs) == brute(rows)


def test_many_lines_and_null_ids(spark):
    shared = [f"a line that is number {i}" for i in range(200)]
    rows = [(None, "\n".join(shared[:150])), (9, "\n".join(shared)), (4, "\n".join(["x", *shared[70:140], "", "  " + shared[3].upper()])), (4, "x\n" + shared[199]), (9, "\n".join(shared))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, words int")
    assert run(df) == brute(rows)


def test_columns_and_empty(docs, empty):
    assert set(line_dedup.dedup_lines(docs).columns) == set(docs.columns) | {"n_lines", "n_dropped"}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_frequent_lines_are_salted_and_names_may_clash(spark, monkeypatch):
    """A line that every document holds fills its range; results are the same whatever the ranges and the way of the bitmaps."""
    rows = [(i % 90, f"line for all documents\nanother line for all\nown line number {i % 70}\nown line number {i % 90}") for i in range(400)] + [(None, "line for all documents")] * 40
    df = spark.createDataFrame([(i, t, "r", "d") for i, t in rows], "doc_id long, text string, __row string, `__ words` string")
    for ranges, bytes_ in ((1_000_000, 4 << 20), (20, 0)):
        monkeypatch.setattr(line_dedup, "ROWS_A_RANGE", ranges)
        monkeypatch.setattr(line_dedup, "broadcast_limit", lambda _, most=bytes_: most)
        assert run(df) == brute(rows)
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "__row", "__ words", "n_lines", "n_dropped"] and got.where("__row = 'r' and `__ words` = 'd'").count() == len(rows)
