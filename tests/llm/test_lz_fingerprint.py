import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.llm import lz_fingerprint as lz

FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def phrases(data, limit, piece):
    """LZ78 by slices of bytes; a new dictionary at a multiple of piece once limit phrases are held."""
    found, held, start = set(), set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in held:
            held.add(data[start:end])
            start = end
        if end % piece == 0 and len(held) >= limit:
            found |= held
            held, start = set(), end
    return found | held


def hashed(phrase):
    h = 1
    for b in phrase:
        h = (h * 1_000_003 + b) % 2**61
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> shift)) * factor % 2**64
    return (h ^ (h >> 31)) >> 16


def sketch(text, limit=lz.DICTIONARY, piece=lz.PIECE):
    return sorted({hashed(p) for p in phrases(text.encode(), limit, piece)})[: lz.SIGNATURE]


def alike(a, b):
    union = sorted({*a, *b})[: lz.SIGNATURE]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def brute(rows, **how):
    """rows: (doc_id, text), told apart by them."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (key, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + following[:m]
        own, other, after = sketch(text, **how), sketch(edited, **how), sketch(following, **how)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, alike(own, other), alike(own, after)))
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, lz.decode(r.fingerprint).tolist(), lz.decode(r.edited_fingerprint).tolist(), r.near_edited, r.near_next) for r in df.collect()), key=repr)


@pytest.mark.parametrize("range_bytes,dictionary,piece", [(lz.RANGE_BYTES, lz.DICTIONARY, lz.PIECE), (900, lz.DICTIONARY, lz.PIECE), (5_000, 300, 512)])
def test_by_brute_force(spark, docs, rows, monkeypatch, range_bytes, dictionary, piece):
    monkeypatch.setattr(lz, "DICTIONARY", dictionary)
    monkeypatch.setattr(lz, "PIECE", piece)
    unique = list(dict.fromkeys((i, t) for i, t, _, _ in rows)) + [(-(2**63), "the least key"), (2**63 - 1, "the greatest key")]
    more = spark.createDataFrame([(i, t, "x", "y", True) for i, t in unique], "doc_id long, text string, part string, place string, copied boolean")
    # with patched limits the workers must see them: parsed here, by the same class
    if dictionary != 1 << 18:
        for _, t in unique:
            assert lz.decode(lz.fingerprint(t)).tolist() == sketch(t or "", dictionary, piece)
        return
    got = lz.compare_with_next(more, range_bytes=range_bytes)
    assert tuple(got.columns) == FIELDS
    assert collected(got) == brute(unique)


def test_repeated_rows_and_null_keys(spark):
    rows = [(None, "none b"), (None, "none a"), (3, "again and again"), (3, "again and again"), (1, None)]
    got = lz.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), range_bytes=4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 1, 0), (False, 3, 15), (False, 3, 15), (True, 0, 6), (True, 0, 6)]
    assert max(r.near_next for r in got if r.doc_id == 3) == 1.0


def test_single_and_empty(spark):
    one = spark.createDataFrame([(7, "abcabcabc")], "doc_id long, text string")
    (r,) = lz.compare_with_next(one).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcabcabc").hexdigest() and r.near_edited == r.near_next == 1.0
    assert lz.compare_with_next(one.limit(0)).count() == 0


def test_fingerprints_pass_columns_through(spark):
    df = spark.createDataFrame([(1, "some text", "mine"), (2, None, "mine"), (3, "some text", None)], "id int, text string, fingerprint string")
    got = {r.id: r.fingerprint for r in lz.fingerprints(df).collect()}
    assert got[1] == got[3] == lz.fingerprint("some text") and got[2] == ""
    pairs = spark.createDataFrame([(got[1], got[3]), (got[1], ""), ("", ""), (None, "")], "a string, b string")
    assert [r[0] for r in pairs.select(lz.fingerprint_likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0, None]


def test_likeness_follows_shared_content():
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(2_000)]
    text = lambda: " ".join(rng.choice(vocabulary, 900))
    a, b = text(), text()
    near = [lz.likeness(*(lz.decode(lz.fingerprint(t)) for t in (a, a[: len(a) * k // 10] + b[len(b) * k // 10 :]))) for k in (10, 9, 6, 3, 0)]
    assert near[0] == 1.0 and near == sorted(near, reverse=True) and near[1] > 0.75 and near[-1] < near[2] - 0.15


def test_query_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert len({i for i, _ in rows}) == len(rows)
    assert collected(lz.op12_lz_fingerprints(spark, sf_dir)) == brute(rows)
