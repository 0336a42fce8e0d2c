import random
import zlib

import numpy as np

from isohyet.llm import language_id


def test_held_out_accuracy_and_und(docs, rows):
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (300, 301, 302, 306, 308):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    held = [i for i, *_ in rows[:60] if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(by[i].lang_pred == rows[i][2] for i in held)
    assert held and right >= 0.9 * len(held)


def test_inputs_are_the_text_alone(docs, spark):
    model = language_id.fit(docs)
    a = language_id.identify(docs, model)
    b = language_id.identify(docs.selectExpr("doc_id", "text", "'zz' lang", "'s' source"), model)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_nothing_to_learn_or_judge(docs, empty):
    none = language_id.fit(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert none[0] == [] and {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(empty, language_id.fit(docs)).count() == 0
    assert language_id.fit(empty)[0] == []


def _kernel(a, b):
    """The blended kernel of two texts by its definition, over hashed n-grams."""
    total = 0.0
    for n in range(len(language_id.WIDTHS)):
        span = slice(language_id._OFFSETS[n], language_id._OFFSETS[n + 1])
        x, y = (set(np.flatnonzero(language_id.presence(t)[span])) for t in (a, b))
        total += len(x & y) / max(1, len(x) * len(y)) ** 0.5 / len(language_id.WIDTHS)
    return total


def test_by_plain_kernel_ridge(docs, rows):
    """With every text of the sample a landmark, the regressions are exact: dual kernel ridge with weights and intercepts."""
    learnt, seen = [], set()
    for i, t, lang, _ in rows:
        if lang is not None and t is not None and any(map(str.isalpha, t)) and zlib.crc32(str(i).encode()) % 5:
            bits = (lang, language_id.presence(t).tobytes())
            if bits not in seen:
                seen.add(bits)
                learnt.append((t, lang))
    names = sorted({lang for _, lang in learnt})
    n, held = len(learnt), {x: sum(lang == x for _, lang in learnt) for x in names}
    assert n <= language_id.LANDMARKS // len(names) * min(len(names), 3)
    k = np.array([[_kernel(a, b) for b, _ in learnt] for a, _ in learnt])
    w = np.array([n / len(names) / held[lang] for _, lang in learnt])
    y = np.array([[1.0 if lang == x else -1.0 for x in names] for _, lang in learnt])
    left = np.block([[w[:, None] * k + language_id.RIDGE * n * np.eye(n), w[:, None]], [(w @ k)[None, :], np.array([[w.sum()]])]])
    solved = np.linalg.solve(left, np.vstack([w[:, None] * y, w @ y]))
    probes = [t for _, t, *_ in rows if t and any(map(str.isalpha, t))][:20]
    plain = np.array([[_kernel(p, t) for t, _ in learnt] for p in probes]) @ solved[:-1] + solved[-1]
    got_names, weights, intercepts = language_id.fit(docs)
    ours = language_id.features(np.array([language_id.presence(p) for p in probes])) @ weights + intercepts
    assert got_names == names
    assert np.abs(ours - plain).max() < 2e-3


def test_many_languages(spark):
    """More languages than landmarks: none is left out, and each can be predicted."""
    def text(i, k):
        rng = random.Random(1000 * i)
        vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(12)]
        return " ".join(random.Random(k).choices(vocabulary, k=30))

    rows = [(10 * i + k, text(i, k), f"lang{i:03d}") for i in range(300) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df, model).collect()}
    assert len(model[0]) == 300 and set(got.values()) == set(model[0])
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[i] == lang for i, _, lang in held) >= 0.95 * len(held)


def test_query(spark):
    """The query's own columns on the smallest tables: the fold by crc32 of the id's text, und, accuracy."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in language_id.op6_language_id(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == {d.doc_id for d in docs}
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (d.text is None or not any(map(str.isalpha, d.text)))
    judged = [d for d in docs if got[d.doc_id].held_out and d.lang is not None and got[d.doc_id].lang_pred != "und"]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in judged) >= 0.9 * len(judged)
