from collections import Counter

import corpus_pipeline
from tests.llm.test_line_dedup import LOWER
from tests.llm.test_mixing import brute_targets, size
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_quality_rules import measure


def test_stages_by_brute_force(spark, docs, rows, tmp_path):
    """Each stage on what the last one kept, against a plain version."""
    now, kept = docs, [(i, t, lang, s) for i, t, lang, s in rows if measure(t)[1] == 0]
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, "")
        if at < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(at)))
        got = spark.read.parquet(str(tmp_path / str(at)))
        if at == 1:
            first = {}
            key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            for i, t, *_ in sorted(kept):
                for line in t.split("\n"):
                    first.setdefault(key(line), i)
            kept = [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i), lang, s) for i, t, lang, s in kept]
        if at == 2:
            stay = {r[0] for r in near_brute(kept, 5, 80) if r[3]}
            kept = [r for r in kept if r[0] in stay]
        if at < 3:
            assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], r[1]) for r in kept), name
        if at == 3:
            copies = Counter(r.doc_id for r in got.collect())
            sizes = Counter()
            for _, t, _, s in kept:
                sizes[s] += size(t)
            want, taken = brute_targets(sizes), Counter()
            for i, t, _, s in kept:
                taken[s] += copies[i] * size(t)
            longest = max(size(t) for _, t, *_ in kept)
            assert set(copies.values()) <= {1, 2} and all(abs(taken[s] - want[s]) <= longest for s in sizes)
            kept = [(i, t, lang, s) for i, t, lang, s in kept for _ in range(copies[i])]
        now = got
    starts = Counter(r.doc_id for r in now.collect() if r.piece == 0)
    assert starts == Counter(r[0] for r in kept)


def test_registered_and_empty(spark, empty, tmp_path):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
