"""The registered queries themselves on the smallest tables, against their SQL or by brute force, and clashing names."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from isohyet import llm
from isohyet.llm import language_id, mixing, packing, quality_rules
from tests.llm.test_mixing import brute_targets, size
from tests.oracle import connect, rows_of_duckdb, rows_of_spark

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    names, want = rows_of_duckdb(connect(SF_DIR), llm.oracle_sql()[name])
    got = llm.queries()[name](spark, SF_DIR)
    assert set(names) <= set(got.columns)
    assert rows_of_spark(got.select(*names)) == (names, want)


def test_packing_query(spark, documents):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in packing.op8_best_fit_packing(spark, SF_DIR).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d in documents:
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
        assert sorted(got[d.doc_id]) == want
    total = sum(x[2] for v in got.values() for x in v)
    for spots in sequences.values():
        spots.sort()
        assert spots[0][0] == 0 and all(b == a + n for (a, n), (b, _) in zip(spots, spots[1:])) and spots[-1][0] + spots[-1][1] <= 2048
    assert len(sequences) <= -(-total // 2048) + 2


def test_mixing_query(spark, documents):
    rows = {r.doc_id: r for r in mixing.op9_mix_sources(spark, SF_DIR).collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for d in documents:
        sizes[d.source] += size(d.text)
    want = brute_targets(sizes)
    for d in documents:
        r = rows[d.doc_id]
        assert (r["size"], r.source_size) == (size(d.text), sizes[d.source]) and r.target == pytest.approx(want[d.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[d.source] += r.taken
    assert len(rows) == len(documents) and all(abs(taken[s] - want[s]) <= 0.02 * want[s] + mixing.BLOCK_WORDS for s in sizes)
    assert rows_of_spark(mixing.op9_mix_sources(spark, SF_DIR)) == rows_of_spark(mixing.op9_mix_sources(spark, SF_DIR))


def test_columns_named_like_the_operators_own(spark, docs, rows):
    """Extra columns by the names that an operator uses itself change nothing."""
    few = docs.where("doc_id < 60").select("doc_id", "text", "lang")
    for own, run in (
        (("n_words", "fail_bits", "kept", "__key", "j", "m"), lambda d: quality_rules.apply_policy(quality_rules.ledger(d))),
        (("key", "bits", "place", "of", "rate", "lang_pred", "score"), lambda d: language_id.identify(d, language_id.fit(d))),
        (("key", "piece", "start", "length", "token_ids", "block", "sequence_id", "offset"), packing.pack),
    ):
        clashing = few.withColumns({c: F.lit("mine") for c in own})
        assert rows_of_spark(run(clashing)) == rows_of_spark(run(few))
