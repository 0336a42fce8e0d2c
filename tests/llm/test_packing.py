from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from isohyet.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def check(got, rows, tokenizer, most):
    """Every piece of every row, whole and gapless in its document and its sequence."""
    pieces, sequences = Counter(), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.piece, r.start, bytes(r.token_ids)] += 1
        assert len(r.token_ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), most)):
            want[i, n, at, ids[at : at + most].tobytes()] += 1
    assert pieces == want
    for spots in sequences.values():
        spots.sort()
        assert all(b == a + n for (a, n), (b, _) in zip(spots, spots[1:])) and spots[0][0] == 0 and sum(n for _, n in spots) <= most
    return sequences


@pytest.mark.parametrize("most", [2048, 64])
def test_round_trip(docs, rows, tokenizer, most):
    capacity = packing.Capacity(tokens=most, documents=most, attention=most * most)
    got = packing.pack(docs, capacity=capacity).collect()
    sequences = check(got, rows, tokenizer, most)
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // most) * 1.05 + 2


def test_general_tokenizer_path(docs, rows, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "_word_ends", lambda definition: None)
    ids = packing.Ids(Path(packing.default_tokenizer()).read_text(encoding="utf-8"))
    for (_, t, *_), data in zip(rows, ids.of([r[1] for r in rows]), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


HARD = ["don't you'll IT'S", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>.", "x.'s y.' z, ,, a.b 1.5, 12.", "é́. é, ́x", "ß. ﬁ! Ǆ? İ.", "word. next word. x\x85y\x1cz", "a.\x0bb!\x0cc", "日本語。 日本. 語!", "ǅ ΑΣ. ΑΣ"]


def test_hard_texts(tokenizer):
    ids = packing.Ids(Path(packing.default_tokenizer()).read_text(encoding="utf-8"))
    assert ids.ends is not None
    for t, data in zip(HARD, ids.of(HARD), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_every_capacity_holds():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 400, 500))[::-1]
    capacity = packing.Capacity(tokens=512, documents=3, attention=100_000 + 400 * 400)
    bins = packing.best_fit(lengths, capacity)
    for b in range(bins.max() + 1):
        own = lengths[bins == b].astype(float)
        assert own.sum() <= 512 and len(own) <= 3 and (own**2).sum() <= capacity.attention
    with pytest.raises(ValueError):
        packing.best_fit(np.array([600]), capacity)


def test_empty(empty):
    assert packing.pack(empty).count() == 0
