import re
from collections import Counter

from isohyet.llm import quality_rules as q


def measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    spots = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    m = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(spots), None: 1}
    bits = sum(q.BIT[n] for n, (a, x, b, y) in q.RULES.items() if a * m[x] > b * m[y])
    return m, bits


def test_ledger_by_brute_force(docs, rows):
    got = sorted(tuple(r) for r in q.ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "fail_bits").collect())
    want = []
    for i, t, *_ in rows:
        m, bits = measure(t)
        want.append((i, *[m[k] for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")], bits))
    assert got == sorted(want)


def test_policies_and_ablations(docs, rows):
    entries = q.ledger(docs)
    bits = [measure(t)[1] for _, t, *_ in rows]
    kept = q.apply_policy(entries, q.POLICY_1).where("kept").count()
    assert kept == sum(b & q.POLICY_1.mask == 0 for b in bits)
    for r in q.ablations(entries).collect():
        bit, mask = q.BIT[r.rule], q.POLICY.mask
        assert (r.failed, r.failed_alone, r.kept_without) == (sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), sum(b & mask & ~bit == 0 for b in bits))


def test_filter_keeps_columns_and_rows(docs, rows, empty):
    kept = q.keep_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(measure(t)[1] & q.POLICY.mask == 0 for _, t, *_ in rows)
    assert q.ledger(empty).count() == 0 and q.keep_documents(empty).count() == 0
