import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, word string, shard string, kept string, bucket string"


def _rows():
    rng = random.Random(5)
    vocabulary = {"en": ["the", "and", "thing", "water", "stone", "house", "river"], "de": ["der", "und", "wasser", "haus", "nicht", "größe"], "fr": ["le", "et", "eau", "maison", "rivière", "été"]}
    rows = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        lines = [" ".join(rng.choices(vocabulary[lang], k=rng.randint(3, 14))) + "." for _ in range(rng.randint(1, 9))]
        if i % 4 == 0:
            lines.insert(0, "  A Shared LINE of some length ")
        rows.append((i, "\n".join(lines), lang, None if i % 9 == 0 else f"src{i % 5}"))
    base = [w + str(i % 50) for i, w in enumerate(rng.choices(vocabulary["en"], k=200))]
    rows.append((100, " ".join(base), "en", "src0"))
    for k in range(12):  # near copies with more and more edits
        words = list(base)
        for at in rng.sample(range(200), k):
            words[at] = f"edit{k}x{at}"
        rows.append((101 + k, " ".join(words), "en", "src0"))
    rows += [(200 + i, rows[1][1], "de", "src1") for i in range(8)]  # equal texts
    rows += [(300, None, "en", "src0"), (301, "", None, "src1"), (302, " \t\n ", "en", None), (303, "one", "en", "src2"), (304, "one two", "en", "src2"), (305, "one two", "en", "src2")]
    rows += [(306, "12 34 ?! \n12 34 ?!", "en", "src3"), (307, "stone water " * 6000, "en", "src3"), (308, "### $$$ %%% <| " * 20, "en", "src3"), (309, "İstanbul ÀÉ ÅNGSTRÖM \U0001f600 e\u0301 \u3000x", "de", "src3")]
    rows += [(310, "the same row\nthe same row\nthe same row", "en", "src4")] * 3  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with nulls, empty and long texts, copies, repeated rows and columns of clashing names."""
    return spark.createDataFrame([(i, t, lang, s, 0, "x", "x", "x", "x", "x") for i, t, lang, s in rows], DOCS).repartition(3).checkpoint() if spark.sparkContext.getCheckpointDir() else _first(spark, rows)


def _first(spark, rows):
    from isohyet.session import shared_dir

    shared_dir(spark)
    return spark.createDataFrame([(i, t, lang, s, 0, "x", "x", "x", "x", "x") for i, t, lang, s in rows], DOCS).repartition(3).checkpoint()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
