import random

import pytest

WORDS = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which".split()


@pytest.fixture(scope="session")
def texts():
    """Texts of many kinds: null, empty, blank, one word, repeated, very long, other scripts, odd bytes."""
    rng = random.Random(5)
    some = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    return [None, "", " ", "\n\t ", "word", "  two  spaces ", "ÀÉ ünï 中文 😀 x", "\x00\x1c\x85  end", "<|endoftext|> a<|endoftext|>", "12 3.4", *some, some[0], some[0], "long " * 40_000, "é" * 70_000]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with null and repeated ids, and further columns whose names could clash with those of the results."""
    rows = [(None if i in (5, 20) else 7 if i in (8, 9) else i, t, None if i % 7 == 0 else "en" if i % 2 else "de", "s", i, "x", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score double").repartition(3)


@pytest.fixture(scope="session")
def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]
