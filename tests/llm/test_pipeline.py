import importlib.util
import random

import pytest

from saltmarsh.llm.common import written
from tests.llm.test_pii import naive
from tests.llm.test_simhash import brute_components, brute_fingerprint, close
from tests.llm.test_tokens import check_packed

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline was taken out", allow_module_level=True)
import corpus_pipeline as P


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"document number {'abcdefghij'[i % 10]} {'klmnop'[i % 6]} says mail me{i}@x.example.com today", "en", "s", 40) for i in range(40)]
    rows += [(None, "same words in each row", None, None, None), (None, "same words in each row", "en", "s", 3), (50, None, "en", "s", 1), (51, "12 34", "en", "s", 1), (52, "", None, "s", 0), (53, rows[3][1], "de", "t", 9), (3, rows[3][1], "en", "s", 40)]
    more = [(*r, "own prediction", 0.5) for r in rows]
    return spark.createDataFrame(more, "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, score double")


def test_stages(spark, corpus):
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_dedup", "pii", "packing"] and P.ORACLE_SQL is None
    now = corpus
    seen = []
    for name, stage in P.STAGES:
        now = written(stage(spark, now, ""), f"test-{name}")
        seen.append([tuple(r) for r in now.collect()])
        if name != "packing":
            assert now.columns == corpus.columns
    start = [tuple(r) for r in corpus.collect()]
    kept = [r for r in start if r[1] and any(c.isalpha() for c in r[1])]
    filled = [(*r[:2], r[2] or "en", *r[3:]) for r in kept]
    assert sorted(map(str, seen[0])) == sorted(map(str, filled)), "a null lang is predicted, all else stays"
    kept = filled
    roots = brute_components([brute_fingerprint(r[1]) for r in kept], close)
    assert len(seen[1]) == len(set(roots)) and set(map(str, seen[1])) <= set(map(str, kept))
    assert len([r for r in seen[1] if r[0] is None]) == 1 and 53 not in [r[0] for r in seen[1]]
    assert len(seen[2]) == len(seen[1]) and not any(naive(r[1]) for r in seen[2]) and all(r[4] == len(r[1]) for r in seen[2])
    assert sum("<EMAIL>" in r[1] for r in seen[2]) == sum("@" in r[1] for r in seen[1])
    assert {r.doc_id for r in now.collect()} == {r[0] for r in seen[2]} and check_packed(now.collect(), 2048) == 1


def test_nothing_in_nothing_out(spark, corpus):
    now = corpus.limit(0)
    for name, stage in P.STAGES:
        now = written(stage(spark, now, ""), f"test-{name}")
        assert now.count() == 0


def test_texts_without_any_language_label(spark):
    df = spark.createDataFrame([(1, "some text", None, "s", 1), (2, "123", None, "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r.doc_id for r in P.STAGES[0][1](spark, df, "").collect()] == [1]


def test_language_stage_rejects_strangers(spark):
    rng = random.Random(2)
    greek = "".join(chr(0x3B1 + rng.randrange(24)) if rng.random() < 0.8 else " " for _ in range(2000))
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog", "en", "s", 1) for i in range(30)] + [(100, greek, None, "s", 1), (101, "Οκ", None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in P.STAGES[0][1](spark, df, "").collect()) == [*range(30), 101]
