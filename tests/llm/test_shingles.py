import importlib.util
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import common, shingles, simhash
from tests.llm.test_simhash import brute_components


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


@pytest.fixture(scope="module")
def near():
    """Copies with some words replaced, around the threshold, and lines that many texts share."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    licence, out = " ".join(word() for _ in range(20)), []
    for c in range(30):
        base = [word() for _ in range(rng.choice((6, 30, 100, 600)))]
        for _ in range(4):
            own = list(base)
            for at in rng.sample(range(len(own)), round(len(own) * rng.choice((0, 0.005, 0.01, 0.02, 0.03, 0.04)))):
                own[at] = word()
            out.append(" ".join(own) + (" " + licence if c % 2 else ""))
    return [(i, t) for i, t in enumerate(out)] + [(None, out[0].upper()), (500, None), (501, " "), (502, "a b"), (502, "a  b"), (503, "b a")]


@pytest.mark.parametrize("common", [1 << 18, 0])
def test_one_each_against_brute_force(spark, near, common, monkeypatch):
    monkeypatch.setattr(shingles, "COMMON", common)
    df = spark.createDataFrame([(*x, "k", (1,), 2) for x in near], "doc_id bigint, text string, saltmarsh_print string, `a b` struct<`c d`: int>, saltmarsh_row int").repartition(3)
    sets = [brute_set(t) for _, t in near]
    roots = brute_components(sets, alike)
    least = {}
    for (i, _), r in zip(near, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    found = simhash.one_each(df, 5, 0.8)
    assert found.columns == df.columns and sorted(r.doc_id for r in found.collect()) == sorted(least.values())
    assert 30 < len(least) < 100 and simhash.one_each(df.limit(0), 5, 0.8).count() == 0


def found_pairs(spark, near, similarity, classes, monkeypatch, block=1 << 20, held=1 << 20):
    monkeypatch.setattr(shingles, "BLOCK", block)
    h, n = np.unique(np.concatenate([shingles.shingles(t) for _, t in near]), return_counts=True)
    often, counts = h[n > 2], n[n > 2]
    batch = shingles.postings(np.arange(len(near)), classes, [t for _, t in near], 5, similarity, often, counts)
    df = spark.createDataFrame(pa.Table.from_batches([batch]).to_pandas(), shingles.POSTINGS)
    return {(r.a, r.b) for r in shingles.meeting(df, similarity).collect()}


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_all_similar_pairs_of_different_classes_meet(spark, near, block, monkeypatch):
    sets = [brute_set(t) for _, t in near]
    wanted = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and alike(sets[i], sets[j])}
    apart = found_pairs(spark, near, 0.8, np.arange(len(near)), monkeypatch, block)
    assert wanted <= apart and all(a < b for a, b in apart)
    classes = np.arange(len(near)) // 4
    between = found_pairs(spark, near, 0.8, classes, monkeypatch, block)
    assert {(a, b) for a, b in wanted if classes[a] != classes[b]} <= between and all(classes[a] != classes[b] for a, b in between)


def test_budgets_hold_for_sets_at_the_threshold():
    rng = np.random.default_rng(5)
    small, large = simhash.budgets(0.8)
    assert small[1] < 100 and large[1] < small[1]
    for both, more in ((4, 1), (8, 2), (16, 4), (40, 10), (400, 100), (9, 0)):
        for _ in range(40):
            own = rng.integers(0, 2**64, both + more, np.uint64)
            a, b = own[:both], own
            if more > 1:
                a, b = np.delete(own, slice(both, both + more // 2)), own[: both + more // 2]
            x, y = (np.array(simhash.wide_fingerprint(np.sort(s)), np.int64) for s in (a, b))
            differ = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
            assert differ <= (large if min(len(a), len(b)) >= 32 else small)[1]


def test_pigeonring_chain_is_complete(spark):
    """Every pair within the budget passes, and pairs beyond it don't."""
    rng = random.Random(2)
    rows = []
    for i in range(300):
        x = rng.getrandbits(256)
        y = x
        for bit in rng.sample(range(64 * rng.randint(0, 3), 256), rng.randint(0, 60) if i % 2 else rng.randint(60, 64)):
            y ^= 1 << bit
        words = lambda v: [w - (1 << 64) if w >> 63 else w for w in ((v >> 64 * k) & (1 << 64) - 1 for k in range(4))]
        rows.append((words(x), words(y), 100, 100, (x ^ y).bit_count()))
    df = spark.createDataFrame(rows, "prints_a array<bigint>, prints_b array<bigint>, size_a int, size_b int, bits int")
    budget = simhash.budgets(0.9)[1][1]
    found = df.select("bits", simhash._near(0.9).alias("near")).collect()
    assert all(r.near == (r.bits <= budget) for r in found) and 20 < sum(r.near for r in found) < 290


def test_rows_are_chosen_where_they_are(spark):
    rows = common.written(spark.range(0, 5000, 1, 7).selectExpr("id k", "cast(id as string) text").withColumn("row", F.monotonically_increasing_id()), "test")
    keep = rows.where("k % 3 = 1 AND k < 3000").select("row")
    found = common.chosen(rows, "row", keep, "test-keep")
    assert sorted(r.k for r in found.collect()) == list(range(1, 3000, 3)) and found.columns == rows.columns
    assert common.chosen(rows, "row", keep.limit(0), "test-keep").count() == 0
    table = common.ByRow(rows.selectExpr("row", "k * 2 value").where("row % 2 = 0"), "test-values")
    hit, value = table.find(np.array([0, 1, 2, 1 << 33, (1 << 33) + 1, 99 << 33]))
    first = {r.row: r.k for r in rows.collect()}
    assert hit.tolist() == [True, False, True, True, False, False] and value[[0, 2, 3]].tolist() == [2 * first[0], 2 * first[2], 2 * first[1 << 33]]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was taken out")
def test_stage_drops_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    other = [*words[:50], "x", *words[51:150], "y", *words[151:]]  # ten of 196 shingles differ: 186/206 = 0.90
    far = [w if i % 20 else "z" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, df, "").collect()) == [1, 3]


def test_sets_are_sent_once_not_once_a_pair(spark, monkeypatch):
    """60 texts that share 0.54 of their shingles, some of them near copies: 1,770 pairs to decide, of sets of 8 kB."""
    monkeypatch.setattr(shingles, "COMMON", 0)  # so that all meet
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared, texts = [word() for _ in range(700)], []
    for i in range(60):
        texts.append(" ".join([*texts[i - 1].split()[:-20], *(word() for _ in range(20))] if i % 3 == 2 else [*shared, *(word() for _ in range(300))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    context, option = spark.sparkContext._jsc.sc(), "spark.sql.autoBroadcastJoinThreshold"
    before, old = context.statusStore().executorSummary("driver").totalShuffleWrite(), spark.conf.get(option)
    spark.conf.set(option, "-1")
    try:
        assert sorted(r.doc_id for r in simhash.one_each(df, 5, 0.8).collect()) == [i for i in range(60) if i % 3 != 2]
    finally:
        spark.conf.set(option, old)
    context.listenerBus().waitUntilEmpty(30_000)
    assert 0 < context.statusStore().executorSummary("driver").totalShuffleWrite() - before < 4e6, "bytes sent"


def test_one_each_with_sets_in_parts(spark, near, monkeypatch):
    monkeypatch.setattr(simhash, "LOAD", 300)
    roots = brute_components([brute_set(t) for _, t in near], alike)
    least = {}
    for (i, _), r in zip(near, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    df = spark.createDataFrame(near, "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.one_each(df, 5, 0.8).collect()) == sorted(least.values())


def test_common_shingles_are_counted_on_all_texts(spark):
    """Of 48,000 texts, 100 shingles are in three, 100 in four and so on up to nine, the others in one."""
    text = F.expr("CASE WHEN id < 4200 THEN concat('a b c d ', id div 42, ' ', CASE WHEN id % 42 < 3 THEN 3 WHEN id % 42 < 7 THEN 4 WHEN id % 42 < 12 THEN 5 WHEN id % 42 < 18 THEN 6 WHEN id % 42 < 25 THEN 7 WHEN id % 42 < 33 THEN 8 ELSE 9 END) ELSE concat('x', id) END")
    texts = spark.range(0, 48_000, 1, 1).select(F.col("id").alias("row"), text.alias("text"))
    h, n = shingles.common(texts, 6)
    wanted = {int(shingles.shingles(f"a b c d {k} {m}", 6)[0]): m for k in range(100) for m in range(3, 10)}
    assert dict(zip(h.tolist(), n.tolist())) == wanted and sorted(h.tolist()) == h.tolist()
