import random
import re
import subprocess
import sys
import time

import numpy as np
import pytest

from saltmarsh.llm import pii
from saltmarsh.llm.pii import KINDS, Span


def naive(text):
    out = [Span(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(Span(m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(Span(m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m.group())) <= 15:
            out.append(Span(m.start(), 3, m.end()))
    return sorted(out)


PIECES = [*"aB1234567890@@..--++() _%é\n", "4111111111111111", "a@b.c", "1.2.3.4", "+1 (415) 555-0100", "255.", "000", "x@y", "@x.y"]


def test_patterns_against_plain_regular_expressions():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == naive(text), text


def test_patterns_are_linear():
    began = time.perf_counter()
    for text in ("a" * 500_000 + "@", "1" * 300_000, "+1" * 100_000, "@" * 100_000, "a@" * 100_000, "1." * 150_000, "a.b-" * 100_000):
        pii.base_spans(text)
    assert time.perf_counter() - began < 20


TEXTS = [
    f"write to user{i}@mail{i % 7}.example.com or call +1 ({200 + i % 700}) 555-{1000 + i} from 10.{i % 250}.3.4 with card 4111111111111111 about item {i} of {i * 7919 % 10**9}" for i in range(300)
]


@pytest.fixture(scope="module")
def weights(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None, "", "no sign"])], "doc_id bigint, text string")
    return pii.trained(df)


def test_repeats_take_the_label_of_their_match(weights):
    text = "Call +1 (407) 555-7710 now. Much later in the text: (407) 555-7710 again. In 2024 we had 17 of 3,000."
    ((base, spans),) = pii.found([text], weights)
    assert [text[s.start : s.end] for s in base] == ["+1 (407) 555-7710"]
    assert [(KINDS[s.kind], text[s.start : s.end]) for s in spans if s not in base] == [("phone", "(407) 555-7710")]
    clean = ["In 2020 there were 17 of 3,000", "v1.2 of 12 parts, 99%", ""]
    assert list(pii.found(clean, weights)) == [([], [])] * 3


def test_numbers_that_fail_their_check_are_not_added(weights):
    for bad in ("4111111111111112", "1234 5678 9012 3456", "10.20.30.400", "6011 0009 9013 9425"):
        text = f"card {bad} and once more {bad}."
        ((base, spans),) = pii.found([text], weights)
        assert base == spans == [], bad
    ((base, spans),) = pii.found(["pay 4111111111111111 4111111111111111 now, with 4111111111111111."], weights)
    assert len(base) == 1 and [s.kind for s in spans] == [2] * len(spans) and spans[0].start == 4, "a valid card twice in a row is no match"


def test_chain_and_skip_potentials_decide(weights):
    """What the field finds in these texts goes when its chain, or its skip potentials, are set to zero."""
    zero = np.zeros((pii.LABELS, pii.LABELS))
    text = "Call +1 4075557710 now. Much later in the text: 4075557710 again."
    count = lambda w, t=text: sum(len(spans) - len(base) for base, spans in pii.found([t], w))
    assert count(weights) == 1 and count(weights._replace(skip=zero)) == 0
    strong = weights._replace(chain=np.eye(pii.LABELS) * 4, skip=zero, unary=weights.unary * 0)
    joined = "me@x.org 4075557710 and nothing else"
    assert count(strong, joined) == 1 and count(strong._replace(chain=zero), joined) == 0


def test_documents_are_solved_alike_in_any_company(weights, monkeypatch):
    wanted = [list(pii.found([t], weights))[0] for t in TEXTS[:40]]
    assert list(pii.found(TEXTS[:40], weights)) == wanted
    monkeypatch.setattr(pii, "SOLVED", 7)
    assert list(pii.found(TEXTS[:40], weights)) == wanted


def test_sample_is_bounded_and_the_same_for_tied_ids(spark, monkeypatch):
    rows = [(None, t) for t in TEXTS[:60]] * 3
    monkeypatch.setattr(pii, "TRAIN_DOCS", 20)
    monkeypatch.setattr(pii, "TRAIN_TOKENS", 200)
    one = pii.trained(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    two = pii.trained(spark.createDataFrame(rows[::-1], "doc_id bigint, text string").repartition(2))
    assert all(np.array_equal(x, y) for x, y in zip(one, two)) and np.abs(one.unary).sum() > 0


MEMORY = """
import resource, random, numpy as np
from saltmarsh.llm import pii
w = pii.Weights(np.random.default_rng(1).normal(size=(pii.SLOTS, 5)), np.eye(5), np.eye(5) * 2)
list(pii.found(["a@b.co 12"], w))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rng = random.Random(1)
text = " ".join(str(rng.randrange(10**9, 10**10)) for _ in range(1_900_000))
assert len(text) > 20_000_000
list(pii.found([text, "4111111111111111"], w))
print(before >> 10, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


def test_twenty_megabytes_of_digits_take_less_than_a_gigabyte():
    run = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True)
    before, most = map(int, run.stdout.split())
    assert most < 1000, (before, most)


def exact_posteriors(data, weights):
    """Sums over all labellings."""
    n = len(data.fixed)
    own = weights.unary[data.slots].sum(axis=1)
    total = np.zeros((n, pii.LABELS))
    for y in np.ndindex(*[pii.LABELS] * n):
        if any(f >= 0 and f != v for f, v in zip(data.fixed, y)):
            continue
        s = sum(own[i, v] for i, v in enumerate(y)) + sum(weights.chain[y[a], y[b]] for a, b in data.chain) + sum(weights.skip[y[a], y[b]] for a, b in data.skip)
        for i, v in enumerate(y):
            total[i, v] += np.exp(s)
    return total / total.sum(axis=1, keepdims=True)


def test_message_passing_is_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(4)
    skip = rng.normal(size=(5, 5))
    w = pii.Weights(rng.normal(size=(pii.SLOTS, 5)), rng.normal(size=(5, 5)), (skip + skip.T) / 2)
    slots = rng.integers(0, pii.SLOTS, (5, 3))
    tree = pii.Joined(slots, np.array([-1, -1, 2, -1, -1]), np.array([[0, 1], [1, 2]]), np.array([[1, 3], [3, 4]]))
    assert np.allclose(pii.posteriors(tree, w), exact_posteriors(tree, w), atol=1e-4)
    weak = pii.Weights(w.unary, w.chain * 0.3, w.skip * 0.3)
    loop = pii.Joined(slots, np.array([-1] * 5), np.array([[0, 1], [1, 2], [2, 3], [3, 4]]), np.array([[0, 4], [1, 3]]))
    assert np.abs(pii.posteriors(loop, weak) - exact_posteriors(loop, weak)).max() < 0.05


def test_find_and_redact(spark, docs, plain, weights):
    found = pii.find(docs, weights).collect()
    assert sorted(map(str, ((r.doc_id, [(s.start, s.end) for s in r.base]) for r in found))) == sorted(map(str, ((i, [(s.start, s.end) for s in naive(t or "")]) for i, t in plain)))
    df = spark.createDataFrame([(1, "to a@b.co, 10.0.0.1", "k"), (None, None, "k"), (2, "é 4111 1111 1111 1111!", None)], "doc_id bigint, text string, base string")
    assert sorted(map(str, (tuple(r) for r in pii.redact(df, weights).collect()))) == sorted(map(str, [(1, "to <EMAIL>, <IP>", "k"), (None, None, "k"), (2, "é <CARD>!", None)]))
    assert pii.find(docs.limit(0), weights).count() == 0 and pii.redact(docs.limit(0), weights).count() == 0
    assert pii.redacted_text("abcdefgh", [Span(1, 0, 4), Span(3, 2, 6)]) == "a<EMAIL>gh"
    pii.trained(docs.limit(0))
