import math
from collections import defaultdict

import numpy as np
import pytest

from saltmarsh.llm import embeddings


def brute(rows, threshold=0.93):
    parent, links, by = list(range(len(rows))), [0] * len(rows), defaultdict(list)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, e, label) in enumerate(rows):
        if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            by[label, len(e)].append(i)
    for own in by.values():
        x = np.array([rows[i][1] for i in own])
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T, 1) >= threshold)):
            links[own[a]] += 1
            links[own[b]] += 1
            parent[root(own[a])] = root(own[b])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return [(r[0], n, least.get(root(i))) for i, (r, n) in enumerate(zip(rows, links))]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = []
    for c in range(40):  # clusters around the threshold, of many sizes
        centre = rng.normal(size=32)
        for _ in range(1 + c):
            out.append((len(out), [float(x) for x in np.float32(centre + rng.normal(size=32) * 0.02 * (c % 12))], c % 3))
    odd = [(5000 + i % 3, [1.0] * 32, 2) for i in range(50)] + [(None, [1.0] * 32, 2), (None, [2.0] * 32, 1)]
    odd += [(6000, None, 1), (6001, [0.0] * 32, 1), (6002, [float("nan")] * 32, 1), (6003, [1.0] * 32, None), (6004, [1.0] * 8, 2), (6005, [], 2), (6006, [None] + [1.0] * 31, 2), (6007, [float("inf")] * 32, 2)]
    return out + odd



@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(embeddings, "PART", block)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, n_links string").repartition(4)
    found = embeddings.near_vectors(df).collect()
    wanted = brute(rows)
    assert len(found) == len(rows)
    assert sum(r.n_links for r in found) >= 0.97 * sum(x[1] for x in wanted)
    # No link below the threshold: numbers of links never exceed the true ones.
    have, want = defaultdict(list), defaultdict(list)
    for r in found:
        have[r.vec_id].append(r.n_links)
        assert r.kept == (r.vec_id == r.component_id)
    for i, n, _ in wanted:
        want[i].append(n)
    assert have.keys() == want.keys() and all(a <= b for k in have for a, b in zip(sorted(have[k]), sorted(want[k])))
    assert sum((r.vec_id, r.component_id) in {(i, c) for i, _, c in wanted} for r in found) >= 0.97 * len(rows)


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + 0.05 * rng.normal(size=x.shape)
    y /= np.linalg.norm(y, axis=1)[:, None]
    r = embeddings.rotations(64, 6)
    assert np.allclose(r[:64] @ r[:64].T, np.eye(64))
    turned, other = (x @ r.T).reshape(200, 6, 64), (y @ r.T).reshape(200, 6, 64)
    factor = np.abs(turned).sum(axis=2) / 8
    estimate = ((np.sign(turned) * other).sum(axis=2) / 8 / factor).mean(axis=1)
    true = (x * y).sum(axis=1)
    assert abs((estimate - true).mean()) < 0.005
    spread = np.sqrt(((1 - factor**2) / factor**2).sum(axis=1)) / 6 * np.sqrt(1 - true**2) / math.sqrt(63)
    assert (np.abs(estimate - true) < embeddings.SIGMAS * spread).all()


def test_empty_and_bands(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
    bits, count = embeddings.bands(5000, 0.93)
    assert 1 - (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** count >= embeddings.RECALL


def test_sql_agrees(spark, rows):
    import duckdb

    some = [r for r in rows if r[0] is not None and r[0] < 300]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", some)
    wanted = sorted(con.execute(embeddings.OP3_SQL).fetchall())
    found = embeddings.near_vectors(spark.createDataFrame(some, "vec_id bigint, embedding array<float>, label int")).collect()
    assert sum(tuple(r) in set(wanted) for r in found) >= 0.97 * len(wanted) and sum(r.n_links for r in found) <= sum(w[1] for w in wanted)
