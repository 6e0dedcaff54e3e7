from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from saltmarsh.llm import embeddings
from tests.llm.test_embeddings import brute


@pytest.fixture(scope="module")
def border():
    """Pairs whose cosine is just above the threshold, which bands miss now and then."""
    rng = np.random.default_rng(11)
    out = []
    for i in range(1500):
        a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        c = 0.9301 + 0.01 * rng.random()
        for v in (a, c * a + np.sqrt(1 - c * c) * b):
            out.append((len(out), [float(x) for x in np.float32(v)], i % 2))
    return out


@pytest.mark.parametrize("block", [1024, 300])
def test_no_link_of_a_small_label_is_missed(spark, border, block, monkeypatch):
    monkeypatch.setattr(embeddings, "PART", block)
    found = embeddings.near_vectors(spark.createDataFrame(border, "vec_id bigint, embedding array<float>, label int")).collect()
    wanted = brute(border)
    assert sum(n for _, n, _ in wanted) >= 3000
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in found) == Counter(wanted)


def test_large_labels_meet_in_bands(spark, border, monkeypatch):
    monkeypatch.setattr(embeddings, "WHOLE", 100)
    found = embeddings.near_vectors(spark.createDataFrame(border, "vec_id bigint, embedding array<float>, label int")).collect()
    wanted = sum(n for _, n, _ in brute(border))
    assert 0.999 * wanted <= sum(r.n_links for r in found) <= wanted


@pytest.mark.parametrize("whole, part", [(100, 4096), (100, 300), (1 << 14, 300)])
def test_no_link_is_missed_whatever_the_size(spark, border, whole, part, monkeypatch):
    """Labels that count as large are compared whole too: neither chances nor standard deviations choose the pairs."""
    for name, value in (("WHOLE", whole), ("PART", part), ("RECALL", 0.5), ("SIGMAS", 0.0)):
        monkeypatch.setattr(embeddings, name, value)
    df = spark.createDataFrame([*border, (9000, [1.0] * 8, 1), (9001, [1.0] * 7 + [1.1], 1)], "vec_id bigint, embedding array<float>, label int")
    found = embeddings.near_vectors(df)
    wanted = Counter([*brute(border), (9000, 1, 9000), (9001, 1, 9000)])
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == wanted


@pytest.mark.parametrize("dim", [2, 8, 31, 64, 300])
def test_bounds_let_no_similar_pair_escape(dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(300, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    vectors = np.concatenate([x, 0.9300001 * x + np.sqrt(1 - 0.9300001**2) * away])
    turned = vectors @ embeddings.rotations(dim, embeddings.turns_of(dim)).T
    factor = np.abs(turned).reshape(len(vectors), -1, dim).sum(axis=2) / np.sqrt(dim)
    raw, code, factors = ([r.tobytes() for r in m] for m in (vectors, np.packbits(turned > 0, axis=1), factor))
    number, zero = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    rows = pa.table({"cid": number, "n": zero + 1, "own": zero, "a": zero, "b": zero, "raw": raw, "code": code, "factors": factors})
    block = embeddings.Block(rows, 0.93, np.dtype("<f8"))
    block.compare(0, len(vectors))
    found = set(zip(np.concatenate(block.left).tolist(), np.concatenate(block.right).tolist()))
    unit = embeddings.unit_of(vectors)
    assert {(i, i + 300) for i in range(300)} <= found
    assert found == set(zip(*(x.tolist() for x in np.nonzero(np.triu(unit @ unit.T, 1) >= 0.93))))
