"""Every registered query of the training-data operators over a small folder of tables, against brute force or SQL."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from saltmarsh.llm import bpe, pii, queries
from tests.llm.conftest import WORDS
from tests.llm.test_models import brute_predictions, brute_scores
from tests.llm.test_pii import naive
from tests.llm.test_simhash import brute_components, brute_fingerprint, close
from tests.llm.test_tokens import check_packed


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80))) for _ in range(50)]
    texts += [f"write to u{i}@x{i}.example.org or +1 415 555 01{i:02d}, card 4111111111111111, host 10.0.0.{i}" for i in range(12)]
    texts += [None, "", " \n", "12 34", "É über 中文", texts[0], texts[0].upper(), "a " * 3000, "no. 4111111111111112 at 300.1.2.3", texts[1] + " more"]
    documents = [(i * 3, t, ["en", "de", None, "fr"][i % 4], "s", len(t or "")) for i, t in enumerate(texts)]
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    vectors = [[x + rng.gauss(0, 0.05 * (k % 6)) for x in base[k % 30]] for k in range(150)] + [None, [0.0] * 16]
    embeddings = [(i, None if v is None else [float(np.float32(x)) for x in v], None if i % 31 == 0 else i % 2) for i, v in enumerate(vectors)]
    pages = [(i, f"http://e.x/{i}", [None, "same", "", f"<p>{i}</p>" * 9][i % 4]) for i in range(40)]
    return documents, embeddings, pages


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    ddl = ("documents doc_id bigint, text string, lang string, source string, n_chars bigint", "embeddings vec_id bigint, embedding array<float>, label int", "pages page_id bigint, url string, html string")
    for rows, x in zip(tables, ddl):
        name, columns = x.split(" ", 1)
        spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.fixture(scope="module")
def run(spark, folder):
    return lambda name: queries.queries()[name](spark, folder).collect()


def test_all_are_registered():
    numbers = sorted(int(x[2:].split("_")[0]) for x in queries.queries())
    assert numbers == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for x in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE TABLE {x} AS SELECT * FROM read_parquet('{folder}/{x}.parquet/*.parquet')")
    wanted = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    found = queries.queries()[name](spark, folder).select(*columns).collect()
    assert Counter(map(tuple, found)) == Counter(wanted.fetchall())


def test_op1(run, tables):
    docs = tables[0]
    prints = [brute_fingerprint(t) for _, t, *_ in docs]
    roots = brute_components(prints, close)
    least = {r: min(d[0] for d, x in zip(docs, roots) if x == r) for r in roots}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run("op1_simhash")} == {(d[0], f"{p:016x}", least[r]) for d, p, r in zip(docs, prints, roots)}


def test_op5(run, tables):
    found = {r.doc_id: r for r in run("op5_pii")}
    assert len(found) == len(tables[0])
    for i, text, *_ in tables[0]:
        base = naive(text or "")
        kinds = [s.kind for s in base]
        names = ",".join(f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in base)
        r = found[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert not names or set(names.split(",")) <= set(r.spans.split(","))
        assert "4111111111111112" not in (text or "") or r.spans == ""


def test_op6(run, tables):
    found = {r.doc_id: r for r in run("op6_jpeg")}
    by_text = {}
    for i, text, *_ in tables[0]:
        raw, r = (text or "").encode(), found[i]
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes > 0 and len(r.media_sha256) == 64
        assert by_text.setdefault(text or "", tuple(r)[1:]) == tuple(r)[1:], "equal texts, equal values"


def test_op7_and_op8(run, tables):
    library = Tokenizer.from_file(bpe.vocabulary())
    pieces, encoded = run("op7_packing"), {r.doc_id: r for r in run("op8_bpe")}
    total = 0
    for i, text, *_ in tables[0]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        r = encoded[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        whole, start = np.array([*ids, 0], "<u4"), 0
        for n, p in enumerate(sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.piece)):
            assert p.piece == n and p.start == start and p.ids_crc32 == zlib.crc32(whole[start : start + p.length].tobytes())
            assert p.length == 2048 or n == 0
            start += p.length
        assert start == len(whole)
        total += start
    assert check_packed(pieces, 2048) <= total / 2048 + 1.5


def test_op9(run, tables):
    key = lambda x: x[0]
    wanted = sorted(brute_scores([d[:2] for d in tables[0]]), key=key)
    found = sorted((tuple(r)[:7] for r in run("op9_ppm")), key=key)
    assert [x[:5] for x in found] == [x[:5] for x in wanted]
    assert np.allclose([x[5:] for x in found], [x[5:] for x in wanted], atol=1e-7)


def test_op10(run, tables):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    wanted = sorted(brute_predictions([d[:3] for d in tables[0]], lambda i: not held(i), [d[:2] for d in tables[0]]))
    found = sorted((r.doc_id, r.held_out, r.lang_pred, r.score) for r in run("op10_langid"))
    assert [(i, p) for i, _, p, _ in found] == [x[:2] for x in wanted] and all(h == held(i) for i, h, *_ in found)
    assert np.allclose([x[3] for x in found], [x[2] for x in wanted], atol=1e-5)
