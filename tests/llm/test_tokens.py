import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from saltmarsh.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary())


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


ATOMS = ["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "ß", "'s", "'ll", "ing", "!!", "#", "12", "٣", "中", "😀", "<|endoftext|>", "<|", "　", "​", " the", "\r", "\x00", "Th", "er", "zz", "qq"]


def test_ids_and_texts_are_the_library_s(library):
    rng = random.Random(1)
    both = bpe.Encoder(bpe.vocabulary()), packing.LibraryEncoder(bpe.vocabulary())
    texts = ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 255), rng.randint(0, 0x3000), rng.randint(97, 122), 32])) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [" ".join("".join(rng.choice("etaoinshrdlu.,") for _ in range(rng.randint(1, 9))) for _ in range(200)) for _ in range(30)]
    for text in texts:
        wanted = library.encode(text, add_special_tokens=False).ids
        for own in both:
            assert ids(own.encode(text)) == wanted, text
        assert both[0].decode(own.encode(text)) == library.decode(wanted, skip_special_tokens=False)
    assert ids(both[0].encode(None)) == [] and ids(both[0].encode("a" * 50_000)) == library.encode("a" * 50_000, add_special_tokens=False).ids


def test_small_caches_change_nothing(library, monkeypatch):
    own = packing.LibraryEncoder(bpe.vocabulary())
    own.units, own.words = bpe.Recent(3), bpe.Recent(2)
    monkeypatch.setattr(bpe, "CACHE", 5)
    text = "one two three four five one two three. one, two seven one"
    for _ in range(3):
        assert ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_columns(spark, docs, plain, library):
    wanted = []
    for i, t in plain:
        x = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(x, "<u4").tobytes()
        wanted.append((i, len(x), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((tuple(r) for r in bpe.digests(docs).collect()), key=str) == sorted(wanted, key=str)
    encoded = bpe.encoded(docs)
    assert sorted(map(str, ((r.doc_id, r.text) for r in bpe.decoded(encoded).collect()))) == sorted(map(str, ((i, t or "") for i, t in plain)))
    assert bpe.digests(docs.limit(0)).count() == 0 and bpe.decoded(encoded.limit(0)).count() == 0


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_sequences(docs, plain, library):
    rows = packing.pack_documents(docs, capacity=64).collect()
    wanted = []
    for i, t in plain:
        x = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(x) % 64 or 64
        for piece, start in enumerate([0, *range(first, len(x), 64)]):
            end = first if piece == 0 else start + 64
            wanted.append((i, piece, start, end - start, zlib.crc32(np.array(x[start:end], "<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(wanted, key=str)
    assert check_packed(rows, 64) >= math.ceil(sum(r.length for r in rows) / 64)
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "fan"), [(1 << 18, 64), (50, 3), (20, 2)])
def test_packing_is_tight_over_many_rounds(spark, monkeypatch, block, fan):
    monkeypatch.setattr(packing, "BLOCK", block)
    monkeypatch.setattr(packing, "FAN", fan)
    rng = random.Random(2)
    sizes = [min(2048, int(rng.lognormvariate(6.3, 1)) + 1) for _ in range(3000)]
    items = packing.written(spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, length bigint").repartition(5), "test-items")
    rows = packing.packed(items).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(sizes))
    bound = math.ceil(sum(sizes) / 2048)
    assert check_packed(rows, 2048) <= bound * (1.01 if block > 1000 else 1.08) + 1


def test_best_fit():
    sizes = np.array([5, 7, 3, 2, 10, 1])
    bins, at, loads = packing.best_fit(sizes, 10)
    assert sorted(loads.tolist()) == [8, 10, 10] and len(bins) == 6
    for k in range(len(loads)):
        own = sorted((a, s) for a, s, b in zip(at, sizes, bins) if b == k)
        assert [a for a, _ in own] == [sum(s for _, s in own[:i]) for i in range(len(own))]


def test_packing_keeps_columns_of_any_name(spark):
    names = ["bin", "at", "seq", "into", "shift", "up", "packing_bin", "packing_seq", "a b"]
    rows = [(i, 1 + i * 37 % 900, *range(9)) for i in range(400)]
    items = packing.written(spark.createDataFrame(rows, "doc_id bigint, length bigint, " + ", ".join(f"`{n}` int" for n in names)).repartition(4), "test-items")
    found = packing.packed(items)
    assert found.columns == [*items.columns, "sequence_id", "offset"]
    assert sorted(tuple(r)[:11] for r in found.collect()) == sorted(rows) and check_packed(found.collect(), 2048) <= sum(r[1] for r in rows) / 2048 + 2
    again = packing.packed(packing.written(found, "test-items"))
    assert again.columns == found.columns and again.count() == 400
