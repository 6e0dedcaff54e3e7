import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from saltmarsh.llm import langid, ppm


def brute_scores(docs):
    """The byte and word models by their definitions, one text at a time."""
    learned = [(t or "").encode().lower() for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    follow = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    words = Counter()
    for t in learned:
        s = b"\xff" * ppm.ORDER + t + b"\xff"
        for p in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                follow[k][s[p - k : p]][s[p]] += 1
        words.update([*t.split(), None])
    n, v, out = sum(words.values()), len(words), []
    for i, t in docs:
        t = (t or "").encode().lower()
        s, total = b"\xff" * ppm.ORDER + t + b"\xff", 0.0
        for p in range(ppm.ORDER, len(s)):
            out_of = set()
            for k in range(ppm.ORDER, -1, -1):
                c = follow[k].get(s[p - k : p])
                if c is None:
                    continue
                live = {a: b for a, b in c.items() if a not in out_of}
                size = sum(live.values()) + len(live)
                if s[p] in live:
                    total += math.log10(live[s[p]] / size)
                    break
                if live:
                    total += math.log10(len(live) / size)
                out_of = set(c)
            else:
                total -= math.log10(256 - len(out_of))
        tokens = [*t.split(), None]
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        out.append((i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, len(tokens), sum(words[x] > 0 for x in tokens), n, base, total))
    return out


@pytest.mark.parametrize(("chunk", "held"), [(8 << 20, ppm.HELD_ROWS), (1000, ppm.HELD_ROWS), (8 << 20, 2000), (1000, 0)])
def test_scores_against_the_definition(docs, plain, chunk, held, monkeypatch):
    """Also with models that outgrow what a worker holds: in part, and as a whole."""
    monkeypatch.setattr(ppm, "CHUNK_BYTES", chunk)
    few = docs.where("text IS NULL OR length(text) < 5000")
    wanted = brute_scores([(i, t) for i, t in plain if t is None or len(t) < 5000])
    key = lambda x: (str(x[0]), x[2], round(x[5], 6), round(x[6], 6))
    found = sorted((tuple(r) for r in ppm.scored(few, held_rows=held).collect()), key=key)
    wanted.sort(key=key)
    assert [x[:5] for x in found] == [x[:5] for x in wanted]
    assert np.allclose([x[5:] for x in found], [x[5:] for x in wanted], atol=1e-8)


def test_scores_of_nothing_and_of_nothing_learned(spark, docs):
    assert ppm.scored(docs.limit(0)).count() == 0
    (row,) = ppm.scored(spark.createDataFrame([(None, "ab")], "doc_id bigint, text string")).collect()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0 and math.isclose(row.score, -3 * math.log10(256))


def test_shards_of_a_model_that_does_not_fit(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(ppm, "HELD_ROWS", 25)
    code, uris, lows = np.arange(0, 200, 2), [], []
    for i in range(10):
        own = code[i * 10 : i * 10 + 10]
        pq.write_table(pa.table({"code": own, "v": own * 7}), tmp_path / f"{i}.parquet")
        uris.append(f"file://{tmp_path}/{i}.parquet")
        lows.append(int(own[0]))
    shards = ppm.Shards()
    for _ in range(2):
        hit, (v,) = shards.find(ppm.Files(tuple(uris), tuple(lows)), np.arange(200))
        assert (hit == (np.arange(200) % 2 == 0)).all() and (v[::2] == code * 7).all()
        assert shards.rows <= 25 and len(shards.held) <= 2


LANGUAGES = {"en": "the quick brown fox jumps over the lazy dog and runs away with it", "de": "der schnelle braune fuchs springt über den faulen hund und läuft davon", "fr": "le renard brun rapide saute par dessus le chien paresseux et s'en va"}


def test_languages(spark):
    rows = [(i, " ".join((t.split() * 2)[i % 7 : i % 7 + 9]), lang) for lang, t in LANGUAGES.items() for i in range(len(lang), 120, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    names, table = langid.profiles(df)
    assert names == ["de", "en", "fr"] and np.allclose(np.linalg.norm(table, axis=1), 1)
    found = langid.identify(df.select("doc_id", "text", "lang"), names, table).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found) and all(0 <= r.score <= 1 for r in found)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !? 3", "x"), (4, "der fuchs", "x"), (None, "𝔡𝔢𝔯", None)], "doc_id bigint, text string, score string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, names, table).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "de" and got[None] != "und"
    assert {r.lang_pred for r in langid.identify(odd, [], np.zeros((0, langid.DIMENSIONS))).collect()} == {"und"}
    assert langid.identify(odd.limit(0), names, table).count() == 0 and langid.profiles(df.limit(0))[0] == []


def test_blocks_and_caches_change_nothing(monkeypatch):
    text = "The end; über-all 123 naïve? " * 20
    wanted = Counter(langid.codes(text).tolist())
    bundle = langid.Vectors().bundle(*np.unique(langid.codes(text), return_counts=True))
    monkeypatch.setattr(langid, "BLOCK", 7)
    monkeypatch.setattr(langid, "KEPT", 5)
    assert Counter(langid.codes(text).tolist()) == wanted
    assert np.allclose(langid.Vectors().bundle(*np.unique(langid.codes(text), return_counts=True)), bundle)


def test_columns_of_the_whole_operator(docs, plain):
    names, table = langid.profiles(docs)
    found = langid.identify(docs, names, table)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"] and found.count() == len(plain)
    kept = langid.identify(docs, names, table, pred_col="p", score_col="q")
    assert kept.columns == [*docs.columns, "p", "q"] and {r.score for r in kept.collect()} == {1.0}


def brute_vector(text):
    """A text's bundle by the definition: letter vectors rotated by their place, bound and summed, trigram by trigram."""
    marks = [ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in text.lower()]
    line = [0]
    for m in [*marks, 0]:
        if m or line[-1]:
            line.append(m)
    total = np.zeros(langid.DIMENSIONS, np.int64)
    for i in range(len(line) - 2):
        if any(line[i : i + 3]):
            parts = [np.roll(langid.letter_vector(c).astype(np.int64), 2 - k) for k, c in enumerate(line[i : i + 3])]
            total += parts[0] * parts[1] * parts[2]
    return total


def brute_predictions(rows, learned, asked):
    sums = {}
    for i, text, lang in rows:
        if learned(i) and text is not None and lang is not None:
            sums[lang] = sums.get(lang, 0) + brute_vector(text)
    sums = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items()) if np.any(v)}
    out = []
    for i, text in asked:
        v = brute_vector(text or "")
        if not text or not any(unicodedata.category(c)[0] == "L" for c in text.lower()):
            out.append((i, "und", 0.0))
            continue
        cosine = {k: float(s @ v) / max(np.linalg.norm(v), 1e-12) for k, s in sums.items()}
        best = max(cosine, key=lambda k: (cosine[k], -list(cosine).index(k)))
        out.append((i, best, min(1.0, max(0.0, cosine[best]))))
    return out


def test_predictions_and_scores_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(t.split()) for _ in range(rng.randint(1, 12))) + rng.choice(["", "!", " 12 ", "Ünïcödé", " 𝔡 "]), lang) for i, (lang, t) in enumerate(list(LANGUAGES.items()) * 25)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 3", "fr"), (903, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    names, table = langid.profiles(df)
    found = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, names, table).collect())
    wanted = sorted(brute_predictions(rows, lambda i: True, [(i, t) for i, t, _ in rows]))
    assert [x[:2] for x in found] == [x[:2] for x in wanted] and np.allclose([x[2] for x in found], [x[2] for x in wanted], atol=1e-5)


def test_long_texts_of_no_learned_language_and_the_number_of_languages(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(t.split()) for _ in range(9)), lang) for lang, t in LANGUAGES.items() for i in range(30 + len(lang + t))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    names, table = langid.profiles(df)
    greek = "".join(chr(0x3B1 + rng.randrange(24)) if rng.random() < 0.8 else " " for _ in range(2000))
    texts = spark.createDataFrame([(1, greek), (2, greek[:20]), (3, rows[0][1])], "doc_id bigint, text string")
    assert [r.lang_pred for r in langid.identify(texts, names, table, clear=200).orderBy("doc_id").collect()][0] == "und"
    assert all(r.lang_pred != "und" for r in langid.identify(texts.where("doc_id > 1"), names, table, clear=200).collect())
    assert all(r.lang_pred != "und" for r in langid.identify(texts, names, table).collect())
    largest = max(LANGUAGES, key=lambda k: len(k + LANGUAGES[k]))
    assert langid.profiles(df, most=1)[0] == [largest]
