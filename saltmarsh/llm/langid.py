"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import cached, pieces, shared_dir, with_fields, written

#: Components of a vector, letters of an n-gram.
DIMENSIONS, N = 1024, 3
#: n-gram vectors that a Python worker keeps (4 KB each); others are made again where they occur.
KEPT = 12_000
#: Characters that are turned into n-grams at once.
BLOCK = 1 << 20
UNKNOWN = "und"
#: Languages that are learned at most.
LANGUAGES = 1024
#: Four standard deviations of the cosine of unrelated vectors.
CHANCE = 4 / DIMENSIONS**0.5


@cached(4096, entry=False)
def letter_vector(code: int) -> np.ndarray:
    """The random vector of -1 and 1 of a character; 0 stands for any run of what is no letter."""
    return (np.random.Generator(np.random.PCG64([1_000_003, code])).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def ngram_vector(letters: tuple[int, ...]) -> np.ndarray:
    """Binds letter vectors, each rotated by its distance from the n-gram's end."""
    out = np.ones(DIMENSIONS, np.int8)
    for i, c in enumerate(reversed(letters)):
        out *= np.roll(letter_vector(c), i)
    return out


@cached(1, entry=False)
def letters() -> np.ndarray:
    """Which of the first 65536 code points are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)])


def symbols(text: str) -> Iterator[np.ndarray]:
    """Lower-case letters' code points with one 0 for each run of others (and at both ends), in blocks that
    overlap by N - 1."""
    table, carry = letters(), np.zeros(1, np.int64)
    for at in range(0, len(text), BLOCK):
        code = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le"), np.uint32).astype(np.int64)
        known = table[np.minimum(code, 65535)]
        far = np.flatnonzero(code > 65535)
        if len(far):
            known[far] = [unicodedata.category(chr(c))[0] == "L" for c in code[far].tolist()]
        code = np.where(known, code, 0)
        code = np.concatenate([carry, code, np.zeros(int(at + BLOCK >= len(text)), np.int64)])
        code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
        yield code
        carry = code[-(N - 1) :]


def codes(text: str) -> np.ndarray:
    """Codes of the text's n-grams, repeats included: 21 bits a letter."""
    out = []
    for s in symbols(text):
        if len(s) >= N and s.any():
            out.append(s[:-2] << 42 | s[1:-1] << 21 | s[2:])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Vectors:
    """n-gram vectors by code; the first KEPT stay."""

    def __init__(self) -> None:
        self.index: dict[int, int] = {}
        self.kept = np.zeros((0, DIMENSIONS), np.float32)

    @staticmethod
    def make(code: int) -> np.ndarray:
        return ngram_vector((code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF))

    def bundle(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors, each as often as it occurs."""
        get = self.index.get
        at = np.array([get(c, -1) for c in found.tolist()], np.int64)
        if (new := np.flatnonzero(at < 0)).size and len(self.index) < KEPT:
            new = new[: KEPT - len(self.index)]
            if len(self.kept) < len(self.index) + len(new):
                self.kept = np.concatenate([self.kept, np.zeros((min(KEPT, max(2048, 2 * len(self.index) + len(new))) - len(self.kept), DIMENSIONS), np.float32)])
            for i in new.tolist():
                at[i] = self.index[int(found[i])] = len(self.index)
                self.kept[at[i]] = self.make(int(found[i]))
        have = at >= 0
        out = counts[have].astype(np.float32) @ self.kept[at[have]]
        for c, n in zip(found[~have].tolist(), counts[~have].tolist()):
            out = out + n * self.make(c).astype(np.float32)
        return out


@cached(1)
def vectors() -> Vectors:
    return Vectors()


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and each one's bundle of all its documents' n-grams, of length 1.

    Covers all rows with a text and a language; of more than ``most`` languages, those of the most rows (the first by
    name on a tie). A task sends one vector for each of its languages; they are summed in the executors, and the driver
    gets one vector for each of ``most`` languages.
    """
    shared_dir(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (DIMENSIONS + 1)), pa.array(range(-1, DIMENSIONS), pa.int32()), pa.array(v)], ["lang", "i", "x"])
            total.clear()

        for b in pieces(batches, most=4 << 20):
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(codes(text))
            for lang, own in by.items():
                found, n = np.unique(np.concatenate(own), return_counts=True)
                if len(found):
                    bundle = np.concatenate([[len(own)], vectors().bundle(found, n).astype(np.float64)])
                    total[lang] = total.get(lang, 0) + bundle
            if len(total) > LANGUAGES:  # many labels in one task: their sums go on, and memory is bounded
                yield from sums()
        yield from sums()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sums = written(rows.mapInArrow(run, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x")), "language-sums")
    top = sums.where("i = -1").orderBy(F.desc("x"), "lang").limit(most).select("lang")
    own = sums.where("i >= 0").join(F.broadcast(top), "lang", "left_semi")  # most rows at most
    found = own.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    names = [r.lang for r in found]
    table = np.array([[x.x for x in r.v] for r in found], np.float64).reshape(len(names), DIMENSIONS)
    return names, table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)


def identify(
    docs: DataFrame, names: list[str], table: np.ndarray, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", clear: int | None = None
) -> DataFrame:
    """``docs`` with the prediction and its score in columns ``pred_col`` and ``score_col`` (which are replaced if the input
    has such columns; give free names to keep those).

    The prediction is the language whose profile has the greatest cosine with the text's bundle (the first by name
    on a tie), the score that cosine, 0 at least. Texts that are null or without a letter get ``und`` and 0,
    as do all texts if nothing was learned. With ``clear``, a text of at least that many different n-grams whose greatest
    cosine is within CHANCE of nothing gets ``und`` too: it is long enough to resemble its language, and resembles
    none that was learned. An empty table gives no rows.
    """
    shared_dir(docs.sparkSession)
    docs = docs.drop(pred_col, score_col)
    at = docs.columns.index(text_col)
    table = table.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            best, score = [], []
            for x in b.column(at):
                own = codes(x.as_py() or "")
                if not len(own) or not names:
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                found, n = np.unique(own, return_counts=True)
                v = vectors().bundle(found, n)
                cosine = table @ v / max(float(np.linalg.norm(v)), 1e-12)
                k = int(cosine.argmax())
                stranger = clear is not None and len(found) >= clear and cosine[k] < CHANCE
                best.append(UNKNOWN if stranger else names[k])
                score.append(min(1.0, max(0.0, float(cosine[k]))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, pred_col, score_col])

    return docs.mapInArrow(run, with_fields(docs.schema, f"`{pred_col}` string, `{score_col}` double"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, table = profiles(docs.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return identify(rows, names, table).select("doc_id", "held_out", "lang_pred", "score")
