"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token exactly one vocabulary token can be the last of its encoding: the one that
is a suffix of the prefix and compatible with the last token of what precedes it. A suffix-matching
automaton of the vocabulary lists the suffixes, pair tests undo merges to see whether two neighbours would
have merged across their border, and back-pointers give the ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import cached, pieces, shared_dir

#: Entries of each generation of a cache; a cache keeps two.
CACHE = 250_000
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Recent:
    """A bounded cache of two generations: what is found in the old one moves to the young one."""

    def __init__(self, most: int = CACHE) -> None:
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """A byte-level BPE vocabulary file of the tokenizers library, read for encoding and decoding."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        plain = lambda s: bytes(chars[c] for c in s)
        vocab = {plain(k): v for k, v in spec["model"]["vocab"].items() if all(c in chars for c in k)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # Inside, a token is numbered by when it can arise: the bytes first, then the merges in their order.
        order = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.whole: dict[tuple[int, int], int] = {}
        for a, b in ((plain(a), plain(b)) for a, b in merges):
            pair = (order[a], order[b])
            if a + b not in order:
                order[a + b] = len(self.halves)
                self.halves.append(pair)
            self.whole.setdefault(pair, order[a + b])
        self.id_of = {n: vocab[k] for k, n in order.items() if k in vocab}
        self.automaton = ahocorasick.Automaton()
        for k, n in order.items():
            if k in vocab:
                self.automaton.add_word(k.decode("latin-1"), (len(k), n))
        self.automaton.make_automaton()
        self.units, self.words = Recent(), Recent()
        self.pairs: dict[int, bool] = {}
        self.find = regex.compile(SPLIT).findall

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes gives just these two: undoes the later merge of the two
        at their border, step by step, and looks for an earlier merge across it."""
        whole, halves = self.whole, self.halves
        limit = 1 << 60
        while True:
            if whole.get((left, right), limit) < limit:
                return False
            if left > right:
                if left < 256:
                    return True
                limit, left = left, halves[left][1]
            else:
                if right < 256:
                    return left < 256 or self._left_only(left, right, right + 1)
                limit, right = right + 1, halves[right][0]

    def _left_only(self, left: int, right: int, limit: int) -> bool:
        while left >= 256:
            limit, left = left, self.halves[left][1]
            if self.whole.get((left, right), limit) < limit:
                return False
        return True

    def word(self, text: str) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit integers."""
        raw = text.encode().decode("latin-1")
        last, pairs = [-1] * (len(raw) + 1), self.pairs
        for end, (n, token) in self.automaton.iter(raw):
            end += 1
            if last[end] >= 0:
                continue
            before = end - n
            if before:
                prior = last[before]
                key = prior << 24 | token
                good = pairs.get(key)
                if good is None:
                    if len(pairs) >= CACHE:
                        pairs.clear()
                    good = pairs[key] = prior >= 0 and self.compatible(prior, token)
                if not good:
                    continue
            last[end] = token
        at, out, halves = len(raw), [], self.lengths
        while at:
            out.append(last[at])
            at -= halves[last[at]]
        return np.array([self.id_of[x] for x in reversed(out)], "<u4").tobytes()

    @property
    def lengths(self) -> list[int]:
        found = self.__dict__.get("_lengths")
        if found is None:
            found = self.__dict__["_lengths"] = []
            for n, (a, b) in enumerate(self.halves):
                found.append(1 if n < 256 else found[a] + found[b])
        return found

    def unit(self, text: str) -> bytes:
        """Ids of a stretch that starts and ends where pre-tokens do."""
        words, out = self.words, []
        for w in self.find(text):
            ids = words.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) < 64:
                    words.put(w, ids)
            out.append(ids)
        return b"".join(out)

    def ordinary(self, text: str) -> bytes:
        """Ids of a text without special tokens. A space before a character that is no white space always
        starts a pre-token, so the stretches between such spaces are looked up whole."""
        parts = text.split(" ")
        if any(not x or x[0].isspace() for x in parts[1:]):
            return self.unit(text)
        out = list(map(self.units.young.get, parts))
        out[0] = self.unit(parts[0])
        if None in out:
            self.fill(parts, out)
        return b"".join(out)

    def fill(self, parts: list[str], out: list[bytes | None]) -> None:
        """Sets the ids of the stretches that aren't in the young cache."""
        units = self.units
        for i, ids in enumerate(out):
            if ids is None:
                x = parts[i]
                ids = units.get(x)
                if ids is None:
                    ids = self.unit(" " + x)
                    if len(x) < 64:
                        units.put(x, ids)
                out[i] = ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, special tokens in the text included."""
        text = text or ""
        if self.cut is None or "<" not in text:
            return self.ordinary(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.ordinary(text[at : m.start()]), np.array([self.special[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.ordinary(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text of such ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cached(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<bigint>) for every row: null and empty texts have no ids; rows of null or repeated
    id stay as they are; an empty table gives no rows; other columns are not read."""
    shared_dir(docs.sparkSession)
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids = [np.frombuffer(encoder(path).encode(x.as_py()), "<u4").astype(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids array<bigint>")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of what encoded() returns; null ids give an empty text."""
    shared_dir(tokens.sparkSession)
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            text = [encoder(path).decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded in one pass."""
    shared_dir(docs.sparkSession)
    path = path or vocabulary()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in pieces(batches):
            n, first, second = [], [], []
            for x in b.column(1):
                ids = own.encode(x.as_py())
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names)

    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return columns.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
