"""Sets of word shingles, which near-duplicate texts are compared by, and the pairs of texts that share rare ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from saltmarsh.llm.common import pieces

#: Common shingles that are known to the workers at most, and the texts that make a shingle common.
COMMON, OFTEN = 1 << 18, 3
#: Shingles that a task counts at a time.
COUNTED = 1 << 21
#: Pairs that are held before they are sent on.
HELD = 1 << 20
#: Texts that may share a key; those of a more common shingle are divided.
BLOCK = 1 << 20
#: Allowance for rounding in comparisons of whole numbers with multiples of the similarity.
EPS = 1e-9


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only, as in simhash


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted hashes of a text's distinct word shingles; of one shorter than a shingle, that of all its words."""
    return shingles_of(tokens_of(text), words, seed)


def shingles_of(tokens: list[bytes], words: int = 5, seed: int = 42) -> np.ndarray:
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = [x + i for i, x in enumerate(accumulate(map(len, tokens)))]
    starts = [0, *(x + 1 for x in ends)]
    ends = ends[words - 1 :] or ends[-1:]
    own = (joined[a:b] for a, b in zip(starts, ends))
    return np.unique(np.fromiter(map(xxh64_intdigest, own, repeat(seed)), np.uint64, len(ends)))


def prefix(own: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, by rarity and then hash: two sets of at least this similarity share one of them,
    whatever the order is, if it is the same for all sets."""
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.argsort(np.where(common[at] == own, counts[at], 0), kind="stable")]
    return own[: len(own) - math.ceil(similarity * len(own) - EPS) + 1]


def common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that many of all texts of a table (row, text) hold, and at least how many hold them. They
    only set the order in which a set's shingles are taken, in which any order is right. A task counts COUNTED shingles at
    a time and sends on those that it meets twice, so most, which are rare, are never shuffled."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in pieces(batches):
            for x in b.column(0).to_pylist():
                held.append(shingles(x, words))
                size += len(held[-1])
                if size >= COUNTED:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    often = texts.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    top = often.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


POSTINGS = "key bigint, row bigint, class bigint, size_place bigint, before int"


def postings(rows: np.ndarray, classes: np.ndarray, texts: list[str], words: int, similarity: float, often: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each shingle of the texts' prefixes: its hash, the text's row number and class, the set's size (upper
    half) and the shingle's place, and the lower half of the shingle before it. A shingle that more than BLOCK texts may
    hold has a key for each two parts of them."""
    keys, owner, sizes, places, before = ([] for _ in range(5))
    for i, x in enumerate(texts):
        s = shingles(x, words)
        if not len(s):
            continue
        own = prefix(s, similarity, often, counts)
        place, last = np.arange(len(own)), np.concatenate([own[:1], own[:-1]])
        if len(often):
            at = np.minimum(np.searchsorted(often, own), len(often) - 1)
            parts = np.where(often[at] == own, -(-counts[at] // BLOCK), 1)
            if (parts > 1).any():
                mine = xxh64_intdigest(int(rows[i]).to_bytes(8, "little", signed=True)) % parts.astype(np.uint64)
                wide = np.repeat(np.arange(len(own)), parts)
                other = np.arange(len(wide)) - np.repeat(np.cumsum(parts) - parts, parts)
                low, high = np.minimum(mine[wide], other.astype(np.uint64)), np.maximum(mine[wide], other.astype(np.uint64))
                split = (low * np.uint64(1 << 20) + high) * np.uint64(0x9E3779B97F4A7C15)
                own, place, last = own[wide] ^ np.where(parts[wide] > 1, split, np.uint64(0)), place[wide], last[wide]
        keys.append(own.view(np.int64))
        owner.append(np.full(len(own), i))
        sizes.append(np.full(len(own), len(s), np.int64))
        places.append(place)
        before.append(last)
    join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
    at = join(owner, np.int64)
    packed = join(sizes, np.int64) << 32 | join(places, np.int64)
    columns = [join(keys, np.int64), rows[at], classes[at], packed, join(before, np.uint64).astype(np.uint32).view(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "row", "class", "size_place", "before"])


def meeting(found: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: the pairs of rows of different classes whose prefixes meet and whose sizes and places don't rule them
    out. Pairs are formed only between classes, so a large group that is one class already sends none."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, row, group, packed, before = (t.column(c).to_numpy() for c in ("key", "row", "class", "size_place", "before"))
        size, place = packed >> 32, packed & 0xFFFFFFFF
        step = np.flatnonzero((key[1:] != key[:-1]) | (group[1:] != group[:-1])) + 1
        runs = np.searchsorted(step, np.arange(len(key)), side="right")
        bounds = np.append(step, len(key))
        first = bounds[runs]  # where the next class, or the next key, begins
        change = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        last = change[np.searchsorted(change, np.arange(len(key)), side="right")]
        many = last - first
        done = np.concatenate([[0], np.cumsum(many)])
        at, held = 0, []
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(done, done[at] + HELD, side="right")) - 1)
            n = many[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]
            at = to
            # Sets whose shingles before this one are the same have met there.
            good = (before[i] != before[j]) | (place[i] == 0) | (place[j] == 0)
            good &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - EPS
            most = np.minimum(place[i], place[j]) + np.minimum(size[i] - place[i], size[j] - place[j])
            good &= most >= similarity / (1 + similarity) * (size[i] + size[j]) - EPS
            a, b = row[i[good]], row[j[good]]
            held.append((np.minimum(a, b), np.maximum(a, b)))
            if sum(len(x) for x, _ in held) >= HELD or at >= len(key):
                a, b = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])
                held = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut:
                yield from pairs(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = [b.slice(cut)]
            elif held and held[-1].column(0)[0].as_py() != keys[0]:
                yield from pairs(pa.Table.from_batches(held))
                held = [b]
            else:
                held.append(b)
        if held:
            yield from pairs(pa.Table.from_batches(held))

    sorted_ = found.repartition("key").sortWithinPartitions("key", "class")
    return sorted_.mapInArrow(run, "a bigint, b bigint").distinct()
