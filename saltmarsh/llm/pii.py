"""Personal data: pattern matches, and a skip-chain conditional random field that adds what is consistent with them.

Tokens that hold a digit or @ are nodes; every other token is outside by definition, which cuts the chain
exactly. Neighbours share chain potentials, and repeated or similar tokens anywhere in a document share skip
potentials: each with the latest repeat before it, and with a repeat of fixed label if there is any. Tokens of
pattern matches have their labels fixed, and so have those of numbers that fail their check (outside); loopy message
passing carries them to the rest.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from saltmarsh.llm.common import cached, pieces, shared_dir, take, with_fields, written

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
#: Documents, and tokens of them, that the field is fitted on at most.
TRAIN_DOCS, TRAIN_TOKENS = 2000, 100_000
#: Feature slots; rounds of message passing; share of the old message that is kept.
SLOTS, ROUNDS, DAMPING = 512, 12, 0.3
#: Posterior that a token needs to be added.
CERTAIN = 0.7
#: Features of a token; tokens of documents that are solved together.
FEATURES, SOLVED = 9, 1 << 17
#: Skip potential of two repeats that are of one kind, where the labelled documents have no repeats that tell otherwise.
AGREE = 4.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[0-9@+(]++[0-9A-Za-z@+.()_%-]*+")
LUHN = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def emails(text: str) -> Iterator[Span]:
    """Linear in the text: each @ takes the run of local characters before it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        following = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield Span(start, 0, m.end())
            done = following = m.end()
        elif start == at:
            done = max(done, at)
        else:
            done = at  # no later @ can take these characters, as this @ isn't a local one
        at = text.find("@", following)


def luhn(digits: str) -> bool:
    return sum(LUHN[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def matches(text: str) -> tuple[list[Span], list[Span]]:
    """The pattern matches, by start, then kind; and the cards (of 12 to 19 digits) and ips that fail their check."""
    if not SIGN.search(text):
        return [], []
    out, failed = list(emails(text)) if "@" in text else [], []
    for m in IP.finditer(text):
        good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
        (out if good else failed).append(Span(m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                (out if luhn(digits) else failed).append(Span(m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(Span(m.start(), 3, m.end()))
    return sorted(out), sorted(failed)


def base_spans(text: str) -> list[Span]:
    return matches(text)[0]


class Graph(NamedTuple):
    """The nodes of one document: places, active feature slots (FEATURES each), fixed labels (-1: free); chain edges by their
    second node (the first is the one before), skip edges as pairs. All are compact arrays."""

    starts: np.ndarray
    ends: np.ndarray
    slots: np.ndarray
    fixed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


@cached(1 << 15, entry=False)
def features(own: str, plus: bool) -> bytes:
    digits = sum("0" <= c <= "9" for c in own)
    shape = re.sub(r"[0-9]+", lambda x: f"d{min(20, len(x.group()))}", re.sub(r"[^\W\d_]+", "a", own))
    names = [
        "bias", f"shape={shape[:40]}", f"digits={min(20, digits)}", f"at={'@' in own}", f"dots={min(4, own.count('.'))}",
        f"letters={any(c.isalpha() for c in own)}", f"plus={plus}", f"paren={'(' in own}", f"dash={min(3, own.count('-'))}",
    ]
    slots = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "little") % SLOTS for x in names]
    return array("H", slots).tobytes()


def graph(text: str, base: list[Span], failed: list[Span]) -> Graph:
    """Tokens of matches have their kind as fixed label; those of numbers that fail their check are outside for certain."""
    starts, ends, slots, fixed, chain, keys, of = array("q"), array("q"), bytearray(), array("b"), array("q"), array("Q"), array("q")
    last, b, f = 0, 0, 0

    def overlapping(spans: list[Span], k: int, start: int, end: int) -> Span | None:
        while k < len(spans) and spans[k].start < end:
            if spans[k].end > start:
                return spans[k]
            k += 1
        return None

    for m in TOKEN.finditer(text):
        start, end = m.start(), m.end()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        while end > start and not text[end - 1].isalnum() and text[end - 1] != ")":
            end -= 1
        own = text[start:end]
        if not SIGN.search(own):
            last = max(last, end)
            continue
        while b < len(base) and base[b].end <= start:
            b += 1
        while f < len(failed) and failed[f].end <= start:
            f += 1
        label = -1
        if span := overlapping(base, b, start, end):
            label = span.kind + 1
        elif overlapping(failed, f, start, end):
            label = 0
        i = len(starts)
        if i and start - ends[-1] <= 2:
            chain.append(i)
        starts.append(start)
        ends.append(end)
        fixed.append(label)
        slots += features(own, own[:1] == "+" or text[max(0, start - 1) : start] == "+")
        digits = "".join(c for c in own if "0" <= c <= "9")
        if len(digits) >= 6 or own[0] in "(+" or "@" in own:  # a year or a house number repeats by chance
            for key in {own.lower(), digits if len(digits) >= 6 else own.lower()}:
                keys.append(xxh64_intdigest(key))
                of.append(i)
        last = end
    ints = lambda x, t: np.frombuffer(x, t)
    labels = ints(fixed, np.int8)
    skip = repeats(ints(keys, np.uint64), ints(of, np.int64), labels)
    return Graph(ints(starts, np.int64), ints(ends, np.int64), ints(slots, np.uint16).reshape(-1, FEATURES), labels, ints(chain, np.int64), skip)


def repeats(keys: np.ndarray, of: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Pairs of nodes that share a key: each with the latest repeat before it, and each free one, that has none of fixed
    label beside it, with the latest of fixed label before it, or else the first after it."""
    order = np.argsort(keys, kind="stable")
    keys, node = keys[order], of[order]
    n = len(node)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    same = keys[1:] == keys[:-1]
    known, at = fixed[node] >= 0, np.arange(n)
    group = np.cumsum(np.append(True, ~same)) - 1
    before = np.maximum.accumulate(np.where(known, at, -1))
    after = np.minimum.accumulate(np.where(known, at, n)[::-1])[::-1]
    inside = lambda x: (x >= 0) & (x < n) & (group[np.clip(x, 0, n - 1)] == group)
    hub = np.where(inside(before), before, np.where(inside(after), after, -1))
    beside = known.copy()
    beside[1:] |= known[:-1] & same
    beside[:-1] |= known[1:] & same
    far = (hub >= 0) & ~beside
    pairs = np.concatenate([np.stack([node[:-1][same], node[1:][same]], axis=1), np.stack([node[hub[far]], node[far]], axis=1)])
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    pairs.sort(axis=1)
    return np.unique(pairs[:, 0] << 32 | pairs[:, 1])[:, None] >> np.array([32, 0]) & 0xFFFFFFFF


class Weights(NamedTuple):
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


class Joined(NamedTuple):
    slots: np.ndarray
    fixed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def joined(graphs: list[Graph]) -> Joined:
    """The documents' graphs as one, without edges between them."""
    at = np.cumsum([0, *(len(g.starts) for g in graphs)])
    chain = np.concatenate([np.zeros(0, np.int64), *(g.chain + a for g, a in zip(graphs, at))])
    skip = np.concatenate([np.zeros((0, 2), np.int64), *(g.skip + a for g, a in zip(graphs, at))])
    slots = np.concatenate([np.zeros((0, FEATURES), np.uint16), *(g.slots for g in graphs)])
    fixed = np.concatenate([np.zeros(0, np.int8), *(g.fixed for g in graphs)])
    return Joined(slots, fixed, np.stack([chain - 1, chain], axis=1), skip)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit(data: Joined, steps: int = 150, rate: float = 0.2, decay: float = 2e-3) -> Weights:
    """Weights of greatest pseudo-likelihood where tokens of matches have their kind and all others are outside. They are
    drawn to zero, but those of skip edges to AGREE for repeats of one kind: few documents say a match again in a form
    that is none, and those that do are labelled outside here, so the data alone could teach no consistency."""
    y = np.maximum(data.fixed, 0)
    n = len(y)
    agree = np.diag([0.0, *[AGREE] * len(KINDS)])
    unary, chain, skip = np.zeros((SLOTS, LABELS)), np.zeros((LABELS, LABELS)), agree.copy()
    if not n:
        unary[:, 0] = 0.25
        return Weights(unary, chain, skip)
    want = np.eye(LABELS)[y]
    a, b = data.chain[:, 0], data.chain[:, 1]
    s, t = data.skip[:, 0], data.skip[:, 1]
    squares = [np.full_like(w, 1e-6) for w in (unary, chain, skip)]
    for _ in range(steps):
        score = unary[data.slots].sum(axis=1)
        np.add.at(score, b, chain[y[a]])
        np.add.at(score, a, chain.T[y[b]])
        np.add.at(score, t, skip[y[s]])
        np.add.at(score, s, skip.T[y[t]])
        left = (want - _softmax(score)) / n
        gu, gc, gs = -decay * unary / SLOTS, -decay * chain / LABELS, -decay * (skip - agree) / LABELS
        for k in range(data.slots.shape[1]):
            np.add.at(gu, data.slots[:, k], left)
        np.add.at(gc, y[a], left[b])
        np.add.at(gc.T, y[b], left[a])
        np.add.at(gs, y[s], left[t])
        np.add.at(gs.T, y[t], left[s])
        gs = (gs + gs.T) / 2
        for w, g, q in zip((unary, chain, skip), (gu, gc, gs), squares):
            q += g * g
            w += rate * g / np.sqrt(q)
    return Weights(unary, chain, skip)


def _parts(n: int, size: int = 1 << 16) -> Iterator[slice]:
    return (slice(at, at + size) for at in range(0, n, size))


def posteriors(data: Joined, weights: Weights) -> np.ndarray:
    """Label probabilities of every node by damped sum-product message passing over chain and skip edges. What a node of
    fixed label sends is constant, so it is added to its neighbours' own scores; messages run between free nodes."""
    unary, n = weights.unary.astype(np.float32), len(data.fixed)
    own = np.empty((n, LABELS), np.float32)
    for part in _parts(n):
        own[part] = unary[data.slots[part]].sum(axis=1)
    free = data.fixed < 0
    u, v, skip = [], [], []
    for edges, psi in ((data.chain, weights.chain), (data.skip, weights.skip)):
        a, b, psi = edges[:, 0], edges[:, 1], psi.astype(np.float32)
        for x, y, table in ((a, b, psi), (b, a, psi.T)):
            told = free[y] & ~free[x]
            np.add.at(own, y[told], table[data.fixed[x[told]]])
        both = free[a] & free[b]
        u.append(a[both])
        v.append(b[both])
        skip.append(np.full(int(both.sum()), edges is data.skip))
    own[~free] = -50.0
    own[~free, data.fixed[~free]] = 0.0
    u, v, skip = np.concatenate(u), np.concatenate(v), np.concatenate(skip)
    e = len(u)
    sent, belief = np.zeros((2 * e, LABELS), np.float32), own.copy()
    tables = np.exp(np.stack([weights.chain, weights.skip, weights.chain.T, weights.skip.T])).astype(np.float32)
    for _ in range(ROUNDS if e else 0):
        new, total = np.empty_like(sent), own.copy()
        for side, (source, target) in enumerate(((u, v), (v, u))):
            for part in _parts(e):
                to = slice(side * e + part.start, min(side * e + part.stop, (side + 1) * e))
                back = slice((1 - side) * e + part.start, min((1 - side) * e + part.stop, (2 - side) * e))
                x = belief[source[part]] - sent[back]
                x = np.exp(x - x.max(axis=1, keepdims=True))
                is_skip = skip[part][:, None]
                y = np.log(np.where(is_skip, x @ tables[2 * side + 1], x @ tables[2 * side]) + np.float32(1e-30))
                y -= y.max(axis=1, keepdims=True)
                new[to] = DAMPING * sent[to] + (1 - DAMPING) * y
                np.add.at(total, target[part], new[to])
        sent, belief = new, total
    return _softmax(belief)


def added(g: Graph, p: np.ndarray, base: list[Span]) -> list[Span]:
    """The spans of free nodes that are sure of a kind, joined where they touch, without those that overlap a match."""
    label, sure = p.argmax(axis=1), p.max(axis=1)
    more: list[Span] = []
    for j in np.flatnonzero((g.fixed < 0) & (label > 0) & (sure >= CERTAIN)).tolist():
        kind, start, end = int(label[j]) - 1, int(g.starts[j]), int(g.ends[j])
        if more and more[-1].kind == kind and 0 <= start - more[-1].end <= 1:
            more[-1] = Span(more[-1].start, kind, end)
        else:
            more.append(Span(start, kind, end))
    first, reach = [x.start for x in base], list(accumulate((x.end for x in base), max))
    return [x for x in more if not (k := bisect_left(first, x.end)) or reach[k - 1] <= x.start]


def found(texts: list[str], weights: Weights) -> Iterator[tuple[list[Span], list[Span]]]:
    """(pattern matches, all spans) of each text. What the field adds overlaps no match. Documents are solved together up to
    about SOLVED tokens, a longer one alone, so memory follows the longest text: some 150 bytes a token of it."""
    take(__name__)
    held: list[tuple[list[Span], Graph | None]] = []
    size = 0

    def solved() -> Iterator[tuple[list[Span], list[Span]]]:
        graphs = [g for _, g in held if g is not None]
        p = posteriors(joined(graphs), weights) if graphs else None
        at = 0
        for base, g in held:
            more = []
            if g is not None:
                more = added(g, p[at : at + len(g.fixed)], base)
                at += len(g.fixed)
            yield base, sorted([*base, *more]) if more else base
        held.clear()

    for x in texts:
        base, failed = matches(x)
        g = graph(x, base, failed) if SIGN.search(x) else None
        if g is not None and not (g.fixed < 0).any():
            g = None
        more = 0 if g is None else len(g.fixed)
        if held and size + more > SOLVED:
            yield from solved()
            size = 0
        held.append((base, g))
        size += more
    yield from solved()


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Fits the field on the TRAIN_DOCS different documents of least hash of the id (and then of the text) that hold a digit
    or @, labelled by the patterns: those of them, in that order, that have TRAIN_TOKENS tokens together, none with more
    than a tenth of that. Their graphs are made on the executors, and the driver gets those that are taken. With no
    such document the field adds nothing of its own but what repeats a match."""
    shared_dir(docs.sparkSession)
    rows = docs.select(F.xxhash64(id_col).alias("h"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    least = rows.select("h", "t").distinct().orderBy("h", "t").limit(TRAIN_DOCS)
    top = least.agg(F.max(F.struct("h", "t")).alias("x")).select("x.*").first()
    nothing = joined([])
    if top.h is None:
        return fit(nothing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for h, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                g = graph(text, *matches(text))
                if 0 < len(g.starts) <= TRAIN_TOKENS // 10:
                    raw = [pa.array([x.tobytes()], pa.binary()) for x in (g.slots, g.fixed, g.chain, g.skip)]
                    yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([t]), pa.array([len(g.starts)]), *raw], ["h", "t", "n", "slots", "fixed", "chain", "skip"])

    below = (F.col("h") < top.h) | (F.col("h") == top.h) & (F.col("t") <= top.t)
    some = rows.where(below).dropDuplicates(["h", "t"]).mapInArrow(run, "h bigint, t bigint, n bigint, slots binary, fixed binary, chain binary, skip binary")
    some = written(some, "pii-sample")
    last, size = None, 0
    for r in some.select("h", "t", "n").orderBy("h", "t").collect():
        if size + r.n > TRAIN_TOKENS:
            break
        last, size = r, size + r.n
    if last is None:
        return fit(nothing)
    taken = some.where((F.col("h") < last.h) | (F.col("h") == last.h) & (F.col("t") <= last.t)).orderBy("h", "t").collect()
    graphs = []
    for r in taken:
        slots, fixed = np.frombuffer(r.slots, np.uint16).reshape(-1, FEATURES), np.frombuffer(r.fixed, np.int8)
        graphs.append(Graph(np.zeros(len(fixed)), np.zeros(0), slots, fixed, np.frombuffer(r.chain, np.int64), np.frombuffer(r.skip, np.int64).reshape(-1, 2)))
    return fit(joined(graphs))


def find(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) in code points, by start, then kind. Null and empty texts have
    none; rows of null or repeated id stay; an empty table gives no rows; other columns are not read."""
    shared_dir(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            both = list(found([x or "" for x in b.column(1).to_pylist()], weights))
            lists = [[[{"kind": KINDS[s.kind], "start": s.start, "end": s.end} for s in own] for own in side] for side in zip(*both)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, kind) for x in lists)], ["doc_id", "base", "spans"])

    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id bigint, base {span}, spans {span}")


def redacted_text(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by its first kind in angle brackets."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{KINDS[s.kind].upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: Weights, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; all columns and rows stay, null texts are null."""
    shared_dir(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column(at).to_pylist()
            both = found([x or "" for x in texts], weights)
            new = [None if x is None else redacted_text(x, spans) if spans else x for x, (_, spans) in zip(texts, both)]
            columns = list(b.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, with_fields(docs.schema, ""))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = find(docs, trained(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
