"""Language-model scoring by prediction by partial matching over bytes, with a word model as its base.

The trie of byte contexts is kept as sorted tables, one for each order: what followed each context and how
often. A byte that never followed the longest known context costs that context's escape (method C), and is
then predicted one order lower with all symbols of the longer context excluded.
"""

from __future__ import annotations

import math
from collections import Counter, OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import cached, dropped, new_path, pieces, removed, shared_dir, trim, written

#: Bytes of the longest context. A context and its byte are 48 bits; the other 16 number the texts of a block.
ORDER = 5
INDEX = np.uint64(64 - 8 * (ORDER + 1))
#: The byte that is in no UTF-8 text stands for a text's end, and for what is before its start.
END = 0xFF
#: Text that is looked up together, and positions that are sorted together.
CHUNK_BYTES, BLOCK = 8 << 20, 1 << 21
#: Rows of a file of a model table, and rows that a Python worker holds in memory.
SHARD_ROWS, HELD_ROWS = 1 << 19, 12 << 20


def held_out(id_col: str = "doc_id", folds: int = 10) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def contexts(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """For each position of the texts, their ends included: context and byte in the upper bits, and in the lower
    INDEX bits the text's index after the first of its block, which comes with it. In blocks of about BLOCK positions."""
    at = 0
    while at < len(texts):
        first, size = at, 0
        while at < len(texts) and (size == 0 or size + len(texts[at]) < BLOCK) and at - first < 1 << int(INDEX):
            size += len(texts[at]) + 1
            at += 1
        own = texts[first:at]
        raw = np.frombuffer(b"\xff" * ORDER + (b"\xff" * ORDER).join(own) + b"\xff", np.uint8)
        sizes = np.array([len(x) + 1 for x in own], np.int64)
        which = np.repeat(np.arange(at - first, dtype=np.uint16), sizes)
        for a in range(0, len(which), BLOCK):
            own_text = which[a : a + BLOCK]
            p = np.arange(a, a + len(own_text)) + (own_text.astype(np.int64) + 1) * (ORDER - 1) + 1
            code = np.zeros(len(p), np.uint64)
            for k in range(ORDER, -1, -1):
                code <<= np.uint64(8)
                code |= raw[p - k]
            code <<= INDEX
            code |= own_text
            yield first, code


def counted(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[starts], np.add.reduceat(n, starts)


class Grams:
    """Counts of contexts with their bytes, kept sorted; given out when there are many."""

    def __init__(self, most: int = 2 << 20) -> None:
        self.codes, self.counts, self.size, self.most = [], [], 0, most

    def add(self, texts: list[bytes]) -> None:
        for _, x in contexts(texts):
            code = np.sort(x >> INDEX).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            self.codes.append(code[starts])
            self.counts.append(np.diff(np.append(starts, len(code))))
            self.size += len(starts)
        if self.size > self.most:
            self.merge()

    def merge(self) -> None:
        if len(self.codes) > 1:
            code, n = counted(self.codes, self.counts)
            self.codes, self.counts, self.size = [code], [n], len(code)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = (self.codes[0], self.counts[0]) if self.codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.codes, self.counts, self.size = [], [], 0
        return out


GATHERED = "kind int, chunk bigint, doc_id bigint, held_out boolean, text binary, word binary, code bigint, n bigint"


def gathered(docs: DataFrame, held: Column, id_col: str, text_col: str) -> str:
    """Reads every text once. Writes, by kind, below the returned path: 0 the texts (A-Z in lower case, compressed, as they
    are shuffled later) in chunks of about CHUNK_BYTES; 1 the distinct words of each chunk with their counts in learned documents; 2 counts of
    contexts with their bytes in learned documents, summed over each task."""
    spark = docs.sparkSession
    names = [x.split()[0] for x in GATHERED.split(", ")]
    types = dict(zip(names, [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]))

    def batch(size: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], types[c]) if c in columns else pa.nulls(size, types[c]) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, grams, words, known, size = TaskContext.get().partitionId() << 32, Grams(), Counter(), Counter(), 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, words, known, size
            keys = list(dict.fromkeys([*known, *words]))
            for a in range(0, len(keys), 100_000):
                own = keys[a : a + 100_000]
                yield batch(len(own), kind=[1] * len(own), chunk=[chunk] * len(own), word=own, n=[known[k] for k in own])
            chunk, words, known, size = chunk + 1, Counter(), Counter(), 0

        small = zstandard.ZstdCompressor(level=3)
        for b in pieces(batches, most=CHUNK_BYTES // 4):
            texts = [(x or "").encode().lower() for x in b.column(2).to_pylist()]
            held = b.column(1).to_pylist()
            for x, h in zip(texts, held):
                (words if h else known).update(x.split())
            grams.add([x for x, h in zip(texts, held) if not h])
            yield batch(len(texts), kind=[0] * len(texts), chunk=[chunk] * len(texts), doc_id=b.column(0), held_out=held, text=[small.compress(x) for x in texts])
            size += sum(map(len, texts))
            if size >= CHUNK_BYTES:
                yield from close()
            if grams.size > 4 * grams.most:
                code, n = grams.take()
                yield batch(len(code), kind=np.full(len(code), 2, np.int32), code=code, n=n)
        if size or words or known:
            yield from close()
        code, n = grams.take()
        if len(code):
            yield batch(len(code), kind=np.full(len(code), 2, np.int32), code=code, n=n)

    path = new_path(spark, "ppm-gathered")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    rows.mapInArrow(run, GATHERED).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return path


class Files(NamedTuple):
    """A sorted table in the shared folder: its files, the first code in each, and all their rows."""

    uris: tuple[str, ...]
    lows: tuple[int, ...]
    path: str = ""
    rows: int = 0


class Model(NamedTuple):
    """entries[k]: code, c, first (log10 of c / (n + d)); contexts[k]: code, n, d, x (what the context's symbols
    count one order lower)."""

    entries: tuple[Files, ...]
    contexts: tuple[Files, ...]
    trained: bool

    @property
    def rows(self) -> int:
        return sum(f.rows for f in (*self.entries, *self.contexts))


def _sorted_files(df: DataFrame, tag: str) -> Files:
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.repartitionByRange("code").sortWithinPartitions("code").write.option("maxRecordsPerFile", SHARD_ROWS).parquet(path)
    found = spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("uri")).agg(F.min("code").alias("low"), F.count("*").alias("n")).orderBy("low").collect()
    return Files(tuple(r.uri for r in found), tuple(r.low for r in found), path, sum(r.n for r in found))


def fit(grams: DataFrame) -> Model:
    """The model from (code, n) rows. Every order's tables come from the next higher order's."""
    level = written(grams.groupBy("code").agg(F.sum("n").alias("c")), "ppm-order")
    entries, contexts_ = [], []
    for k in range(ORDER, -1, -1):
        lower = written(level.groupBy(F.expr(f"code & {(1 << 8 * k) - 1}L").alias("code")).agg(F.sum("c").alias("c")), "ppm-order") if k else None
        own = level.withColumn("ctx", F.expr("shiftright(code, 8)"))
        if k:
            own = own.withColumn("low", F.expr(f"code & {(1 << 8 * k) - 1}L")).join(lower.selectExpr("code low", "c lc"), "low")
        else:
            own = own.withColumn("lc", F.lit(0).cast("bigint"))
        sums = written(own.groupBy("ctx").agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.sum("lc").alias("x")), "ppm-contexts")
        first = F.log10(F.col("c") / (F.col("n") + F.col("d")))
        entries.append(_sorted_files(level.withColumn("ctx", F.expr("shiftright(code, 8)")).join(sums, "ctx").select("code", "c", first.alias("first")), "ppm-entries"))
        contexts_.append(_sorted_files(sums.selectExpr("ctx code", "n", "d", "x"), "ppm-lookup"))
        dropped(level)
        dropped(sums)
        level = lower
    return Model(tuple(entries[::-1]), tuple(contexts_[::-1]), bool(entries[-1].uris))


class Shards:
    """Files of the model's tables, the latest used in memory, HELD_ROWS rows at most beside one file."""

    def __init__(self) -> None:
        self.held: OrderedDict[str, list[np.ndarray]] = OrderedDict()
        self.rows = 0

    def get(self, uri: str) -> list[np.ndarray]:
        if uri in self.held:
            self.held.move_to_end(uri)
            return self.held[uri]
        own, path = fs.FileSystem.from_uri(uri)
        table = [c.to_numpy() for c in pq.read_table(path, filesystem=own).columns]
        while self.held and self.rows + len(table[0]) > HELD_ROWS:
            self.rows -= len(self.held.popitem(last=False)[1][0])
        self.held[uri] = table
        self.rows += len(table[0])
        return table

    def find(self, files: Files, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For sorted codes: which are in the table, and their columns (0 where they aren't)."""
        hit, columns = np.zeros(len(codes), bool), []
        cuts = [0, *np.searchsorted(codes, np.array(files.lows[1:], np.int64)).tolist(), len(codes)]
        for uri, a, b in zip(files.uris, cuts, cuts[1:]):
            if a == b:
                continue
            keys, *values = self.get(uri)
            at = np.minimum(np.searchsorted(keys, codes[a:b]), len(keys) - 1)
            hit[a:b] = keys[at] == codes[a:b]
            if not columns:
                columns = [np.zeros(len(codes), v.dtype) for v in values]
            for c, v in zip(columns, values):
                c[a:b] = np.where(hit[a:b], v[at], 0)
        return hit, columns


@cached(1)
def shards() -> Shards:
    return Shards()


def log_probability(model: Model, codes: np.ndarray) -> np.ndarray:
    """log10 of the probability of the last byte of each code after the others; ``codes`` are sorted."""
    own, out = shards(), np.zeros(len(codes))
    left = np.arange(len(codes))
    x, dx = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)  # what is excluded
    fresh = np.ones(len(codes), bool)  # no known context so far
    for k in range(ORDER, -1, -1):
        if not len(left) or not model.trained:
            break
        code = codes[left] & ((1 << 8 * (k + 1)) - 1)
        distinct, back = (code, slice(None)) if k == ORDER else np.unique(code, return_inverse=True)
        hit, columns = own.find(model.entries[k], distinct)
        hit = hit[back]
        c, first = (v[back] for v in columns) if columns else (np.zeros(len(code), np.int64), np.zeros(len(code)))
        quick = hit & fresh[left]
        out[left[quick]] += first[quick]
        slow = np.flatnonzero(~quick)
        ctx, back = np.unique(code[slow] >> 8, return_inverse=True)
        seen, columns = own.find(model.contexts[k], ctx)
        seen = seen[back]
        n, d, mine = (v[back] for v in columns) if columns else (np.zeros(len(slow), np.int64),) * 3
        rows = left[slow]
        n_, d_ = n - x[rows], d - dx[rows]
        total = np.maximum(n_ + d_, 1)
        got = hit[slow]
        out[rows[got]] += np.log10(c[slow][got] / total[got])
        missed = ~got & seen
        pay = missed & (d_ > 0)
        out[rows[pay]] += np.log10(d_[pay] / total[pay])
        x[rows[missed]], dx[rows[missed]] = mine[missed], d[missed]
        fresh[rows[missed]] = False
        left = rows[~got]
    if len(left):
        out[left] -= np.log10(np.maximum(1, 256 - dx[left]))
    return out


def score_texts(values, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text and its end. ``values`` gives that of sorted different codes."""
    total = np.zeros(len(texts))
    for first, x in contexts(texts):
        x.sort()
        code = (x >> INDEX).view(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        counts, code = np.diff(np.append(starts, len(code))), code[starts]
        value = np.repeat(values(code), counts)
        own = np.bincount((x & ((np.uint64(1) << INDEX) - np.uint64(1))).astype(np.uint16), value)
        total[first : first + len(own)] += own
    return total


def frequent(model: Model, spark: SparkSession, most: int) -> Files:
    """The codes that were learned most often, ``most`` at most, with their probabilities: what a worker holds."""
    own = spark.read.schema(ENTRIES).parquet(model.entries[ORDER].path)
    level = F.floor(F.log2("c")).cast("int")
    least, n = 64, 0
    for r in own.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 64 rows at most
        if n + r["count"] > most:
            break
        least, n = r.level, n + r["count"]
    return _sorted_files(own.where(level >= least).select("code", "first"), "ppm-frequent")


def rare_codes(texts: DataFrame, held: Files) -> DataFrame:
    """(chunk, code): the different codes of each chunk of texts that aren't among the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large, chunk, own = zstandard.ZstdDecompressor(), None, []

        def close() -> pa.RecordBatch:
            found = np.unique(np.concatenate([np.zeros(0, np.int64), *own]))
            own.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), chunk, np.int64)), pa.array(found)], ["chunk", "code"])

        for b in pieces(batches):
            for at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if at != chunk:
                    if own:
                        yield close()
                    chunk = at
                for _, x in contexts([large.decompress(raw)]):
                    code = np.unique((x >> INDEX).astype(np.int64))
                    own.append(code[~shards().find(held, code)[0]])
                if len(own) > 256:
                    own[:] = [np.unique(np.concatenate(own))]
        if own:
            yield close()

    return texts.select("chunk", "text").mapInArrow(run, "chunk bigint, code bigint")


ENTRIES, CONTEXTS = "code bigint, c bigint, first double", "code bigint, n bigint, d bigint, x bigint"


def probabilities(model: Model, codes: DataFrame) -> DataFrame:
    """(code, value) of different codes, as log_probability() has it, by joins with the model's tables, an order at a time.
    A code that was learned is found at once; others go down until an order has their byte."""
    spark, done = codes.sparkSession, []
    state = codes.select("code", F.lit(0.0).alias("value"), F.lit(0).cast("bigint").alias("ex"), F.lit(0).cast("bigint").alias("edx"), F.lit(True).alias("fresh"))
    for k in range(ORDER, -1, -1):
        small = (lambda df: F.broadcast(df)) if k < 2 else (lambda df: df)  # contexts of 1 byte at most: 66,000 rows
        entries = small(spark.read.schema(ENTRIES).parquet(model.entries[k].path).toDF("own", "c", "first"))
        known = small(spark.read.schema(CONTEXTS).parquet(model.contexts[k].path).toDF("ctx", "n", "d", "mine"))
        own = state.withColumn("own", F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))).withColumn("ctx", F.expr("shiftright(own, 8)"))
        own = own.join(entries, "own", "left").join(known, "ctx", "left")
        n, d = F.col("n") - F.col("ex"), F.col("d") - F.col("edx")
        total = F.greatest(n + d, F.lit(1))
        hit, seen = F.col("c").isNotNull(), F.col("n").isNotNull()
        gain = F.when(hit & F.col("fresh"), F.col("first")).when(hit, F.log10(F.col("c") / total)).when(seen & (d > 0), F.log10(d / total)).otherwise(0.0)
        own = own.select(
            "code", (F.col("value") + gain).alias("value"), F.when(seen, F.col("mine")).otherwise(F.col("ex")).alias("ex"),
            F.when(seen, F.col("d")).otherwise(F.col("edx")).alias("edx"), (F.col("fresh") & ~seen).alias("fresh"), hit.alias("done"),
        )
        own = written(own, "ppm-state")
        done.append(own.where("done").select("code", "value"))
        state = own.where("not done").drop("done")
    rest = state.select("code", (F.col("value") - F.log10(F.greatest(F.lit(1), 256 - F.col("edx")))).alias("value"))
    for more in done:
        rest = rest.union(more)
    return written(rest, "ppm-values")


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scored(docs: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text", held_rows: int = HELD_ROWS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    The base is the smoothed word model over all learned documents; score is the byte model's log10 probability
    of the text with A-Z in lower case and its end. Null texts are empty (one token, the end); rows of null id
    are held out, repeated ids keep a row each; an empty table gives no rows; where nothing is learned,
    all counts are 0 and bytes are uniform. Other columns are not read.

    A model of at most ``held_rows`` rows is looked up by the workers, which hold what they read of it. Of a larger one
    they hold the most frequent contexts with their bytes; all others of a chunk of texts are sent once to be joined
    with the model's tables, and come back with their probabilities. So no chunk reads the model again, and work
    stays in proportion to the texts.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    path = gathered(docs, held if held is not None else held_out(id_col), id_col, text_col)

    def kind(k: int, ddl: str) -> DataFrame:
        return spark.read.schema(f"{ddl}, kind int").parquet(path).where(f"kind = {k}").drop("kind")

    texts = kind(0, "chunk bigint, doc_id bigint, held_out boolean, text binary")
    words = kind(1, "chunk bigint, word binary, n bigint")
    model = fit(kind(2, "code bigint, n bigint"))
    removed(spark, f"{path}/kind=2")  # the model's tables have it all
    counts = written(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "ppm-words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = texts.where("not held_out").count()
    n, v = n + ends, v + (ends > 0)
    floor = math.log10(n + 0.1 * (v + 1))
    looked = words.select("chunk", "word").join(counts, "word").select("chunk", "word", "c", F.lit(None).cast("bigint").alias("code"), F.lit(None).cast("double").alias("value"))
    large_model, often = model.trained and model.rows > held_rows, None
    if large_model:
        often = frequent(model, spark, held_rows // 2)
        rare = written(rare_codes(texts, often), "ppm-rare")
        values = probabilities(model, rare.select("code").distinct())
        back = rare.join(values, "code").select("chunk", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("bigint").alias("c"), "code", "value")
        looked = looked.union(back)
    end_log = math.log10(ends + 0.1) - floor
    unknown = math.log10(0.1) - floor
    names = [x.split()[0] for x in SCORED.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def values_of(right: pa.Table):
        if not large_model:
            return lambda codes: log_probability(model, codes)
        right = right.select(["code", "value"]).filter(pc.is_valid(right.column("code")))
        code, value = right.column("code").to_numpy(), right.column("value").to_numpy()
        order = np.argsort(code)
        code, value = code[order], value[order]

        def values(codes: np.ndarray) -> np.ndarray:
            hit, columns = shards().find(often, codes)
            out = columns[0] if columns else np.zeros(len(codes))
            miss = np.flatnonzero(~hit)
            at = np.searchsorted(code, codes[miss])
            out[miss] = value[at]
            return out

        return values

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        values = values_of(right)
        right = right.filter(pc.is_valid(right.column("word")))
        keys = right.column("word").to_pylist()
        logs = dict(zip(keys, (np.log10(right.column("c").to_numpy() + 0.1) - floor).tolist()))
        del keys
        ids, held, raw = (left.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))
        large = zstandard.ZstdDecompressor()
        raw = [large.decompress(x) for x in raw]
        tokens, known, base = [], [], []
        for x in raw:
            own = x.split()
            found = [y for y in map(logs.get, own) if y is not None]
            tokens.append(len(own) + 1)
            known.append(len(found) + (ends > 0))
            base.append(math.fsum(found) + (len(own) - len(found)) * unknown + end_log)
        del logs
        columns = [ids, held, tokens, known, [n] * len(ids), base, score_texts(values, raw)]
        trim()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return texts.groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(run, SCORED)


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
