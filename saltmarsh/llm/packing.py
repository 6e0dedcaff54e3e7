"""Best-fit packing of token pieces into sequences: local best fit, then a tree of merges of what is left."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.llm.bpe import SPLIT, Encoder, vocabulary
from saltmarsh.llm.common import cached, free_name, pieces, shared_dir, with_fields, written

#: Pieces that are packed together in the first round; bounds the memory of a task.
BLOCK = 1 << 18
#: Groups of the earlier round that meet in one of the next.
FAN = 64
#: Bits of the numbers of a bin in its block, a block in its task, and a task.
BIN_BITS, BLOCK_BITS, PART_BITS = 18, 20, 25


class LibraryEncoder(Encoder):
    """The same ids, with the stretches that aren't cached encoded together by the tiktoken library."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        order = [b""] * len(self.halves)
        for n, (a, b) in enumerate(self.halves):
            order[n] = bytes([n]) if n < 256 else order[a] + order[b]
        self.core = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks={x: n for n, x in enumerate(order)}, special_tokens={})
        self.size = np.array([len(x) for x in order], np.int64)
        self.real = np.array([self.id_of.get(n, 0) for n in range(len(order))], "<u4")

    def fill(self, parts: list[str], out: list[bytes | None]) -> None:
        units, own = self.units, []
        for i, ids in enumerate(out):
            if ids is None:
                x = parts[i]
                ids = units.get(x)
                if ids is None and len(x) >= 64:
                    ids = self.unit(" " + x)
                if ids is None:
                    own.append(i)
                out[i] = ids
        if not own:
            return
        texts = [parts[i] for i in own]
        found = np.array(self.core.encode_ordinary(" " + " ".join(texts)), np.int64)
        ends = np.cumsum([len(x.encode()) + 1 for x in texts])
        cuts = (np.searchsorted(np.cumsum(self.size[found]), ends) + 1).tolist()
        raw, at = self.real[found].tobytes(), 0
        for i, x, end in zip(own, texts, cuts):
            out[i] = raw[4 * at : 4 * end]
            at = end
            units.put(x, out[i])


@cached(2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def cut(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut where they are
    longer than ``capacity``; the first piece holds the remainder, all others are full."""
    shared_dir(docs.sparkSession)
    path = path or vocabulary()
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = library_encoder(path), np.array([end_id], "<u4").tobytes()
        for b in pieces(batches):
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = own.encode(text.as_py()) + last
                n, start, piece = len(ids) // 4, 0, 0
                size = n % capacity or capacity
                while start < n:
                    out.append((key, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                    start, piece, size = start + size, piece + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)], [k for k, _ in kinds])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item, largest first into the fullest bin that has room; and the bins' loads."""
    order = np.argsort(-sizes, kind="stable")
    bins, at = np.empty(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    load: list[int] = []
    open_ = 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = open_ >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            k, r = len(load), capacity
            load.append(0)
        bins[i], at[i] = k, load[k]
        load[k] += s
        if r := r - s:
            room[r].append(k)
            open_ |= 1 << r
    return bins, at, np.array(load, np.int64)


def underfull(loads: np.ndarray, capacity: int) -> np.ndarray:
    """Bins worth another round. After a best fit at most one bin is half full or less, and only such bins fit
    into others; beside them the FAN bins with most room go up, as no more small ones can meet."""
    by = np.argsort(loads, kind="stable")
    small = int((loads <= capacity // 2).sum())
    by = by[: small + FAN]
    return by[loads[by] < capacity]


def packed(items: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """``items`` (a written table, lengths 1 to ``capacity``) with sequence_id and offset, which are replaced if the input
    has such columns; all other columns stay, whatever their names.

    Each task packs its rows in blocks of at most BLOCK, without a shuffle. Bins that could still take or
    join others go up as items of their own, FAN groups meeting in each round, until one group is
    left; a round moves at most FAN + 1 bins a group. All rows stay; an empty table gives none.
    """
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset")
    schema = items.schema
    at_len = schema.fieldNames().index(length_col)
    own = [free_name(f"packing_{x}", schema.fieldNames()) for x in ("bin", "at", "block", "load", "up")]
    bin_, at_, block_, load_, up_ = own

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            bins, at, loads = best_fit(table.column(at_len).to_numpy(), capacity)
            up = np.zeros(len(loads), bool)
            up[underfull(loads, capacity)] = True
            if number >= 1 << BLOCK_BITS or part >= 1 << PART_BITS:
                raise OverflowError("too many blocks in a task, or tasks, for the numbers of bins")
            block = part << BLOCK_BITS | number
            number += 1
            more = [block << BIN_BITS | bins, at, np.full(len(bins), block), loads[bins], up[bins]]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, more)], [*table.column_names, *own])

        for b in batches:
            while b.num_rows:
                take = b.slice(0, BLOCK - rows)
                held.append(take)
                rows, b = rows + take.num_rows, b.slice(take.num_rows)
                if rows == BLOCK:
                    yield flush()
                    held, rows = [], 0
        if rows:
            yield flush()

    ddl = f"`{bin_}` bigint, `{at_}` bigint, `{block_}` bigint, `{load_}` bigint, `{up_}` boolean"
    placed = written(items.mapInArrow(first, with_fields(schema, ddl)), "packed")
    left = placed.where(F.col(up_)).select(F.col(block_).alias("block"), F.col(bin_).alias("bin"), F.col(load_).alias("load")).distinct()
    rank = written(_ranked(left.select("block").distinct()), "packing-blocks")
    blocks = rank.count()
    groups = left.join(rank, "block").select(F.col("n").alias("grp"), "bin", "load")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group at a time: the rows come sorted by group."""
        held: list[pa.RecordBatch] = []

        def one() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            grp, ids, load = (table.column(i).to_numpy() for i in range(3))
            order = np.lexsort((ids, -load))
            ids, load = ids[order], load[order]
            bins, at, loads = best_fit(load, capacity)
            host = np.zeros(len(loads), np.int64)
            host[bins[::-1]] = ids[::-1]  # a bin keeps the name of its first item
            up = np.zeros(len(loads), bool)
            up[underfull(loads, capacity)] = True
            columns = [pa.array(x) for x in (grp, ids, host[bins], at, loads[bins], up[bins])]
            return pa.RecordBatch.from_arrays(columns, ["grp", "bin", "into", "shift", "load", "up"])

        for b in batches:
            grp = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if held and held[-1].column(0)[0].as_py() != grp[start]:
                    yield one()
                held.append(b.slice(start, end - start))
        if held:
            yield one()

    seq, into, shift = (free_name(f"packing_{x}", [*schema.fieldNames(), *own]) for x in ("seq", "into", "shift"))
    where = placed.withColumn(seq, F.col(bin_))
    maps: list[DataFrame] = []
    while blocks > 1:
        blocks = -(-blocks // FAN)
        met = groups.selectExpr(f"grp div {FAN} grp", "bin", "load").repartition(min(blocks, 1000), "grp").sortWithinPartitions("grp")
        round_ = written(met.mapInArrow(again, "grp bigint, bin bigint, `into` bigint, shift bigint, load bigint, up boolean"), "packing-round")
        maps.append(round_.where("bin <> `into`").select(F.col("bin").alias(seq), F.col("into").alias(into), F.col("shift").alias(shift)))
        groups = round_.where("up and bin = `into`").select("grp", "bin", "load")
    for m in maps:
        moved = F.col(at_) + F.coalesce(shift, F.lit(0))
        where = where.join(m, seq, "left").withColumn(at_, moved).withColumn(seq, F.coalesce(into, seq)).drop(into, shift)
    return where.select(*(f"`{n}`" for n in schema.fieldNames()), F.col(seq).alias("sequence_id"), F.col(at_).alias("offset"))


def _ranked(order: DataFrame) -> DataFrame:
    """Numbers the blocks from 0 in order, by sorted ranges: each range's blocks follow those of the ranges before it, whose
    sizes (a row for each range) are all that meets in one place."""
    ranges = written(order.repartitionByRange("block").sortWithinPartitions("block").select("block", F.spark_partition_id().alias("part")), "packing-ranges")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("block")) - 1
    return ranges.join(before, "part").select("block", (F.col("before") + within).cast("bigint").alias("n"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row of ``docs``.

    A null or empty text is the end id alone. Rows of null or repeated doc_id are packed like any other;
    an empty table gives no rows. Other columns are not read.
    """
    return packed(written(cut(docs, path, capacity), "pieces"), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
