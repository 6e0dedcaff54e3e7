"""Near-duplicate vectors: binary codes of random rotations, with correction factors and error bounds.

Each vector is rotated by several random rotations; its code is the signs of all components, and for each rotation
the inner product of the unit vector with its code is stored. All different vectors of a label meet. Of two that meet,
one's code and factors give a direction near it and the angle between the two, so by the triangle inequality of angles
a bound that no similar vector escapes; only pairs that it can't rule out are recomputed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm.common import cached, components, new_path, shared_dir, trim, written

#: Vectors of a part: groups of more are compared part by part.
PART = 4096
#: Vectors whose bounds with a part are made at once.
SLICE = 512
#: Classes of a label whose parts are sent to each other; of larger ones, workers read the parts from the shared folder,
#: so that no vector is sent more than WHOLE / PART times. All pairs are compared either way.
WHOLE = 1 << 14
#: Pairs of parts of large labels that a task compares at most, and bytes of a row group of the files it reads.
TASK, GROUP_BYTES = 256, 2 << 20
#: Pairs that are recomputed at once.
PAIRS = 1 << 17
#: Chance that a pair at the threshold meets in some band of bands(), which near_vectors() doesn't use: it loses no pair.
RECALL = 0.9999
#: Groups whose sizes are broadcast at most (some MB).
BROADCAST_LABELS = 100_000
#: Bits of a code, rounded up to whole rotations.
CODE = 256
#: Standard deviations that the error of a single estimate stays within; bounds don't rest on it.
SIGMAS = 5.0


@cached(16, entry=False)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random rotations of the space, one below the other."""
    out = []
    for r in range(count):
        q, tri = np.linalg.qr(np.random.Generator(np.random.PCG64([7_919, dim, r])).standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(tri)))
    return np.concatenate(out) if out else np.zeros((0, dim))


def bands(rows: int, threshold: float) -> tuple[int, int]:
    """Bits in a band, and bands: four bits more than would number the rows of the largest label, and so many
    bands that a pair at the threshold meets with probability RECALL."""
    bits = max(8, math.ceil(math.log2(max(2, rows))) + 4)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - same))


def unit_of(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def turns_of(dim: int) -> int:
    return max(1, -(-CODE // dim))


CODED = "cid bigint, n bigint, grp bigint, parts bigint, raw binary, code binary, factors binary"


def coded(classes: DataFrame) -> DataFrame:
    """CODED of (cid, embedding, n, grp, parts): the vector's bytes; its binary code, a bit for each component of its
    rotations; and for each rotation the inner product of the unit vector with its code (the correction factor)."""
    names = [x.split()[0] for x in CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            sizes = np.diff(np.concatenate([[0], ends]))
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                for at in range(0, len(own), 1024):
                    yield part(b, flat, own[at : at + 1024], ends, dim)

    def part(b: pa.RecordBatch, flat: np.ndarray, own: np.ndarray, ends: np.ndarray, dim: int) -> pa.RecordBatch:
        x = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
        unit, turns = unit_of(x), turns_of(dim)
        turned = unit @ rotations(dim, turns).T
        factor = np.abs(turned).reshape(len(own), turns, dim).sum(axis=2) / math.sqrt(dim)
        code = np.packbits(turned > 0, axis=1)
        raw = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
        cid, n, grp, parts = (b.column(i).take(pa.array(own)) for i in (0, 2, 3, 4))
        return pa.RecordBatch.from_arrays([cid, n, grp, parts, raw(x), raw(code), raw(factor)], names)

    return classes.select("cid", "embedding", "n", "grp", "parts").mapInArrow(run, CODED)


class Block:
    """Vectors of whole groups, sorted by group and part, with what their comparison needs."""

    def __init__(self, rows: pa.Table, threshold: float, wide: np.dtype) -> None:
        column = lambda c: rows.column(c).to_numpy()
        self.cid, self.n, self.own, self.a, self.b = (column(c) for c in ("cid", "n", "own", "a", "b"))
        self.raw, self.code, self.factors = (rows.column(c) for c in ("raw", "code", "factors"))
        self.threshold, self.wide = threshold, wide
        self.left, self.right = [], []

    def _matrix(self, column: pa.ChunkedArray, first: int, last: int, kind: type | np.dtype) -> np.ndarray:
        return np.frombuffer(b"".join(column.slice(first, last - first).to_pylist()), kind).reshape(last - first, -1)

    def compare(self, first: int, last: int) -> None:
        """Compares the vectors of one group, which share dimension and label: all of them, or those of one part with those
        of another. The codes of the first, turned back and added up, are a direction whose angle with the vector
        follows from its factors. What is within the threshold's angle of the vector is within the sum of both angles of
        that direction; the rest needs no look."""
        middle = first + int(np.searchsorted(self.own[first:last], self.b[first])) if self.a[first] != self.b[first] else first
        if middle == last:
            return
        unit = unit_of(self._matrix(self.raw, first, last, self.wide))
        dim = unit.shape[1]
        turns = turns_of(dim)
        back = rotations(dim, turns) / math.sqrt(dim)
        right = unit[middle - first :].astype(np.float32).T
        slack = 1e-5 + dim * 2.0**-22  # rounding in single precision
        end = middle if middle > first else last
        for at in range(first, end, SLICE):
            to = min(at + SLICE, end)
            factor = self._matrix(self.factors, at, to, np.float64)
            signs = np.unpackbits(self._matrix(self.code, at, to, np.uint8), axis=1, count=turns * dim)
            centre = (signs * 2.0 - 1) @ back
            length = np.linalg.norm(centre, axis=1)
            angle = np.arccos((factor.sum(axis=1) / length).clip(-1, 1)) + math.acos(self.threshold)
            bound = np.cos(np.minimum(angle, math.pi)) - slack
            near = (centre / length[:, None]).astype(np.float32) @ right
            i, j = np.nonzero(near >= bound[:, None].astype(np.float32))
            i, j = i + at, j + middle
            if middle == first:
                i, j = i[i < j], j[i < j]
            for some in range(0, len(i), PAIRS):
                x, y = i[some : some + PAIRS], j[some : some + PAIRS]
                exact = np.einsum("ij,ij->i", unit[x - first], unit[y - first]) >= self.threshold
                self.left.append(x[exact])
                self.right.append(y[exact])

    def result(self) -> pa.RecordBatch:
        """Numbers of linked vectors, and edges that connect what is linked: each at most one a row."""
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.left, self.right))
        links = np.zeros(len(self.cid), np.int64)
        np.add.at(links, i, self.n[j])
        np.add.at(links, j, self.n[i])
        root = np.arange(len(self.cid))
        while len(i):
            before = root.copy()
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (root == before).all():
                break
        some, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        a = np.concatenate([self.cid[some], self.cid[joined]])
        b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(self.cid[root[joined]], pa.int64())])
        w = np.concatenate([links[some], np.zeros(len(joined), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(w)], ["a", "b", "w"])


LINKS = "a bigint, b bigint, w bigint"


def _compared(groups: DataFrame, threshold: float, wide: np.dtype) -> DataFrame:
    names = ["grp", "a", "b"]

    def starts(rows: pa.Table) -> np.ndarray:
        change = np.zeros(rows.num_rows, bool)
        change[0] = True
        for c in names:
            v = rows.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            whole = pa.Table.from_batches([b])
            at = starts(whole)
            same = last == [whole.column(c)[0].as_py() for c in names]
            if held and not same:
                yield block(pa.Table.from_batches(held))
                held = []
            cut = int(at[-1])  # the last group may go on
            if cut:
                yield block(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
            last = [whole.column(c)[cut].as_py() for c in names]
        if held:
            yield block(pa.Table.from_batches(held))
        trim()

    def block(rows: pa.Table) -> pa.RecordBatch:
        own = Block(rows.combine_chunks(), threshold, wide)
        at = [*starts(rows).tolist(), rows.num_rows]
        for first, last in zip(at, at[1:]):
            if last - first > 1:
                own.compare(first, last)
        return own.result()

    spread = groups.repartition(*names).sortWithinPartitions(*names, "own")
    return spread.mapInArrow(run, LINKS)


def _compared_apart(codes: DataFrame, sizes: DataFrame, threshold: float, wide: np.dtype) -> DataFrame:
    """The same for the parts of large groups: sorted files in the shared folder, of which a task reads two parts at a time.
    What is written and sent is in proportion to the vectors, whatever the number of pairs."""
    spark = codes.sparkSession
    numbered = sizes.select("grp", "parts", (F.sum("parts").over(Window.orderBy("grp")) - F.col("parts")).alias("first"))
    numbered = written(numbered, "vector-large")  # a row for each large group
    path = new_path(spark, "vector-parts")
    own = codes.drop("parts").join(F.broadcast(numbered), "grp").withColumn("part", F.col("first") + F.pmod(F.xxhash64("cid"), F.col("parts")))
    own = own.select("part", "cid", "n", "raw", "code", "factors").repartitionByRange("part").sortWithinPartitions("part")
    own.write.option("parquet.block.size", str(GROUP_BYTES)).parquet(path)
    listed = spark.read.schema("part bigint").parquet(path).groupBy(F.col("_metadata.file_path").alias("uri"))
    files = [tuple(r) for r in listed.agg(F.min("part").alias("low"), F.max("part").alias("high")).collect()]
    number = lambda low: F.explode(F.sequence(low, F.col("parts") - 1))
    pairs = numbered.withColumn("a", number(F.lit(0).cast("bigint"))).withColumn("b", number(F.col("a")))
    pairs = pairs.select((F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    many = numbered.agg(F.sum(F.expr("parts * (parts + 1) div 2"))).first()[0]
    tasks = min(many, max(4 * spark.sparkContext.defaultParallelism, -(-many // TASK)))

    def read(part: int) -> pa.Table:
        tables = []
        for uri, low, high in files:
            if low <= part <= high:
                system, name = fs.FileSystem.from_uri(uri)
                tables.append(pq.read_table(name, filesystem=system, filters=[("part", "==", part)]))
        return pa.concat_tables(tables) if tables else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a != last:
                    last, left = a, read(a)
                right = read(b) if a != b else None
                both = [x for x in (left, right) if x is not None]
                if left is None or a != b and right is None:
                    continue
                rows = pa.concat_tables(both).combine_chunks().rename_columns(["own", *left.column_names[1:]])
                for name, value in (("a", a), ("b", b)):
                    rows = rows.append_column(name, pa.array(np.full(rows.num_rows, value)))
                block = Block(rows, threshold, wide)
                block.compare(0, rows.num_rows)
                yield block.result()
        trim()

    return pairs.repartitionByRange(tasks, "a", "b").sortWithinPartitions("a", "b").mapInArrow(run, LINKS)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for every row of ``vectors``.

    Vectors are compared within their label, by cosine in double precision; the pairs linked are those that reach the
    threshold, in labels of any size. Equal vectors of a label are one class, compared once, and
    are linked with each other. Vectors of different length aren't compared. Vectors that are null, empty, zero, or hold null or non-finite components, and those
    without a label, have no links and are kept. Rows of null id count as linked vectors, and take the least id
    that isn't null of their component; kept is false for them unless they are alone without an id. An
    empty table gives no rows.

    A group of more than PART classes is split into parts that meet in pairs, so that no task holds it whole; what goes
    there is a vector's own bytes, its code and factors. Pairs aren't sent on, but numbers of links and edges of a
    spanning forest. The work of a label grows with the square of its different vectors.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    element = vectors.schema[vector_col].dataType.elementType
    kind, wide = ("float", np.dtype("<f4")) if isinstance(element, T.FloatType) else ("double", np.dtype("<f8"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"), F.col(label_col).alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    valid = rows.where(fine)
    classes = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    classes = classes.withColumn("dim", F.size("embedding"))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / PART).cast("bigint")
    sizes = written(sizes.withColumn("parts", parts).withColumn("grp", F.monotonically_increasing_id()), "vector-groups")
    groups, most = sizes.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    codes = written(coded(classes.join(F.broadcast(sizes) if groups <= BROADCAST_LABELS else sizes, ["label", "dim"])), "vector-codes")
    small = codes.where(F.col("parts") <= WHOLE // PART)
    met = small.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    met = met.select("cid", "n", "grp", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "raw", "code", "factors")
    compared = written(_compared(met, threshold, wide), "vector-links")
    large = sizes.where(F.col("parts") > WHOLE // PART)
    if -(-most // PART) > WHOLE // PART:
        compared = compared.union(written(_compared_apart(codes.where(F.col("parts") > WHOLE // PART), large, threshold, wide), "vector-links"))
    links = compared.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("w").alias("links"))
    joined = components(compared.where("b is not null").select("a", "b"))
    named = classes.select("cid", "first", "n").join(joined.withColumnRenamed("id", "cid"), "cid", "left").join(links, "cid", "left")
    named = named.select("cid", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    by_class = classes.select("cid", "label", "embedding").join(named.join(least, "component").select("cid", "n_links", "least"), "cid")
    linked = valid.join(by_class.drop("cid"), ["label", "embedding"]).select("vec_id", "n_links", "least")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("least"))
    out = linked.union(alone)
    return out.select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), F.col("least").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("least")).alias("kept"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (
  SELECT vec_id AS id, vec_id AS other FROM embeddings
  UNION SELECT reached.id, links.b FROM reached JOIN links ON links.a = reached.other),
component AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id),
number AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON id = vec_id LEFT JOIN number ON a = vec_id
"""
