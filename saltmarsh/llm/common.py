"""What the operators of this subpackage share: written intermediate tables and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache, wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches are cut at this many bytes of input, so that very long texts can't gather in one batch.
BATCH_BYTES = 8 << 20


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "saltmarsh_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="saltmarsh-code-"), "saltmarsh.zip")  # the driver serves it to the executors
    atexit.register(shutil.rmtree, name.parent, True)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(name))
    sc.saltmarsh_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, which is allowed for a local master alone, it is a temporary one.
    """
    shipped(spark)
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "saltmarsh_folder", None)
    if not found:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = sc.saltmarsh_folder = "file://" + tempfile.mkdtemp(prefix="saltmarsh-")
    if not 0 < int(re.sub(r"\D", "", str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))) or 0) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/saltmarsh/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Deletes all intermediate tables and archives of this application; results that weren't saved are lost."""
    removed(spark, f"{shared_dir(spark)}/saltmarsh/{spark.sparkContext.applicationId}")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saltmarsh_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    if path := getattr(df, "saltmarsh_path", None):
        removed(df.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class ByRow:
    """A table (row, value) for row numbers made by monotonically_increasing_id(), which hold the number of the task that
    wrote a row in their upper bits: sorted files in the shared folder, of which a worker reads the part of the rows it
    has before it. So a column is added to rows, or rows are chosen, without a shuffle of the rows themselves."""

    def __init__(self, rows: DataFrame, tag: str) -> None:
        path = new_path(rows.sparkSession, tag)
        rows.select("row", "value").repartitionByRange("row").sortWithinPartitions("row").write.parquet(path)
        files = rows.sparkSession.read.schema("row bigint, value bigint").parquet(path).groupBy(F.col("_metadata.file_path").alias("uri"))
        found = files.agg(F.min("row").alias("low"), F.max("row").alias("high")).orderBy("low").collect()  # a row for each file
        self.files = [(r.uri, r.low, r.high) for r in found]
        self.part, self.rows, self.values = -1, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _load(self, part: int) -> None:
        low, high = part << 33, (part + 1) << 33
        tables = []
        for uri, first, last in self.files:
            if first < high and last >= low:
                own, path = fs.FileSystem.from_uri(uri)
                tables.append(pq.read_table(path, filesystem=own, filters=[("row", ">=", low), ("row", "<", high)]))
        table = pa.concat_tables(tables) if tables else None
        self.part = part
        self.rows = table.column("row").to_numpy() if tables else np.zeros(0, np.int64)
        self.values = table.column("value").to_numpy() if tables else np.zeros(0, np.int64)

    def find(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are in the table, and their values (0 for others)."""
        hit, value = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
        for part in np.unique(rows >> 33).tolist():
            if part != self.part:
                self._load(part)
            if len(self.rows):
                own = np.flatnonzero(rows >> 33 == part)
                at = np.minimum(np.searchsorted(self.rows, rows[own]), len(self.rows) - 1)
                hit[own] = self.rows[at] == rows[own]
                value[own] = np.where(hit[own], self.values[at], 0)
        return hit, value


def chosen(rows: DataFrame, row: str, keep: DataFrame, tag: str) -> DataFrame:
    """The ``rows`` (a written table) whose number in column ``row`` is among those of ``keep`` (a column ``row``)."""
    table = ByRow(keep.select("row", F.lit(0).cast("bigint").alias("value")), tag)
    at = rows.columns.index(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, _ = table.find(b.column(at).to_numpy())
            yield b.filter(pa.array(hit))

    return rows.mapInArrow(run, rows.schema)


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, with underscores before it until no column is called so."""
    names = {x.lower() for x in taken}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """A schema with further fields at its end, for mapInArrow."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in (*schema, *(T.StructType.fromDDL(ddl) if ddl else ()))])


_clear: dict[str, list] = {}
_owner = ""


def trim() -> None:
    """Gives freed memory back to the system: workers are reused, and wait for each other's stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def take(module: str) -> None:
    """Clears the caches of all other modules when a worker goes over to another operator."""
    global _owner
    if module != _owner:
        _owner = module
        for name, own in _clear.items():
            if name != module:
                for clear in own:
                    clear()
        gc.collect()
        trim()


def cached(maxsize: int, entry: bool = True):
    """lru_cache for what workers keep between tasks. An ``entry`` takes the worker for its module when it is called."""

    def keep(f):
        out = lru_cache(maxsize)(f)
        _clear.setdefault(f.__module__, []).append(out.cache_clear)
        if not entry:
            return out

        @wraps(f)
        def get(*args):
            take(f.__module__)
            return out(*args)

        return get

    return keep


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2048, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of at most ``rows`` rows and about ``most`` bytes (a single row may be larger)."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * most / max(1, batch.nbytes)) or 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    trim()


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has two bigint columns, a and b. Returns (id, component) for every id that has an edge to
    another one; component is the least id reachable. Each round is two aggregations and two joins over
    the remaining edges and ends in a written table; the driver sees only counts and a checksum.
    Null ends and loops are ignored; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(now)
    if not last[0]:
        return spark.createDataFrame([], "id bigint, component bigint")
    while True:
        both = now.union(now.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v u", "m v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v u", "m v").where("u <> v").union(least.selectExpr("u", "m v")).distinct()
        new = written(small, "edges")
        dropped(now)
        now, mine = new, mark(new)
        if mine == last:
            return now.selectExpr("u id", "v component").union(now.selectExpr("v id", "v component").distinct())
        last = mine
