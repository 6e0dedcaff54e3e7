"""Key-value tables: a registry of schemas, and change logs in Parquet folders."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.errors import CommitConflict, InvalidArgument, KeyNotFound, TableExists, TableNotFound
from saltmarsh.functions.types import check_schema
from saltmarsh.operators import kv
from saltmarsh.sources.storage import Storage

_NAME = re.compile(r"[a-zA-Z0-9_.-]+")
TEXT = T.StructType([T.StructField("value", T.StringType())])


class Clock:
    """Microseconds, strictly increasing within the process."""

    def __init__(self) -> None:
        self._last, self._lock = 0, threading.Lock()

    def now(self) -> int:
        with self._lock:
            self._last = max(self._last + 1, time.time_ns() // 1000)
            return self._last


CLOCK = Clock()


class KvTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        head = [T.StructField("key", T.StringType(), False), T.StructField("version", T.LongType(), False), T.StructField("deleted", T.BooleanType(), False)]
        self.log_schema = T.StructType([*head, *schema])

    def _state(self) -> tuple[int, dict]:
        """Number and content of the last published compaction; 0 before the first."""
        store = Storage(self.spark)
        names = [x.path for x in store.list(f"{self.path}/state") if x.path.endswith(".json")]
        if not names:
            return 0, {"base": None, "covered": []}
        last = max(names)
        return int(last.rpartition("/")[2].removesuffix(".json")), json.loads(store.read(last))

    def _appended(self) -> list[str]:
        """Folders of appends that are complete."""
        found = Storage(self.spark).list(f"{self.path}/log", recursive=True)
        return [x.path.rpartition("/")[0] for x in found if x.path.endswith("/_SUCCESS")]

    def folders(self) -> list[str]:
        """What makes the log: the last compaction's folder, and the appends that it doesn't cover."""
        appended = self._appended()  # before the state: a compaction in between covers some of these, and has them
        _, state = self._state()
        gone = set(state["covered"])
        return [*([f"{self.path}/{state['base']}"] if state["base"] else []), *(x for x in appended if x.rpartition("/")[2] not in gone)]

    def log(self) -> DataFrame:
        folders = self.folders()
        return self.spark.read.schema(self.log_schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.log_schema)

    def append(self, changes: DataFrame) -> None:
        """Appends rows of the log's shape, in a folder of their own that counts once it is complete; what is written is
        durable. Keys and values out of their limits fail the write."""
        checked = kv.check_limits(changes.select(*self.log_schema.fieldNames()), values=self.schema.fieldNames())
        checked.write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/log/{uuid.uuid4().hex}")

    def put(self, key: str, **value) -> int:
        return self.put_batch([(key, value)])

    def put_batch(self, entries: list[tuple[str, dict]]) -> int:
        """Later entries of the same key win. Returns the last version."""
        rows = [(k, CLOCK.now(), False, *(v.get(f.name) for f in self.schema)) for k, v in entries]
        if rows:
            self.append(self.spark.createDataFrame(rows, self.log_schema))
        return rows[-1][1] if rows else 0

    def put_frame(self, df: DataFrame) -> int:
        """Upserts a frame (key and the value columns) under one version; its keys must be distinct."""
        check_schema(T.StructType([f for f in df.schema if f.name != "key"]), self.schema)
        if df.groupBy("key").count().where("count > 1").limit(1).count():
            raise InvalidArgument("a key occurs twice")
        version = CLOCK.now()
        self.append(df.select("key", F.lit(version).alias("version"), F.lit(False).alias("deleted"), *self.schema.fieldNames()))
        return version

    def put_if_absent(self, key: str, **value) -> bool:
        if kv.get(self.log(), key).limit(1).count():
            return False
        self.put(key, **value)
        return True

    def get(self, key: str, as_of: int | None = None) -> dict:
        row = kv.get(self.log(), key, as_of).first()
        if row is None:
            raise KeyNotFound(key)
        return {f.name: row[f.name] for f in self.schema}

    def batch_get(self, keys: list[str]) -> dict[str, dict | None]:
        rows = kv.batch_get(self.log(), self.spark.createDataFrame([(k,) for k in keys], "key string")).collect()
        found = {r.key: {f.name: r[f.name] for f in self.schema} if r.found else None for r in rows}
        return {k: found[k] for k in keys}

    def delete(self, *keys: str) -> int:
        """Tombstones, also for keys that never were."""
        rows = [(k, CLOCK.now(), True, *(None for _ in self.schema)) for k in keys]
        if rows:
            self.append(self.spark.createDataFrame(rows, self.log_schema))
        return rows[-1][1] if rows else 0

    def update_column(self, key: str, column: str, value) -> int:
        if column not in self.schema.fieldNames():
            raise InvalidArgument(f"no column {column}")
        return self.put(key, **(self.get(key) | {column: value}))

    def scan(self, start: str | None = None, end: str | None = None, limit: int = 0, as_of: int | None = None) -> DataFrame:
        return kv.scan(self.log(), start, end, limit, as_of)

    def prefix_scan(self, prefix: str, as_of: int | None = None) -> DataFrame:
        return kv.prefix_scan(self.log(), prefix, as_of)

    def snapshot(self, as_of: int | None = None, tombstones: bool = False, all_versions: bool = False) -> DataFrame:
        return kv.snapshot(self.log(), as_of, tombstones, all_versions)

    def compact(self) -> dict[str, int]:
        """Rewrites the log sorted by key, all versions kept, and tells files and bytes before and after.

        What is appended meanwhile stays. A new state is published by creating its file, which only one of two
        compactions can; a crash before that leaves the old state whole, and one after it leaves files that nothing
        reads. Files that were compacted stay for those who read them and are deleted by the next compaction."""
        store = Storage(self.spark)
        number, state = self._state()
        covered, appended = set(state["covered"]), self._appended()
        for x in appended:
            if x.rpartition("/")[2] in covered:
                store.delete(x)
        here = {x.rpartition("/")[2] for x in appended} - covered
        for x in store.list(self.path):
            if x.is_dir and x.path.rpartition("/")[2].startswith("base-") and self._older(x.path, state["base"]):
                store.delete(x.path)
        folders = [*([f"{self.path}/{state['base']}"] if state["base"] else []), *(f"{self.path}/log/{x}" for x in sorted(here))]
        old = self._files(folders)
        if not old:
            return {"files_before": 0, "files_after": 0, "bytes_before": 0, "bytes_after": 0}
        base = f"base-{number + 1:08d}-{uuid.uuid4().hex}"
        rows = kv.compacted(self.spark.read.schema(self.log_schema).parquet(*folders))
        rows.write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{base}")
        try:
            store.create(f"{self.path}/state/{number + 1:08d}.json", json.dumps({"base": base, "covered": sorted(x.rpartition("/")[2] for x in appended)}))
        except CommitConflict:
            store.delete(f"{self.path}/{base}")
            raise
        now = self._files([f"{self.path}/{base}"])
        return {"files_before": len(old), "files_after": len(now), "bytes_before": sum(old), "bytes_after": sum(now)}

    @staticmethod
    def _older(path: str, base: str | None) -> bool:
        return base is not None and path.rpartition("/")[2].split("-")[1] < base.split("-")[1]

    def _files(self, folders: list[str]) -> list[int]:
        store = Storage(self.spark)
        return [x.size for f in folders for x in store.list(f, recursive=True) if x.path.endswith(".parquet")]


class KvDatabase:
    """Creates, drops, lists and opens key-value tables below a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.storage = spark, Storage(spark)
        self.root = self.storage.qualified(root)
        self.storage.mkdirs(f"{self.root}/schemas")

    def _schema(self, name: str) -> str:
        if not _NAME.fullmatch(name):
            raise InvalidArgument(f"table name {name!r}")
        return f"{self.root}/schemas/{name}.json"

    def create_table(self, name: str, schema: T.StructType = TEXT) -> KvTable:
        if {"key", "version", "deleted"} & set(schema.fieldNames()):
            raise InvalidArgument("key, version and deleted are columns of the log")
        try:
            self.storage.create(self._schema(name), json.dumps(schema.jsonValue()))
        except CommitConflict:
            raise TableExists(name) from None
        return self.table(name)

    def create_text_table(self, name: str, schema: T.StructType = TEXT) -> KvTable:
        """For callers that store plain text: the schema must be one string column ``value``."""
        if [(f.name, f.dataType) for f in schema] != [("value", T.StringType())]:
            raise InvalidArgument("the schema must be one string column named value")
        return self.create_table(name, schema)

    def table(self, name: str) -> KvTable:
        path = self._schema(name)
        if not self.storage.exists(path):
            raise TableNotFound(name)
        return KvTable(self.spark, f"{self.root}/logs/{name}", T.StructType.fromJson(json.loads(self.storage.read(path))))

    def drop_table(self, name: str) -> None:
        self.table(name)
        self.storage.delete(self._schema(name))
        self.storage.delete(f"{self.root}/logs/{name}")

    def list_tables(self) -> list[str]:
        return [x.path.rpartition("/")[2].removesuffix(".json") for x in self.storage.list(f"{self.root}/schemas") if x.path.endswith(".json")]
