"""Key-value operators over a change log (key, version, deleted, value...): one row for each version of a key.

A state is one aggregation by key that keeps the newest version; only key ranges, prefixes and times that reach the
scan as filters limit what is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.errors import InvalidArgument

MAX_KEY, MAX_VALUE = 4 << 10, 4 << 20


def log(df: DataFrame, key: Column, version: Column, deleted: Column, *value: Column) -> DataFrame:
    """A change log from any frame."""
    return df.select(key.alias("key"), version.alias("version"), deleted.alias("deleted"), *value)


def _order(columns: list[str], kinds: dict[str, str]) -> Column:
    """Version, then a hash of the rest: which of two rows of one version counts doesn't depend on their place."""
    hashed = [F.col(f"`{c}`") for c in columns if not kinds[c].startswith(("map", "variant")) and "map<" not in kinds[c]]
    return F.struct("version", F.xxhash64(*hashed)) if hashed else F.struct("version")


def snapshot(changes: DataFrame, as_of=None, tombstones: bool = False, all_versions: bool = False) -> DataFrame:
    """The log's state: the newest version of each key, not newer than ``as_of``, unless that is a tombstone (kept if
    ``tombstones``). ``all_versions`` gives every visible version instead. Of rows with the same key and version one
    counts: the same one always, by a hash of its values."""
    seen = changes if as_of is None else changes.where(F.col("version") <= as_of)
    rest = [c for c in seen.columns if c not in ("key", "version")]
    order = _order(rest, dict(seen.dtypes))
    keys = ["key", "version"] if all_versions else ["key"]
    last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), order).alias("_r")
    found = seen.groupBy(*keys).agg(last) if all_versions else seen.groupBy("key").agg(F.max("version").alias("version"), last)
    seen = found.select("key", "version", *(F.col(f"_r.`{c}`").alias(c) for c in rest)).select(*changes.columns)
    return seen if tombstones else seen.where(~F.col("deleted"))


def get(changes: DataFrame, key, as_of=None) -> DataFrame:
    """One row, or none if the key isn't there or is deleted."""
    return snapshot(changes.where(F.col("key") == F.lit(key)), as_of)


def batch_get(changes: DataFrame, keys: DataFrame, as_of=None) -> DataFrame:
    """A row for each of ``keys`` (column key), with NULLs for those not found, and whether they are."""
    wanted = keys.select("key").distinct()
    state = snapshot(changes.join(wanted, "key", "left_semi"), as_of).drop("deleted")
    return wanted.join(state.withColumn("found", F.lit(True)), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def scan(changes: DataFrame, start=None, end=None, limit: int = 0, as_of=None) -> DataFrame:
    """Live keys from ``start`` up to, but without, ``end``, by key; ``limit`` of 0 or less is none."""
    if start is not None:
        changes = changes.where(F.col("key") >= F.lit(start))
    if end is not None:
        changes = changes.where(F.col("key") < F.lit(end))
    out = snapshot(changes, as_of).orderBy("key")
    return out.limit(limit) if limit > 0 else out


def prefix_scan(changes: DataFrame, prefix: str, as_of=None) -> DataFrame:
    return snapshot(changes.where(F.col("key").startswith(prefix)), as_of).orderBy("key")


def absent(changes: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose keys aren't live: what put-if-absent would write."""
    return new.join(snapshot(changes).select("key"), "key", "left_anti")


def updated(changes: DataFrame, column: str, value: Column, version: Column, where: Column | None = None) -> DataFrame:
    """New versions of live keys with one column replaced: a read-modify-write as rows to append."""
    if column not in changes.columns or column in ("key", "version", "deleted"):
        raise InvalidArgument(f"no value column {column}")
    live = snapshot(changes)
    if where is not None:
        live = live.where(where)
    return live.withColumn(column, value).withColumn("version", version)


def merge(*logs: DataFrame) -> DataFrame:
    """The union of logs: versions decide, not the order of the logs."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return out


def compacted(*logs: DataFrame, partitions: int | None = None) -> DataFrame:
    """All versions and tombstones of the logs, sorted by key and version within key ranges."""
    out = merge(*logs)
    out = out.repartitionByRange(partitions, "key") if partitions else out.repartitionByRange("key")
    return out.sortWithinPartitions("key", "version")


def value_size(columns: list[str], kinds: dict[str, str]) -> Column:
    """Bytes of a value: those of its one text or binary column, or of all columns' texts and one byte a column."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`") if kinds[c] in ("string", "binary") else F.to_json(F.struct(f"`{c}`"))), F.lit(0)) for c in columns]
    if len(columns) == 1 and kinds[columns[0]] in ("string", "binary"):
        return texts[0]
    return sum(texts, F.lit(len(columns)))


def check_limits(df: DataFrame, key: str = "key", values: Sequence[str] = ()) -> DataFrame:
    """The rows, with an error when an empty or oversized key or value is met. ``values`` make the value; rows that are
    ``deleted`` have none."""
    kinds = dict(df.dtypes)
    size = F.octet_length(F.col(f"`{key}`"))
    bad = F.col(f"`{key}`").isNull() | (size == 0) | (size > MAX_KEY)
    checked = F.when(bad, F.raise_error(F.lit(f"key must have 1 to {MAX_KEY} bytes")))
    if values:
        size = value_size(list(values), kinds)
        bad = (size == 0) | (size > MAX_VALUE)
        if "deleted" in kinds:
            bad &= ~F.col("deleted")
        checked = checked.when(bad, F.raise_error(F.lit(f"value must have 1 to {MAX_VALUE} bytes")))
    return df.select(*(checked.otherwise(F.col(f"`{c}`")).alias(c) if c == key else F.col(f"`{c}`") for c in df.columns))
