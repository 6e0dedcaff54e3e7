"""Relational operators whose conventions (names, null order, counting) go beyond plain DataFrame calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.errors import InvalidArgument, SchemaMismatch

JOIN_KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
AGGREGATES = ("count", "sum", "avg", "min", "max")


def concat(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """All rows of frames with equal columns (names and types, by position)."""
    shape = [(f.name, f.dataType) for f in first.schema]
    for other in rest:
        if [(f.name, f.dataType) for f in other.schema] != shape:
            raise SchemaMismatch("frames of different columns can't be concatenated")
        first = first.union(other)
    return first


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join of one column pair. The right key is left out where it has the left key's name (for right and
    full joins the key is then taken from the side that has it); other right columns whose names are taken get
    the prefix ``right_``. NULL keys match nothing."""
    kind = JOIN_KINDS.get(how)
    if kind is None:
        raise InvalidArgument(f"unknown join {how}")
    if kind in ("left_semi", "left_anti"):
        keys = right.select(F.col(f"`{right_key}`").alias("__right_key"))
        return left.join(keys, F.col(f"`{left_key}`") == F.col("__right_key"), kind)
    taken, names = set(left.columns), {}
    for c in right.columns:
        if c == right_key and c == left_key:
            continue
        name = f"right_{c}" if c in taken else c
        while name in taken or name in names.values():
            name = f"right_{name}"
        names[c] = name
    other = right.select(F.col(f"`{right_key}`").alias("__right_key"), *(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    both = left.join(other, F.col(f"`{left_key}`") == F.col("__right_key"), kind)
    key = F.coalesce(F.col(f"`{left_key}`"), F.col("__right_key")).alias(left_key) if left_key == right_key else F.col(f"`{left_key}`")
    return both.select(*(key if c == left_key else F.col(f"`{c}`") for c in left.columns), *(F.col(f"`{n}`") for n in names.values()))


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Join on any condition; columns of both sides keep their names."""
    if how not in JOIN_KINDS:
        raise InvalidArgument(f"unknown join {how}")
    return left.join(right, condition, JOIN_KINDS[how])


def aggregate_name(kind: str, column: str) -> str:
    return "count" if column == "*" else f"{kind}_{column}"


def aggregate(df: DataFrame, keys: Sequence[str], calls: Sequence[tuple], null_count_mode: str = "standard") -> DataFrame:
    """Groups by ``keys`` (none: one row) and computes ``calls``: (kind, column) or (kind, column, alias).

    Default names are ``sum_age``, ``avg_age`` and so on, and ``count`` for COUNT(*). ``null_count_mode`` "all"
    lets COUNT(column) count NULLs as well. Sums of integers are bigint.
    """
    if null_count_mode not in ("standard", "all"):
        raise InvalidArgument(f"unknown mode {null_count_mode}")
    out = []
    for kind, column, *alias in calls:
        if kind not in AGGREGATES or (column == "*" and kind != "count"):
            raise InvalidArgument(f"{kind}({column})")
        c = F.lit(1) if column == "*" or (kind == "count" and null_count_mode == "all") else F.col(f"`{column}`")
        out.append(getattr(F, kind)(c).alias(alias[0] if alias else aggregate_name(kind, column)))
    return df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*out) if keys else df.agg(*out)


def group_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(f"`{k}`") for k in keys)).distinct()


def order(df: DataFrame, *by: str | tuple[str, str], nulls_first: bool = True) -> DataFrame:
    """Sorts by columns, or (column, "asc" or "desc"); NULLs come first in both directions unless told otherwise.
    Ties have no order: name enough columns to have one."""
    out = []
    for x in by:
        name, way = (x, "asc") if isinstance(x, str) else x
        if name not in df.columns or way not in ("asc", "desc"):
            raise InvalidArgument(f"order by {x}")
        out.append(getattr(F.col(f"`{name}`"), f"{way}_nulls_{'first' if nulls_first else 'last'}")())
    return df.orderBy(*out)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """``n`` rows after the first ``offset``; past the end there are none."""
    if n < 0 or offset < 0:
        raise InvalidArgument("limit and offset can't be negative")
    return (df.offset(offset) if offset else df).limit(n)
