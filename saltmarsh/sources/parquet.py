"""Reading single Parquet files: columns by name or position, row groups, paging."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.errors import InvalidArgument, SchemaMismatch
from saltmarsh.functions.scalar import result_text

_log = logging.getLogger(__name__)


def read(spark: SparkSession, path: str, columns: Sequence[str | int] | None = None) -> DataFrame:
    """Whole file, or some columns in the order given. Unknown names are left out with a warning; it is an error if
    none is known, or a position is out of range."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    names: list[str] = []
    for c in columns:
        if isinstance(c, int):
            if not 0 <= c < len(df.columns):
                raise InvalidArgument(f"column {c} of {len(df.columns)}")
            names.append(df.columns[c])
        elif c in df.columns:
            names.append(c)
        else:
            _log.warning("%s has no column %s", path, c)
    if columns and not names:
        raise InvalidArgument("none of the columns is in the file")
    return df.select(*(F.col(f"`{n}`") for n in names))


def _file(path: str) -> pq.ParquetFile:
    own, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pq.ParquetFile(own.open_input_file(place))


def row_groups(path: str) -> int:
    """From the file's footer alone."""
    return _file(path).metadata.num_row_groups


def read_row_group(spark: SparkSession, path: str, group: int, columns: Sequence[str] | None = None) -> DataFrame:
    """One row group; the split is Arrow's, as Spark's own splits are by bytes."""
    file = _file(path)
    if not 0 <= group < file.metadata.num_row_groups:
        raise InvalidArgument(f"row group {group} of {file.metadata.num_row_groups}")
    return spark.createDataFrame(file.read_row_group(group, columns=list(columns) if columns else None))


def write(df: DataFrame, path: str, mode: str = "error") -> None:
    if not df.columns:
        raise SchemaMismatch("a file needs a column")
    df.write.mode(mode).parquet(path)


class Page(NamedTuple):
    rows: DataFrame
    total_rows: int
    has_more: bool


def page(spark: SparkSession, path: str, columns: Sequence[str] | None = None, start_row: int = 0, num_rows: int = 100) -> Page:
    """Rows from ``start_row`` in file order, every value as text; NULLs stay NULL."""
    if start_row < 0 or num_rows < 0:
        raise InvalidArgument("rows can't be negative")
    df = read(spark, path, columns)
    total = df.count()
    rows = df.offset(start_row).limit(num_rows).select(*(result_text(F.col(f"`{n}`"), kind).alias(n) for n, kind in df.dtypes))
    return Page(rows, total, start_row + num_rows < total)
