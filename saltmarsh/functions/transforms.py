"""Partition transforms as column expressions. NULL stays NULL, and its rows stay in the default partition."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.errors import InvalidArgument

TRANSFORMS = ("identity", "year", "month", "day", "hour", "bucket", "truncate")
#: Layouts of dates in strings, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy")


class PartitionField(NamedTuple):
    source: str
    transform: str
    param: int | None = None
    name: str | None = None

    @property
    def column(self) -> str:
        """The derived column; never the source's own name, as the source stays in the files."""
        suffix = f"{self.transform}{self.param or ''}"
        return self.name if self.name and self.name != self.source else f"{self.source}_{suffix}"


def check_field(field: PartitionField, schema: T.StructType) -> None:
    if field.transform not in TRANSFORMS:
        raise InvalidArgument(f"unknown transform {field.transform}")
    if field.source not in schema.fieldNames():
        raise InvalidArgument(f"unknown column {field.source}")
    if field.transform in ("bucket", "truncate") and not (isinstance(field.param, int) and field.param > 0):
        raise InvalidArgument(f"{field.transform} needs a positive parameter")
    kind = schema[field.source].dataType
    if field.transform == "truncate" and not isinstance(kind, T.StringType | T.IntegralType):
        raise InvalidArgument(f"truncate of {kind.simpleString()}")
    if field.transform in ("year", "month", "day", "hour") and not isinstance(kind, T.StringType | T.TimestampType | T.TimestampNTZType | T.DateType):
        raise InvalidArgument(f"{field.transform} of {kind.simpleString()}")


def string_date(c: Column) -> Column:
    """The time that a string holds in one of the layouts; a string that fits none is an error."""
    # Each layout has its own shape, so only one is parsed; failed parses are what costs.
    found = F.lit(None).cast("timestamp")
    for layout in (x for f in DATE_FORMATS for x in (f, f"{f} HH:mm:ss")):
        shape = "^" + re.sub("[a-zA-Z]", "[0-9]", layout) + "$"
        found = F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(layout))).otherwise(found)
    return F.when(c.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("not a date: "), c))).otherwise(found)


def transform(field: PartitionField, kind: T.DataType) -> Column:
    """The partition value of a column of type ``kind``."""
    c = F.col(f"`{field.source}`")
    if field.transform == "identity":
        return c.cast("string")
    if field.transform in ("year", "month", "day", "hour"):
        at = string_date(c) if isinstance(kind, T.StringType) else c
        return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}[field.transform](at)
    if field.transform == "bucket":
        if isinstance(kind, T.IntegralType):
            return F.pmod(c, F.lit(field.param)).cast("int")
        if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
            return F.pmod(c.cast("bigint"), F.lit(field.param)).cast("int")
        # Other types have no portable hash in the design followed; ours is XXH64 of the text.
        hashed = F.xxhash64(c.cast("binary" if isinstance(kind, T.BinaryType) else "string"))
        return F.when(c.isNotNull(), F.pmod(hashed, F.lit(field.param)).cast("int"))
    if field.transform == "truncate":
        if isinstance(kind, T.StringType):
            return F.substring(c, 1, field.param)
        width = 10**field.param
        return F.expr(f"(cast(`{field.source}` as bigint) div {width}L) * {width}L") if width < 2**63 else F.when(c.isNotNull(), F.lit(0).cast("bigint"))
    raise InvalidArgument(f"unknown transform {field.transform}")
