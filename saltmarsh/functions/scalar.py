"""Scalar helpers whose defaults differ from Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def like(c: Column, pattern: str) -> Column:
    """LIKE without an escape character: a backslash is itself."""
    return c.like(pattern.replace("\\", "\\\\"))


def time_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def interval_text(micros: Column) -> Column:
    """A length of time in microseconds in the largest unit that it fills, with up to three decimals."""
    units = (("d", 86_400_000_000), ("h", 3_600_000_000), ("m", 60_000_000), ("s", 1_000_000), ("ms", 1000))
    size, out = F.abs(micros), F.concat(micros.cast("string"), F.lit("us"))
    for name, width in reversed(units):
        text = F.regexp_replace(F.call_function("format_number", micros / width, F.lit("0.###")), r"\.$", "")
        out = F.when(size >= width, F.concat(text, F.lit(name))).otherwise(out)
    return out


def result_text(c: Column, kind: str) -> Column:
    """A cell as text: floating point numbers with six decimals, booleans as true and false."""
    return F.format_string("%.6f", c.cast("double")) if kind in ("float", "double") else c.cast("string")
