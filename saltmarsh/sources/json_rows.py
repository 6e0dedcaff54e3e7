"""Strict ingest of JSON: an array of objects, or one object a line, against a declared schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.errors import InvalidArgument

RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _fail(name: str, what: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{name}: {what}: "), F.coalesce(value, F.lit("null"))))


def _typed(field: T.StructField) -> Column:
    """A column from its JSON text in map ``_m`` (absent and null: NULL). Spark's parser keeps the quotes out of strings, so
    the kind of each value is taken from the raw text in ``_raw``."""
    raw, kind, name = F.col("_raw").getItem(field.name), field.dataType, field.name
    number = raw.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    whole = raw.rlike(r"^-?(0|[1-9][0-9]*)$")
    if isinstance(kind, T.IntegralType):
        good, value = whole & raw.try_cast(kind).isNotNull(), raw.try_cast(kind)
    elif isinstance(kind, T.DecimalType):
        good, value = whole & ~raw.startswith("-") & (raw.try_cast("decimal(38,0)") < F.lit(str(2**64)).cast("decimal(38,0)")), raw.try_cast(kind)
    elif isinstance(kind, T.FractionalType):
        good, value = number, raw.try_cast(kind)
    elif isinstance(kind, T.BooleanType):
        good, value = raw.isin("true", "false"), raw.try_cast("boolean")
    elif isinstance(kind, T.StringType | T.BinaryType):
        text = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
        good, value = raw.startswith('"'), text.cast(kind)
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        good, value = whole, F.timestamp_millis(raw.try_cast("bigint")).cast(kind)
    else:
        raise InvalidArgument(f"{name}: no JSON form of {kind.simpleString()}")
    out = F.when(raw.isNull() | (raw == "null"), F.lit(None) if field.nullable else _fail(name, "NOT NULL", raw))
    return out.when(good, value).otherwise(_fail(name, f"not a {kind.simpleString()}", raw)).cast(kind).alias(name)


def from_raw(objects: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows from a column ``_raw`` map<string,string> of each key's raw JSON text."""
    return objects.select(*(_typed(f) for f in schema))


def _raw_map(text: str) -> dict[str, str]:
    value = json.loads(text)
    if not isinstance(value, dict):
        raise InvalidArgument("not an object")
    return {k: json.dumps(v, ensure_ascii=False) for k, v in value.items()}


def parse_array(spark: SparkSession, text: str, schema: T.StructType) -> DataFrame:
    """Rows of one JSON text that must be an array of objects; [] has none. Unknown keys are left out. The text comes with
    a request, so it is parsed here; for files use read_lines()."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise InvalidArgument(f"malformed JSON at {e.pos}: {e.msg}") from None
    if not isinstance(found, list):
        raise InvalidArgument("the top level must be an array")
    if any(not isinstance(x, dict) for x in found):
        raise InvalidArgument("every element must be an object")
    names = set(schema.fieldNames())
    rows = [({k: json.dumps(v, ensure_ascii=False) for k, v in x.items() if k in names},) for x in found]
    return from_raw(spark.createDataFrame(rows, "_raw map<string,string>"), schema)


def read_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of a frame with one JSON object a row in column ``value``, as spark.read.text() gives: JVM-side and lazy.

    Spark's reader is strict about numbers and booleans in FAILFAST mode; what it lets pass (any value for a string,
    NULL for NOT NULL, no numbers for times) is checked here.
    """
    shape = T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType) else T.DecimalType(38, 0) if isinstance(f.dataType, T.DecimalType) else T.StringType() if isinstance(f.dataType, T.BinaryType) else f.dataType) for f in schema])
    own = lines.select("value", F.when(F.trim("value").startswith("{"), F.from_json("value", shape, {"mode": "FAILFAST"})).otherwise(F.raise_error(F.lit("not a JSON object"))).alias("_o"))
    out = []
    for f in schema:
        c, kind = F.col("_o").getField(f.name), f.dataType
        if isinstance(kind, T.StringType | T.BinaryType):
            raw = F.to_json(F.from_json("value", T.StructType([T.StructField(f.name, T.VariantType())])))
            marked = F.col("value").isNull() | c.isNull() | raw.rlike(r'^\{"' + "".join("\\" + x if not x.isalnum() and x != "_" else x for x in f.name) + r'":"')
            c = F.when(~marked, _fail(f.name, "not a string", c)).otherwise(c).cast(kind)
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            c = F.timestamp_millis(c).cast(kind)
        elif isinstance(kind, T.DecimalType):
            c = F.when((c < 0) | (c >= F.lit(str(2**64)).cast("decimal(38,0)")), _fail(f.name, "out of range", c.cast("string"))).otherwise(c).cast(kind)
        if not f.nullable:
            c = F.when(c.isNull(), _fail(f.name, "NOT NULL", F.lit(None).cast("string"))).otherwise(c)
        out.append(c.alias(f.name))
    return own.select(*out)
