"""Column types: SQL names, Spark types, and the CREATE TABLE subset."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from saltmarsh.errors import InvalidArgument, SchemaMismatch

#: SQL names of column types. Lengths of character types are accepted and have no meaning.
SQL_TYPES: dict[str, T.DataType] = {
    **dict.fromkeys(("INT", "INTEGER"), T.IntegerType()), "BIGINT": T.LongType(), **dict.fromkeys(("FLOAT", "REAL"), T.FloatType()), "DOUBLE": T.DoubleType(),
    **dict.fromkeys(("VARCHAR", "CHAR", "TEXT"), T.StringType()), "BOOLEAN": T.BooleanType(), **dict.fromkeys(("DATETIME", "TIMESTAMP", "DATE", "TIME"), T.TimestampNTZType()),
}

#: Types that only the programmatic interface offers.
API_TYPES: dict[str, T.DataType] = {"UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0), "BINARY": T.BinaryType(), "UUID": T.BinaryType()}

_NAME = r'(?:"[^"]+"|`[^`]+`|[A-Za-z_][A-Za-z0-9_.$-]*)'
_CREATE = re.compile(rf"\s*CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?({_NAME})\s*\((.*)\)\s*;?\s*", re.I | re.S)
_COLUMN = re.compile(rf"\s*({_NAME})\s+([A-Za-z]+)\s*(?:\(\s*\d+(?:\s*,\s*\d+)?\s*\))?\s*(.*)", re.S)


def _bare(name: str) -> str:
    return name[1:-1] if name[0] in '"`' else name


def split_statements(text: str) -> list[str]:
    """Statements between semicolons that are in no quotes."""
    found = re.findall(r"""(?:'(?:[^'\\]|\\.|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|[^;'"`-]|-)+""", text)
    return [x.strip() for x in found if x.strip()]


def parse_create_table(text: str) -> tuple[str, T.StructType, bool]:
    """(table, schema, if not exists) of exactly one CREATE TABLE statement. Columns are nullable by default."""
    statements = split_statements(text)
    if len(statements) != 1:
        raise InvalidArgument("exactly one statement is expected")
    m = _CREATE.fullmatch(statements[0])
    if not m:
        raise InvalidArgument("not a CREATE TABLE statement")
    fields: list[T.StructField] = []
    for part in re.split(r",(?![^(]*\))", m[3]):
        if re.match(r"\s*(PRIMARY\s+KEY|UNIQUE|CONSTRAINT|FOREIGN\s+KEY)\b", part, re.I):
            continue  # parsed and not enforced
        c = _COLUMN.fullmatch(part)
        if not c:
            raise InvalidArgument(f"column definition {part.strip()!r}")
        kind = SQL_TYPES.get(c[2].upper())
        if kind is None:
            raise InvalidArgument(f"unknown type {c[2]}")
        name = _bare(c[1])
        if any(f.name == name for f in fields):
            raise InvalidArgument(f"column {name} is given twice")
        fields.append(T.StructField(name, kind, not re.search(r"\bNOT\s+NULL\b|\bPRIMARY\s+KEY\b", c[3], re.I)))
    if not fields:
        raise InvalidArgument("a table needs a column")
    return _bare(m[2]), T.StructType(fields), bool(m[1])


def check_schema(given: T.StructType, wanted: T.StructType) -> None:
    """The same columns, by position, name and type. Nullability is checked on the rows, not here."""
    if len(given) != len(wanted):
        raise SchemaMismatch(f"{len(given)} columns for a table of {len(wanted)}")
    for g, w in zip(given, wanted):
        if g.name != w.name or g.dataType != w.dataType:
            raise SchemaMismatch(f"column {g.name} {g.dataType.simpleString()} where {w.name} {w.dataType.simpleString()} is expected")
