"""Logical types: their text grammar, Spark types, and stable field ids."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import types as T

#: Names of the plain types (fixed values), and what Spark calls them.
PLAIN: dict[str, T.DataType] = {
    "BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(), "STRING": T.StringType(),
    "BYTES": T.BinaryType(), "BLOB": T.BinaryType(), "DATE": T.DateType(),
}
_SIZED = re.compile(r"^(DECIMAL|NUMERIC|DEC|BINARY|VARBINARY|TIMESTAMP_LTZ|TIMESTAMP)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?(\s+WITH LOCAL TIME ZONE)?$")
#: Timestamp precisions that a table may declare.
PRECISIONS = (0, 3, 6, 9)


def parse(text: str | dict) -> T.DataType:
    """Spark type of a logical type. Precision 9 is kept as microseconds."""
    if isinstance(text, dict):
        return _parse_nested(text)
    name = re.sub(r"\s+NOT NULL$", "", text.strip().upper())
    if name in PLAIN:
        return PLAIN[name]
    m = _SIZED.match(name)
    if not m:
        raise ValueError(f"unsupported type: {text}")
    kind, a, b, zoned = m.groups()
    if kind in ("DECIMAL", "NUMERIC", "DEC"):
        return T.DecimalType(int(a or 10), int(b or 0))
    if kind in ("BINARY", "VARBINARY"):
        return T.BinaryType()
    if int(a or 6) not in PRECISIONS:
        raise ValueError(f"timestamp precision must be one of {PRECISIONS}: {text}")
    return T.TimestampType() if zoned or kind == "TIMESTAMP_LTZ" else T.TimestampNTZType()


def _parse_nested(node: dict) -> T.DataType:
    kind = node["type"].replace(" NOT NULL", "")
    if kind == "ARRAY":
        return T.ArrayType(parse(node["element"]))
    if kind == "MAP":
        return T.MapType(parse(node["key"]), parse(node["value"]))
    if kind == "ROW":
        return T.StructType([field_of(f) for f in node["fields"]])
    raise ValueError(f"unsupported type: {node}")


def show(kind: T.DataType, nullable: bool = True) -> str | dict:
    """The logical type's text (or nested form) of a Spark type."""
    end = "" if nullable else " NOT NULL"
    if isinstance(kind, T.ArrayType):
        return {"type": "ARRAY" + end, "element": show(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "MAP" + end, "key": show(kind.keyType), "value": show(kind.valueType)}
    if isinstance(kind, T.StructType):
        return {"type": "ROW" + end, "fields": [show_field(f) for f in kind.fields]}
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision}, {kind.scale}){end}"
    if isinstance(kind, T.TimestampNTZType):
        return f"TIMESTAMP(6){end}"
    if isinstance(kind, T.TimestampType):
        return f"TIMESTAMP(6) WITH LOCAL TIME ZONE{end}"
    for name, known in PLAIN.items():
        if known == kind and name not in ("INTEGER", "DOUBLE PRECISION"):
            return name + end
    raise ValueError(f"unsupported type: {kind.simpleString()}")


def field_of(node: dict[str, Any]) -> T.StructField:
    text = node["type"] if isinstance(node["type"], str) else node["type"]["type"]
    meta = {"field_id": node["id"]} | ({"comment": node["description"]} if node.get("description") else {})
    return T.StructField(node["name"], parse(node["type"]), not text.endswith("NOT NULL"), meta)


def show_field(f: T.StructField) -> dict[str, Any]:
    out = {"id": f.metadata["field_id"], "name": f.name, "type": show(f.dataType, f.nullable)}
    return out | ({"description": f.metadata["comment"]} if f.metadata.get("comment") else {})


def with_ids(schema: T.StructType, first: int = 0) -> tuple[T.StructType, int]:
    """Fields numbered in depth from ``first``, and the next free number."""
    free = first

    def number(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([give(f) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(number(kind.elementType), kind.containsNull)
        if isinstance(kind, T.MapType):
            return T.MapType(number(kind.keyType), number(kind.valueType), kind.valueContainsNull)
        return kind

    def give(f: T.StructField) -> T.StructField:
        nonlocal free
        own, free = free, free + 1
        return T.StructField(f.name, number(f.dataType), f.nullable, {**f.metadata, "field_id": own})

    return T.StructType([give(f) for f in schema.fields]), free


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType | T.MapType | T.StructType)


def atomic_name(kind: T.DataType) -> str:
    """A short name of an atomic type, without sizes."""
    if is_nested(kind):
        raise ValueError(f"not an atomic type: {kind.simpleString()}")
    return kind.simpleString().split("(")[0]
