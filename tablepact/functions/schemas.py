"""Flat table schemas as constants, usable before a session exists."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<bigint>": T.ArrayType(T.LongType()),
}


def flat_schema(columns: str) -> T.StructType:
    """``"name type, name type"`` as a StructType."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])
