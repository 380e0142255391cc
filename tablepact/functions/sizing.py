"""Deciding what may be broadcast: only data measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions.coercion import as_text, is_text, named

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 32  # rough bytes per hashed row besides its values
FIXED_WIDTH = 8


def measured_bytes(df: DataFrame, columns: list[str]) -> int:
    """Rough size of the columns once held in memory, from one distributed aggregate.

    Numbers and times have a fixed width, so for those the rows are only counted.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    wide = [c for c in columns if is_text(types[c]) or isinstance(
        types[c], (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))]
    texts = [F.coalesce(F.sum(F.octet_length(as_text(named(c), types[c])).cast("bigint")), F.lit(0)).alias(f"w{i}")
             for i, c in enumerate(wide)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *texts).first()
    return row["rows"] * (ROW_OVERHEAD + FIXED_WIDTH * len(columns)) + sum(row[f"w{i}"] for i in range(len(wide)))


def fits_broadcast(df: DataFrame, columns: list[str], limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df, columns) <= limit
