"""Loose text-to-value coercions as built-in Spark expressions (no Python UDF).

Every function takes a column and its Spark type, because a typed Parquet column
needs no parsing at all while text from CSV or JSON has to be read leniently: a
value that cannot be read becomes NULL and is reported, it never fails the job.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted boolean words and the text patterns of logical types.
BOOLEAN_WORDS = ("true", "false", "0", "1", "yes", "no", "y", "n")
EMAIL = r"[^\s@]+@[^\s@]+\.[^\s@]+"
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
UUID_HEX = r"^[0-9a-fA-F]{32}$"
INTEGER_EPSILON = 1e-12
ZONED = r"(?i):\d{2}.*(Z|UTC|GMT|UT|[+-]\d{1,2}(:?\d{2})?(:\d{2})?|[A-Z]+/[A-Z_/]+)$"

# Date layouts tried in order for text that is not ISO 8601
# (month first, then day first), grouped by the shape that selects them.
DATE_LAYOUTS = {
    r"^\d{1,2}/\d{1,2}/\d{4}": ("M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]"),
    r"^\d{1,2}-\d{1,2}-\d{4}": ("M-d-yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]"),
    r"^\d{4}/\d{1,2}/\d{1,2}": ("yyyy/M/d[ H:mm[:ss]]",),
    r"^\d{8}$": ("yyyyMMdd",),
    r"^[A-Za-z]{3} ": ("MMM d yyyy", "MMM d, yyyy"),
    r"^[A-Za-z]{3,9} ": ("MMMM d yyyy", "MMMM d, yyyy"),
    r"^\d{1,2} [A-Za-z]{3,9} ": ("d MMM yyyy", "d MMMM yyyy"),
}
ANY_DATE = "^(?:" + "|".join(shape.lstrip("^") for shape in DATE_LAYOUTS) + ")"

_COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def named(column: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + column.replace("`", "``") + "`")


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def missing(col: Column, dtype: T.DataType) -> Column:
    """NULL or NaN: both count as an absent value."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def as_text(col: Column, dtype: T.DataType) -> Column:
    """The text of a value; nested values become JSON, binary is read as UTF-8."""
    if is_text(dtype):
        return col
    if isinstance(dtype, _COMPLEX):
        return F.to_json(col)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return plain_text(col)
    return col.cast("string")


def plain_text(number: Column) -> Column:
    """A double in plain decimal notation wherever that is how people write it: from 0.0001 up to 1e16."""
    text = number.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    usual = (F.abs(number) >= 1e-4) & (F.abs(number) < 1e16)
    return F.when(text.contains("E") & usual, plain).otherwise(text)


def in_utc(moment: Column) -> Column:
    """A time without zone as an instant, read as UTC whatever the session's zone is."""
    spelled = F.concat(moment.cast("timestamp_ntz").cast("string"), F.lit("Z")).try_cast("timestamp")
    return F.when(F.current_timezone() == "UTC", moment.cast("timestamp")).otherwise(spelled)


def as_number(col: Column, dtype: T.DataType) -> Column:
    """DOUBLE value, or NULL when the value is not a number."""
    if isinstance(dtype, T.DoubleType):
        return F.nanvl(col, F.lit(None).cast("double"))
    if is_number(dtype) or isinstance(dtype, T.BooleanType):
        return as_number(col.cast("double"), T.DoubleType()) if isinstance(dtype, T.FloatType) \
            else col.cast("double")
    if is_text(dtype):
        # try_cast alone would also take '1d' and 'nan'
        return F.when(col.rlike(NUMERIC_TEXT), col.try_cast("double"))
    return F.lit(None).cast("double")


def as_timestamp(col: Column, dtype: T.DataType) -> Column:
    """TIMESTAMP value (UTC session), or NULL when the value is not a date or time."""
    if isinstance(dtype, T.TimestampType):
        return col
    if is_time(dtype):
        return in_utc(col)
    if is_number(dtype):
        # bare numbers count as nanoseconds since the epoch
        return F.timestamp_micros((as_number(col, dtype) / 1000).try_cast("bigint"))
    if not is_text(dtype):
        return F.lit(None).cast("timestamp")
    v = strip(col)
    iso = F.when(v.rlike(ZONED), v.try_cast("timestamp")).otherwise(in_utc(v.try_cast("timestamp_ntz")))
    parsed = F.when(v.rlike(r"^\d{4}([^\d/]|$)"), iso)
    # most text is no date at all: one look turns it away before the layouts are tried
    parsed = parsed.when(~v.rlike(ANY_DATE), F.lit(None).cast("timestamp"))
    for shape, layouts in DATE_LAYOUTS.items():
        tries = [F.try_to_timestamp(v, F.lit(layout)) for layout in layouts]
        parsed = parsed.when(v.rlike(shape), in_utc(F.coalesce(*tries)))
    return parsed


def whole_match(text: Column, pattern: str) -> Column:
    """True when the whole text matches, newline at the end included.

    Flags: Unicode classes, and only ``\\n`` ends a line. Python's spelling of named
    groups and of the end anchor is turned into Java's.
    """
    java = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", java)
    java = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", java)
    return text.rlike(r"(?dU)\A(?:" + java + r")\z")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\r\f\v"))


def is_boolean_word(col: Column, dtype: T.DataType) -> Column:
    return F.lower(strip(as_text(col, dtype))).isin(*BOOLEAN_WORDS)


def is_uuid(col: Column, dtype: T.DataType) -> Column:
    bare = F.regexp_replace(as_text(col, dtype), "urn:|uuid:", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[{}]+|[{}]+$", ""), "-", "")
    return bare.rlike(UUID_HEX)


def is_integral(number: Column) -> Column:
    """Finite and whole, within a small epsilon (inf - inf is NaN, so it fails)."""
    return F.abs(number - F.rint(number)) <= INTEGER_EPSILON


def equals_any(col: Column, dtype: T.DataType, values: list[Any]) -> Column:
    """Typed membership: 1 does not equal '1'. Values of another kind never match."""
    numbers = [v for v in values if isinstance(v, (int, float))]
    texts = [v for v in values if isinstance(v, str)]
    if is_text(dtype):
        return col.isin(*texts) if texts else F.lit(False)
    if isinstance(dtype, T.BooleanType):
        truths = [bool(v) for v in numbers if v in (0, 1)]
        return col.isin(*truths) if truths else F.lit(False)
    if is_number(dtype):
        if not numbers:
            return F.lit(False)
        whole = [int(v) for v in numbers if float(v).is_integer() and abs(v) < 2**63]
        if isinstance(dtype, T.IntegralType):
            return col.cast("bigint").isin(*whole) if whole else F.lit(False)
        return col.cast("double").isin(*[float(v) for v in numbers])
    if is_time(dtype) and values:
        moments = [as_timestamp(F.lit(str(v)), T.StringType()) for v in values]
        return F.coalesce(as_timestamp(col, dtype).isin(*moments), F.lit(False))
    return F.lit(False)
