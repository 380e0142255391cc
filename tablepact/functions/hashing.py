"""Stable ids, key digests and the dataset fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.functions.coercion import as_text, missing, named

FINDING_ID_LENGTH = 16  # fixed value: hex characters kept of the SHA-256
LONG_KEY = 64  # text keys longer than this are grouped by their digest


def finding_id(rule_id: Column, column: Column, message: Column) -> Column:
    """The same rule, column and message always give the same id."""
    material = F.concat(rule_id, F.lit("|"), F.coalesce(column, F.lit("")), F.lit("|"), message)
    return F.substring(F.sha2(material, 256), 1, FINDING_ID_LENGTH)


def key_digest(*texts: Column) -> Column:
    """SHA-256 of a composite key, so raw values need not be stored.

    A part that is NULL becomes the word NULL; a key with no value at all has none.
    """
    parts = [F.coalesce(F.sha2(t, 256), F.lit("NULL")) for t in texts]
    return F.when(F.coalesce(*texts).isNotNull(), F.sha2(F.concat_ws("|", *parts), 256))


def compact_key(text: Column) -> Column:
    """Long text replaced by a digest before a shuffle: whole documents never travel.

    The digest form is longer than any text kept as it is, so the two never meet.
    """
    return F.when(F.length(text) > LONG_KEY, F.concat(F.lit("sha256:"), F.sha2(text, 256))) \
        .otherwise(text)


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 over the row's values; each is led by its length, and NULL is marked."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [
        F.when(missing(named(c), types[c]), F.lit("-"))
        .otherwise(F.concat(F.length(as_text(named(c), types[c])).cast("string"), F.lit("+"), as_text(named(c), types[c])))
        for c in columns or df.columns
    ]
    return F.sha2(F.concat(*parts), 256)


def dataset_fingerprint(df: DataFrame, columns: list[str] | None = None,
                        by: list[str] | None = None) -> DataFrame:
    """Identity of the data (or of each group) whatever its order or partitioning, in one pass.

    Names and types of the columns belong to it. Three 20-bit slices of each row's digest are summed apart, which stays inside
    BIGINT up to 8e12 rows; duplicates count, unlike with XOR.
    """
    digest = row_digest(df, columns)
    slices = [
        F.sum(F.conv(F.substring(digest, start, 5), 16, 10).cast("bigint")).alias(f"part_{i}")
        for i, start in enumerate((1, 6, 11), 1)
    ]
    by = by or []
    sums = df.groupBy(*[named(b) for b in by]).agg(F.count(F.lit(1)).alias("row_count"), *slices)
    parts = [F.coalesce(F.col(f"part_{i}"), F.lit(0)).cast("string") for i in (1, 2, 3)]
    schema = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns or df.columns)
    text = F.concat_ws(":", F.lit(schema), F.col("row_count").cast("string"), *parts)
    return sums.select(*[named(b) for b in by], "row_count", F.sha2(text, 256).alias("data_fingerprint"))
