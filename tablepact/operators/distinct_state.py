"""Distinct counts that can be kept at rest and merged.

Each part of a table (a file, a day, a micro-batch) leaves one row per column: row and null counts and a theta
sketch of its values. Rows of parts add up to those of the whole without reading the data again, and
a new part costs only its own scan.

A sketch holds the ``2 ** log2_entries`` smallest hashes of the values it has seen: while there are fewer values, it
counts them exactly; beyond, it estimates, with a relative error of one standard deviation of ``2 ** (-log2_entries / 2)``. Counts up
to half its entries are reported as exact (an estimate that low is tens of standard deviations away from any larger
count); above, the count is flagged and has a lower and an upper bound of ``SIGMAS`` standard deviations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions.coercion import as_text, missing, named

LOG2_ENTRIES = 12
SIGMAS = 4


def _hashable(dtype: T.DataType, column: str) -> Column:
    """A value the sketch takes: whole numbers as they are, others by a 64-bit hash of their text; missing ones are NULL."""
    col = named(column)
    value = col.cast("bigint") if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else F.xxhash64(as_text(col, dtype))
    return F.when(~missing(col, dtype), value)


def distinct_parts(df: DataFrame, part: Column, columns: list[str] | None = None, log2_entries: int = LOG2_ENTRIES) -> DataFrame:
    """part, column, row_count, null_count, sketch: one scan, a few KB per part, column and task are shuffled."""
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = columns or df.columns
    made = df.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("row_count"),
        *(F.count_if(missing(named(c), types[c])).alias(f"n{i}") for i, c in enumerate(columns)),
        *(F.theta_sketch_agg(_hashable(types[c], c), log2_entries).alias(f"s{i}") for i, c in enumerate(columns)))
    rows = [F.struct(F.lit(c).alias("column"), F.col("row_count"), F.col(f"n{i}").alias("null_count"), F.col(f"s{i}").alias("sketch"))
            for i, c in enumerate(columns)]
    return made.select("part", F.explode(F.array(*rows)).alias("r")).select("part", "r.*")


def merged_parts(parts: DataFrame, by: list[str] | None = None, log2_entries: int = LOG2_ENTRIES) -> DataFrame:
    """The same rows without the part (or for each value of ``by``): disjoint rows add up, sketches unite."""
    return parts.groupBy(*(by or []), "column").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.theta_union_agg("sketch", log2_entries).alias("sketch"))


def distinct_of_parts(parts: DataFrame, by: list[str] | None = None, log2_entries: int = LOG2_ENTRIES) -> DataFrame:
    """column, row_count, null_count, distinct_count, distinct_count_exact, distinct_at_least, distinct_at_most from stored parts."""
    merged = merged_parts(parts, by, log2_entries).withColumn("distinct_count", F.theta_sketch_estimate("sketch"))
    exact, error = F.col("distinct_count") <= (1 << log2_entries) // 2, SIGMAS * 2 ** (-log2_entries / 2)
    bound = lambda factor, rounded: F.when(exact, F.col("distinct_count")).otherwise(rounded(F.col("distinct_count") * factor))
    filled = F.col("row_count") - F.col("null_count")
    return merged.select(
        *(by or []), "column", "row_count", "null_count", "distinct_count", exact.alias("distinct_count_exact"),
        F.greatest(bound(1 - error, F.floor), F.least(F.col("distinct_count"), F.lit((1 << log2_entries) // 2))).alias("distinct_at_least"),
        F.least(bound(1 + error, F.ceil), filled).alias("distinct_at_most"))


def refreshed_parts(stored: DataFrame, df: DataFrame, part: Column, columns: list[str] | None = None,
                    log2_entries: int = LOG2_ENTRIES) -> DataFrame:
    """Stored parts with those of ``df`` put in: parts of the same name are replaced, only ``df`` is read."""
    new = distinct_parts(df, part, columns, log2_entries)
    return stored.join(new.select("part").distinct(), "part", "left_anti").unionByName(new)


def overlap_of_parts(parts: DataFrame, left: Column, right: Column, log2_entries: int = LOG2_ENTRIES) -> DataFrame:
    """column, both, only_left, only_right: how many distinct values two selections of parts share, by their sketches alone."""
    side = lambda which, name: parts.where(which).groupBy("column").agg(F.theta_union_agg("sketch", log2_entries).alias(name))
    met = reduce(lambda a, b: a.join(b, "column", "full"), [side(left, "l"), side(right, "r")])
    count = lambda sketch: F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("bigint"))
    return met.select("column", count(F.theta_intersection("l", "r")).alias("both"),
                      F.coalesce(F.theta_sketch_estimate(F.theta_difference("l", "r")), count("l")).alias("only_left"),
                      F.coalesce(F.theta_sketch_estimate(F.theta_difference("r", "l")), count("r")).alias("only_right"))
