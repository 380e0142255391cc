"""Fingerprints of a table's ranges that add up, compared as a tree.

Every range (a block of keys, a file, a day) has its row count and the sums of three slices of its rows' digests. Sums do not
depend on row order and add up: the fingerprint of a node is the sum of its children's, the root's is the table's.
Two versions are compared from the root down; a node whose sums agree is not looked into, so what is joined shrinks with
the changes, and only the rows of ranges that differ are read and hashed again to say what changed in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.functions.coercion import named
from tablepact.functions.hashing import row_digest

FANOUT = 64
SUMS = ("row_count", "sum_1", "sum_2", "sum_3")


def range_fingerprints(df: DataFrame, part: Column, columns: list[str] | None = None) -> DataFrame:
    """part (a whole number), row_count and three sums: one pass, one row per part and task is shuffled."""
    digest = row_digest(df, columns)
    slices = [F.sum(F.conv(F.substring(digest, start, 8), 16, 10).cast("decimal(38,0)")).alias(f"sum_{i}") for i, start in enumerate((1, 9, 17), 1)]
    return df.groupBy(part.cast("bigint").alias("part")).agg(F.count(F.lit(1)).alias("row_count"), *slices)


def rolled_up(parts: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above: part // fanout, sums added."""
    above = F.floor(F.col("part") / fanout).alias("part")
    return parts.groupBy(above).agg(*[F.sum(c).alias(c) for c in SUMS])


def table_fingerprint(parts: DataFrame) -> DataFrame:
    """row_count, data_fingerprint of all parts together, whatever they are cut into."""
    whole = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS])
    return whole.select("row_count", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in SUMS]), 256).alias("data_fingerprint"))


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """part, rows_old, rows_new of nodes that are not the same on both sides; absent nodes have no rows."""
    mine = [F.col(c).alias(f"old_{c}") for c in SUMS]
    met = old.select("part", *mine).join(new, "part", "full")
    same = F.lit(True)
    for c in SUMS:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(c))
    return met.where(~same).select("part", F.coalesce("old_row_count", F.lit(0).cast("bigint")).alias("rows_old"),
                                   F.coalesce("row_count", F.lit(0).cast("bigint")).alias("rows_new"))


def changed_parts(old: DataFrame, new: DataFrame, levels: int = 2, fanout: int = FANOUT) -> DataFrame:
    """part, rows_old, rows_new of the ranges that differ. ``levels`` upper levels narrow what the lowest one compares."""
    trees = [[old], [new]]
    for tree in trees:
        for _ in range(levels):
            tree.append(rolled_up(tree[-1], fanout))
    found = None
    for level in range(levels, -1, -1):
        sides = [tree[level] for tree in trees]
        if found is not None:  # children of differing nodes only
            above = found.select(F.col("part").alias("above"))
            sides = [s.join(above, F.floor(s["part"] / fanout) == F.col("above"), "left_semi") for s in sides]
        found = _differing(*sides)
    return found


def changed_rows(old: DataFrame, new: DataFrame, parts: DataFrame, part: Column, key: str, columns: list[str] | None = None) -> DataFrame:
    """part, key, change ('added', 'removed', 'edited') within the given ranges; rows of other ranges are not hashed.

    Rows are counted per key and digest, so repeated keys and rows are told apart by how often they stand.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        held = df.withColumn("_part", part.cast("bigint")).join(parts.select(F.col("part").alias("_part")), "_part", "left_semi")
        return held.select(F.col("_part").alias("part"), named(key).alias("key"), row_digest(df, columns).alias("digest"), F.lit(sign).alias("sign"))

    rows = side(old, -1).unionByName(side(new, 1)).groupBy("part", "key", "digest").agg(F.sum("sign").alias("times")).where("times <> 0")
    per_key = rows.groupBy("part", "key").agg(F.count_if(F.col("times") < 0).alias("gone"), F.count_if(F.col("times") > 0).alias("come"))
    return per_key.select("part", "key", F.when((F.col("gone") > 0) & (F.col("come") > 0), "edited").when(F.col("come") > 0, "added")
                          .otherwise("removed").alias("change"))
