"""Example rows: the smallest row keys that break each rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablepact.functions.coercion import named
from tablepact.operators.findings import SAMPLE_LIMIT
from tablepact.operators.predicates import RowCheck


def smallest_per_group(rows: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """The ``limit`` smallest rows per group.

    Spark plans a group limit on both sides of the exchange: each task sends at most
    ``limit`` rows per group, so a rule broken by a third of the table stays cheap.
    """
    nth = F.row_number().over(Window.partitionBy(*[named(k) for k in keys]).orderBy(named(order)))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= limit)


def sample_rows(violations: DataFrame, row_key: str, keys: list[str] | None = None,
                limit: int = SAMPLE_LIMIT) -> DataFrame:
    """(rule, column) -> sorted array of at most ``limit`` row keys."""
    keys = keys or ["rule_id", "column"]
    kept = smallest_per_group(
        violations.select(*keys, named(row_key).cast("bigint").alias("_row")), keys, "_row", limit)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("sample_rows"))


def smallest_rows(rows: DataFrame, group: str, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """group (a whole number), sample_rows: the ``limit`` smallest ``_row`` of each group, sorted.

    Tasks keep the smallest rows of each group batch by batch and send only those: nothing is sorted as a whole, however many
    rows break a rule.
    """
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            of, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for g in np.unique(of).tolist():
                mine = np.concatenate([held.get(g, row[:0]), row[of == g]])
                held[g] = np.sort(np.partition(mine, limit - 1)[:limit] if len(mine) > limit else mine)
        yield pa.RecordBatch.from_arrays(
            [pa.array([g for g, r in held.items() for _ in r], pa.int32()), pa.array([k for r in held.values() for k in r.tolist()], pa.int64())],
            names=["group", "_row"])

    few = rows.select(F.col(group).cast("int").alias("group"), "_row").mapInArrow(keep, "group int, _row bigint")
    return few.groupBy(F.col("group").alias(group)).agg(F.slice(F.array_sort(F.collect_list("_row")), 1, limit).alias("sample_rows"))


def check_samples(df: DataFrame, broken: list[RowCheck], row_key: str, limit: int = SAMPLE_LIMIT) -> list[DataFrame]:
    """Example rows of the broken row checks, all looked up in one pass.

    Rows without a row key cannot be named and are left out. What a rule's examples are does
    not depend on how often it is broken or on the size of the table.
    """
    if not broken:
        return []
    marks = [F.when(check.violated, F.lit(i)) for i, check in enumerate(broken)]
    row = named(row_key).cast("bigint")
    rows = df.where(row.isNotNull()).select(row.alias("_row"), F.explode(F.array_compact(F.array(*marks))).alias("check"))
    rules = F.array(*[F.struct(F.lit(c.rule_id).alias("rule_id"), F.lit(c.column).cast("string").alias("column")) for c in broken])
    return [smallest_rows(rows, "check", limit).select(F.get(rules, F.col("check")).alias("r"), "sample_rows").select(
        "r.rule_id", "r.column", "sample_rows")]


def attach_samples(findings: DataFrame, samples: DataFrame) -> DataFrame:
    """Fill ``sample_rows``; both sides hold one row per broken rule."""
    s = samples.select(
        F.col("rule_id").alias("_rule"), F.col("column").alias("_column"),
        F.col("sample_rows").alias("_samples"))
    same = (F.col("rule_id") == F.col("_rule")) & F.col("column").eqNullSafe(F.col("_column"))
    filled = F.coalesce(F.col("_samples"), F.col("sample_rows")).alias("sample_rows")
    return findings.join(s, same, "left").select(
        *[filled if c == "sample_rows" else named(c) for c in findings.columns])
