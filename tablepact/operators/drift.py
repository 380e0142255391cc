"""Schema drift of a profile against an approved baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.functions.sqltext import Sql
from tablepact.operators.findings import finding_rows, finding_sql

# Severity of each kind of change.
DRIFT_SEVERITY = {
    "added": "warning", "removed": "error", "type_changed": "error",
    "nullability_changed": "warning",
}


def snapshot(profile: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Baseline rows of a profile: (name, observed_type, nullable_observed)."""
    return profile.select(
        *(by or []), F.col("column").alias("name"), "observed_type",
        (F.col("null_count") > 0).alias("nullable_observed"))


def compare_snapshots(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per change; one full outer join on the column name, no collect.

    A column may yield two changes: its type and its nullability.
    """
    keys = [*(by or []), "name"]
    b = before.select(*keys, F.col("observed_type").alias("b_type"),
                      F.col("nullable_observed").alias("b_null"), F.lit(True).alias("b_here"))
    a = after.select(*keys, F.col("observed_type").alias("a_type"),
                     F.col("nullable_observed").alias("a_null"), F.lit(True).alias("a_here"))
    both = b.join(a, keys, "full_outer")
    in_before, in_after = F.col("b_here").isNotNull(), F.col("a_here").isNotNull()

    def change(kind, when, was, now):
        return F.when(when, F.struct(
            F.lit(kind).alias("change_type"), was.alias("before"), now.alias("after"),
            F.lit(DRIFT_SEVERITY[kind]).alias("severity")))

    none = F.lit(None).cast("string")
    changes = F.array_compact(F.array(
        change("added", in_after & ~in_before, none, F.col("a_type")),
        change("removed", in_before & ~in_after, F.col("b_type"), none),
        change("type_changed", in_before & in_after & ~F.col("b_type").eqNullSafe(F.col("a_type")),
               F.col("b_type"), F.col("a_type")),
        change("nullability_changed", in_before & in_after
               & ~F.coalesce("b_null", F.lit(False)) & F.coalesce("a_null", F.lit(False)),
               F.lit("false"), F.lit("true")),
    ))
    return both.select(*(by or []), F.col("name").alias("column"), F.explode(changes).alias("c")) \
        .select(*(by or []), "c.change_type", "column", "c.before", "c.after", "c.severity")


def drift_findings(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    return finding_rows(changes, finding_sql(
        rule_id=Sql("concat('drift.', change_type)"), severity=Sql("severity"), category="drift",
        title=Sql("concat('Schema drift: ', translate(change_type, '_', ' '))"), column=Sql("`column`"),
        message="Column '{name}' differs from the baseline.", name="`column`",
        expected=Sql("before"), observed=Sql("after"),
        remediation="Review the change and approve a new baseline if it is meant."), keep=by)
