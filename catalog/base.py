"""Registration of queries and helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-08-01 00:00:00"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compact(findings: DataFrame, *extra: str) -> DataFrame:
    """Findings with the example rows as text, so that any client compares them alike."""
    rows = F.array_join(F.col("sample_rows").cast("array<string>"), ",").alias("sample_rows")
    return findings.select("rule_id", "severity", "category", "column", "affected_rows", rows, *extra)


def row_rule_sql(rule_id: str, category: str, column: str | None, source: str, violated: str,
                 key: str, severity: str = "error", extra: str = "") -> str:
    """SQL of one finding: how many rows break the rule, and the ten smallest keys."""
    shown = "CAST(NULL AS VARCHAR)" if column is None else f"'{column}'"
    return f"""
        SELECT '{rule_id}' AS rule_id, '{severity}' AS severity, '{category}' AS category,
               {shown} AS "column", CAST(count(*) AS BIGINT) AS affected_rows,
               (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k)
                FROM (SELECT {key} AS k FROM {source} WHERE {violated} ORDER BY k LIMIT 10)) AS sample_rows{extra}
        FROM {source} WHERE {violated} HAVING count(*) > 0"""
