"""Writing findings as evidence: counts and row keys, never raw cell values."""

from __future__ import annotations

from pyspark.sql import DataFrame

EVIDENCE_FORMATS = ("json", "parquet")


def write_findings(findings: DataFrame, path: str, format: str = "json",
                   partition_by: list[str] | None = None) -> None:
    """One file per task, or one folder per partition value; commits are Spark's."""
    if format not in EVIDENCE_FORMATS:
        raise ValueError(f"unsupported report format: {format}")
    writer = findings.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(format).save(path)
