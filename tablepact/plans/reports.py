"""Report-shaped tables: SARIF rules and results, JUnit counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablepact.operators.findings import finding_order

# Report level of each severity, and the fallback help text.
SARIF_LEVEL = {"info": "note", "warning": "warning", "error": "error", "critical": "error"}
SARIF_HELP = "Review the data contract finding."


def sarif_rules(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The first finding of each rule describes the rule."""
    keys = [*(by or []), "rule_id"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*finding_order()))
    return findings.withColumn("_nth", first).where(F.col("_nth") == 1).select(
        *keys, F.col("title").alias("name"), F.col("title").alias("short_description"),
        F.col("message").alias("full_description"),
        F.coalesce("remediation", F.lit(SARIF_HELP)).alias("help"), "category")


def sarif_results(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One result per finding; the line counts the header, so it is the row plus one."""
    levels = F.create_map(*[F.lit(x) for pair in SARIF_LEVEL.items() for x in pair])
    return findings.select(
        *(by or []), "rule_id", levels[F.col("severity")].alias("level"), "message", "severity",
        "category", "affected_rows", (F.get("sample_rows", F.lit(0)) + 1).alias("start_line"))


def sarif_json(results: DataFrame) -> DataFrame:
    """Results as JSON text, one document per row, ready for a text sink."""
    body = F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.struct("severity", "category", F.col("affected_rows").alias("affectedRows")).alias("properties"),
        F.when(F.col("start_line").isNotNull(), F.array(F.struct(F.struct(F.struct(
            F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation")))
        ).alias("locations"))
    return results.select(F.to_json(body).alias("value"))


def junit_counts(runs: DataFrame, findings: DataFrame, by: list[str]) -> DataFrame:
    """Test counters per run: severe findings fail, mild ones are skipped, a clean run is one passed test."""
    counts = findings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tests"),
        F.count_if(F.col("severity").isin("error", "critical")).alias("failures"),
        F.count_if(F.col("severity").isin("warning", "info")).alias("skipped"))
    zero = F.lit(0).cast("bigint")
    return runs.select(*by).distinct().join(counts, by, "left").select(
        *by, F.coalesce("tests", F.lit(1).cast("bigint")).alias("tests"),
        F.coalesce("failures", zero).alias("failures"), F.coalesce("skipped", zero).alias("skipped"))
