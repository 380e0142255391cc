"""The findings table: building rows, ranking, capping, counting and merging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablepact.contract import SEVERITY_RANK
from tablepact.functions.hashing import FINDING_ID_LENGTH, finding_id
from tablepact.functions.schemas import flat_schema
from tablepact.functions.sqltext import Sql, quoted

SAMPLE_LIMIT = 10  # fixed value: example rows kept per finding

FINDING_SCHEMA = flat_schema(
    "finding_id string, rule_id string, severity string, category string, title string, "
    "message string, column string, affected_rows bigint, sample_rows array<bigint>, "
    "expected string, observed string, remediation string")
FINDING_COLUMNS = FINDING_SCHEMA.names


def _text(value: str | Sql | None, places: dict[str, str]) -> str:
    """SQL for a text whose ``{name}`` places are filled from SQL fragments."""
    if value is None:
        return "cast(null as string)"
    if isinstance(value, Sql):
        return f"cast({value} as string)"
    parts = [
        f"cast({places[piece[1:-1]]} as string)" if piece[0] == "{" and piece[1:-1] in places else quoted(piece)
        for piece in re.split(r"(\{\w+\})", value) if piece
    ]
    return f"concat({', '.join(parts)})" if len(parts) > 1 else (parts or ["''"])[0]


def percent(ratio: str) -> str:
    return f"format_string('%.2f%%', ({ratio}) * 100)"


def finding_sql(
    *, rule_id, severity, category, title, message, column=None, affected: str = "0L",
    expected=None, observed=None, remediation=None, **places: str,
) -> str:
    """One finding as a SQL struct; ``{n}`` in a text stands for the affected rows.

    SQL rather than Column calls: a contract has many rules, and one parsed expression is
    far cheaper to build from Python than hundreds of column objects.
    """
    places["n"] = affected
    rule, col, said = _text(rule_id, {}), _text(column, {}), _text(message, places)
    values = {
        "finding_id": f"substring(sha2(concat({rule}, '|', coalesce({col}, ''), '|', {said}), 256), "
                      f"1, {FINDING_ID_LENGTH})",
        "rule_id": rule,
        "severity": _text(severity, {}),
        "category": _text(category, {}),
        "title": _text(title, {}),
        "message": said,
        "column": col,
        "affected_rows": f"cast({affected} as bigint)",
        "sample_rows": "cast(array() as array<bigint>)",
        "expected": _text(expected, places),
        "observed": _text(observed, places),
        "remediation": _text(remediation, {}),
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def finding_row(**texts) -> Column:
    return F.expr(finding_sql(**texts))


def finding_rows(df: DataFrame, *structs: str, keep: list[str] | None = None) -> DataFrame:
    """The findings that the SQL structs give for each row of ``df``; NULL ones are left out."""
    kept = [F.col(f"`{k}`") for k in keep or []]
    rows = F.expr(f"explode(array_compact(array({', '.join(structs)})))").alias("f")
    return df.select(*kept, rows).select(*kept, "f.*").select(*kept, *FINDING_COLUMNS)


def no_findings(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], FINDING_SCHEMA)


def severity_rank(severity: Column) -> Column:
    ranked = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANK.items():
        ranked = F.when(severity == name, F.lit(rank)).otherwise(ranked)
    return ranked


def finding_order() -> list[Column]:
    """Most severe first, then by category, rule and column."""
    return [
        severity_rank(F.col("severity")).desc(), F.col("category"), F.col("rule_id"),
        F.coalesce(F.col("column"), F.lit("")), F.col("finding_id"),
    ]


def rank_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*finding_order())


def cap_findings(findings: DataFrame, limit: int,
                 by: list[str] | None = None) -> DataFrame:
    """At most ``limit`` rows of evidence per run: beyond it the last one marks the cut.

    A run's findings are as many as its contract has rules, so ranking them in one window
    is bounded by the contract, never by the data; the scan behind them runs once.
    """
    run = Window.partitionBy(*(by or [F.lit(1)]))
    ranked = findings.withColumn("_rank", F.row_number().over(run.orderBy(*finding_order()))) \
        .withColumn("_total", F.count(F.lit(1)).over(run))
    marker = finding_row(
        rule_id="runtime.finding_limit", severity="critical", category="runtime",
        title="More findings than the evidence limit",
        message=f"{{total}} findings were produced, evidence stops at {limit}: partial result.",
        expected=f"<= {limit} findings", observed="{total} findings", total="_total")
    cut = (F.col("_rank") == limit) & (F.col("_total") > limit)
    own = F.struct(*[F.col(f"`{c}`") for c in FINDING_COLUMNS])
    return ranked.where(F.col("_rank") <= limit) \
        .select(*(by or []), F.when(cut, marker).otherwise(own).alias("f")).select(*(by or []), "f.*")


def severity_counts(prefix: str = "severity") -> list[Column]:
    sev = F.col(prefix)
    return [
        F.count(F.lit(1)).alias("findings_total"),
        F.count_if(sev == "info").alias("info"),
        F.count_if(sev == "warning").alias("warnings"),
        F.count_if(sev == "error").alias("errors"),
        F.count_if(sev == "critical").alias("critical"),
    ]


def summarize(findings: DataFrame, by: list[str] | None = None, fail_on: str = "error") -> DataFrame:
    """Counts per severity and the verdict at a threshold, per run or overall.

    Taken over all findings, before any evidence cap.
    """
    # a severity without a rank counts as the worst one
    worst = F.coalesce(F.max(F.coalesce(severity_rank(F.col("severity")), F.lit(max(SEVERITY_RANK.values())))), F.lit(0))
    if fail_on not in SEVERITY_RANK:
        raise ValueError(f"fail_on: '{fail_on}' is not one of {', '.join(SEVERITY_RANK)}")
    passed = (worst < SEVERITY_RANK[fail_on]).alias("passed")
    grouped = findings.groupBy(*by).agg(*severity_counts(), passed) if by \
        else findings.agg(*severity_counts(), passed)
    return grouped.withColumn("fail_on", F.lit(fail_on)).withColumn(
        "status", F.when(F.col("passed"), "passed").otherwise("failed"))


def summarize_by_category(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    return findings.groupBy(*(by or []), "category", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("affected_rows").alias("affected_rows"))


def summarize_levels(findings: DataFrame, levels: list[str]) -> DataFrame:
    """Findings and affected rows by all ``levels``, with the subtotals of every prefix and the total.

    ``level`` says how many of the levels a row sums over (as bits, the last level lowest): a NULL of a subtotal is
    not a NULL of the data.
    """
    return findings.rollup(*levels).agg(
        F.count(F.lit(1)).alias("findings"), F.sum("affected_rows").alias("affected_rows"), F.grouping_id().alias("level"))


def merge_findings(batches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Findings of many batches as one per rule, column and title.

    Row counts add up; of all example rows the smallest stay. The examples are ranked
    in a window that keeps ten per map task, so no group is ever gathered whole.
    """
    keys = [*(by or []), "rule_id", "column", "title"]
    sums = batches.groupBy(*keys).agg(
        F.sum("affected_rows").alias("affected_rows"),
        F.count(F.lit(1)).alias("_batches"),
        *[F.min(c).alias(c) for c in
          ("severity", "category", "message", "expected", "observed", "remediation")],
    )
    rows = batches.select(*keys, F.explode("sample_rows").alias("_row")).distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_row"))
    samples = (
        rows.withColumn("_nth", nth).where(F.col("_nth") <= SAMPLE_LIMIT)
        .groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("sample_rows"))
    )
    same = [sums[k].eqNullSafe(samples[k]) for k in keys]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    several = F.col("_batches") > 1
    n = sums["affected_rows"].cast("string")
    message = F.when(several, F.concat(n, F.lit(" row(s) break this rule across all batches."))) \
        .otherwise(F.col("message"))
    observed = F.when(several, F.concat(n, F.lit(" affected rows"))).otherwise(F.col("observed"))
    return sums.join(samples, condition, "left").select(
        *[sums[k] for k in (by or [])],
        finding_id(sums["rule_id"], sums["column"], message).alias("finding_id"),
        sums["rule_id"], "severity", "category", sums["title"], message.alias("message"),
        sums["column"], "affected_rows",
        F.coalesce("sample_rows", F.array().cast("array<bigint>")).alias("sample_rows"),
        "expected", observed.alias("observed"), "remediation",
    )
