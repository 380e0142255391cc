"""Run history and reports. Each priority and month of orders is a run of its own."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog.base import query, table
from catalog.rules import ALL_SQL, RANKS, contract_of, orders_validation
from tablepact import validate_groups
from tablepact.plans import history, reports

RULES = {
    "o_totalprice": {"minimum": 10000, "maximum": 490000, "severity": "warning"},
    "o_orderstatus": {"allowed_values": ["O", "F", "P"]},
    "o_custkey": {"minimum": 20, "severity": "error"},
}
BY = ["dataset_name", "run_id", "started_at", "contract_version", "contract_fingerprint"]


def monthly(spark, sf_dir):
    """(orders with run columns, their findings, the runs table)."""
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    year = F.date_format("o_orderdate", "yyyy")
    df = table(spark, sf_dir, "orders").select(
        "*", F.col("o_orderpriority").alias("dataset_name"),
        F.concat("o_orderpriority", F.lit("/"), F.date_format("o_orderdate", "yyyy-MM")).alias("run_id"),
        month.alias("started_at"), year.alias("contract_version"),
        F.sha2(F.concat("o_orderpriority", F.lit("/"), year), 256).alias("contract_fingerprint"))
    found = validate_groups(df, contract_of("orders", RULES), by=BY)
    runs = history.runs_of_groups(df, found, BY, fingerprint_columns=["o_orderkey", "o_custkey"]) \
        .withColumn("contract_id", F.col("dataset_name"))
    return df, found, runs


BASE = """
    WITH b AS (SELECT *, o_orderpriority AS dataset_name, strftime(o_orderdate, '%Y') AS contract_version,
               o_orderpriority || '/' || strftime(o_orderdate, '%Y-%m') AS run_id,
               date_trunc('month', o_orderdate) AS started_at FROM orders),
    f AS (
      SELECT dataset_name, run_id, started_at, 'column.minimum' AS rule_id, 'o_totalprice' AS "column",
             'warning' AS severity, count(*) AS n FROM b WHERE o_totalprice < 10000 GROUP BY ALL
      UNION ALL SELECT dataset_name, run_id, started_at, 'column.maximum', 'o_totalprice', 'warning', count(*)
             FROM b WHERE o_totalprice > 490000 GROUP BY ALL
      UNION ALL SELECT dataset_name, run_id, started_at, 'column.minimum', 'o_custkey', 'error', count(*)
             FROM b WHERE o_custkey < 20 GROUP BY ALL),
    g AS (SELECT run_id, count(*) AS findings_total, count(*) FILTER (severity = 'warning') AS warnings,
                 count(*) FILTER (severity = 'error') AS errors FROM f GROUP BY run_id),
    r AS (SELECT dataset_name, run_id, started_at, contract_version, count(*) AS row_count,
                 coalesce(any_value(findings_total), 0) AS findings_total, coalesce(any_value(warnings), 0) AS warnings,
                 coalesce(any_value(errors), 0) AS errors,
                 CASE WHEN coalesce(any_value(errors), 0) = 0 THEN 'passed' ELSE 'failed' END AS status
          FROM b LEFT JOIN g USING (run_id) GROUP BY dataset_name, run_id, started_at, contract_version)"""

STAMP = "strftime({c}, '%Y-%m-%d')"
RUN_SQL = """dataset_name, run_id, strftime(started_at, '%Y-%m-%d') AS started_at, status,
    CAST(findings_total AS BIGINT) AS findings_total, CAST(warnings AS BIGINT) AS warnings,
    CAST(errors AS BIGINT) AS errors, CAST(row_count AS BIGINT) AS row_count"""


def _shown(runs):
    return runs.select("dataset_name", "run_id", F.date_format("started_at", "yyyy-MM-dd").alias("started_at"),
                       "status", "findings_total", "warnings", "errors", "row_count")


@query("history_runs", f"{BASE} SELECT {RUN_SQL} FROM r")
def history_runs(spark, sf_dir):
    return _shown(monthly(spark, sf_dir)[2])


@query("history_latest", f"{BASE} SELECT {RUN_SQL} FROM (SELECT * FROM r ORDER BY r.started_at DESC, run_id LIMIT 20)")
def history_latest(spark, sf_dir):
    return _shown(history.latest_runs(monthly(spark, sf_dir)[2], 20))


@query("history_latest_per_dataset", f"""{BASE} SELECT {RUN_SQL} FROM (SELECT * FROM r
    QUALIFY row_number() OVER (PARTITION BY dataset_name ORDER BY r.started_at DESC, run_id DESC) = 1)""")
def history_latest_per_dataset(spark, sf_dir):
    return _shown(history.latest_per_dataset(monthly(spark, sf_dir)[2]))


@query("history_trend", f"""{BASE} SELECT dataset_name, CAST(count(*) AS BIGINT) AS run_count,
    round(avg((status = 'passed')::INT), 6) AS pass_rate, arg_max(run_id, run_id) AS latest_run_id,
    arg_max(status, run_id) AS latest_status FROM r GROUP BY dataset_name""")
def history_trend(spark, sf_dir):
    return history.trend_summary(monthly(spark, sf_dir)[2])


@query("history_trend_runs", f"""{BASE} SELECT {RUN_SQL} FROM (SELECT * FROM r WHERE dataset_name = '1-URGENT'
    ORDER BY r.started_at DESC, run_id LIMIT 12)""")
def history_trend_runs(spark, sf_dir):
    return _shown(history.trend(monthly(spark, sf_dir)[2], "1-URGENT", 12))


@query("contract_versions", f"""{BASE} SELECT sha256(dataset_name || '/' || contract_version) AS contract_fingerprint,
    dataset_name, {STAMP.format(c='min(started_at)')} AS first_seen_at, {STAMP.format(c='max(started_at)')} AS last_seen_at,
    dataset_name AS contract_id, contract_version, CAST(count(*) AS BIGINT) AS runs
    FROM r GROUP BY dataset_name, contract_version""")
def contract_versions(spark, sf_dir):
    seen = history.contract_versions(monthly(spark, sf_dir)[2])
    return seen.select("contract_fingerprint", "dataset_name", *[
        F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_seen_at", "last_seen_at")],
        "contract_id", "contract_version", "runs")


PAIRS_SQL = """, p AS (SELECT lag(run_id) OVER w AS older_run_id, run_id AS newer_run_id FROM r
    WINDOW w AS (PARTITION BY dataset_name ORDER BY started_at))"""


def consecutive(runs):
    """Each run with the one before it; a dataset's runs are few, whatever its rows."""
    before = F.lag("run_id").over(Window.partitionBy("dataset_name").orderBy("started_at"))
    return runs.select(before.alias("older_run_id"), F.col("run_id").alias("newer_run_id")) \
        .where(F.col("older_run_id").isNotNull())


@query("run_compare", f"""{BASE}{PAIRS_SQL},
    o AS (SELECT older_run_id, newer_run_id, rule_id, "column", n FROM f JOIN p ON run_id = older_run_id),
    w AS (SELECT older_run_id, newer_run_id, rule_id, "column", n FROM f JOIN p ON run_id = newer_run_id
          WHERE older_run_id IS NOT NULL)
    SELECT older_run_id, newer_run_id, rule_id, "column",
           CASE WHEN o.n IS NULL THEN 'new' WHEN w.n IS NULL THEN 'resolved' ELSE 'persistent' END AS state
    FROM o FULL JOIN w USING (older_run_id, newer_run_id, rule_id, "column", n)""")
def run_compare(spark, sf_dir):
    """Findings of every month against the month before (an id changes with its count)."""
    _, found, runs = monthly(spark, sf_dir)
    return history.compare_run_findings(found, consecutive(runs)).select(
        "older_run_id", "newer_run_id", "rule_id", "column", "state")


@query("run_compare_deltas", f"""{BASE}{PAIRS_SQL}
    SELECT older_run_id, newer_run_id, n.dataset_name, o.status AS status_before, n.status AS status_after,
           CAST(n.row_count - o.row_count AS BIGINT) AS row_count_delta,
           CAST(n.findings_total - o.findings_total AS BIGINT) AS finding_count_delta,
           n.contract_version <> o.contract_version AS contract_changed, true AS data_changed
    FROM p JOIN r o ON o.run_id = older_run_id JOIN r n ON n.run_id = newer_run_id""")
def run_compare_deltas(spark, sf_dir):
    runs = monthly(spark, sf_dir)[2]
    return history.compare_runs(runs, consecutive(runs))


@query("history_drift_events", f"""{BASE},
    e AS (SELECT run_id, started_at, status, lag(status) OVER (PARTITION BY dataset_name ORDER BY started_at) AS prior FROM r)
    SELECT run_id, 'type_changed' AS change_type, 'status' AS "column", 'error' AS severity
    FROM e WHERE prior IS NOT NULL AND prior <> status AND run_id LIKE '5-LOW/%'
    ORDER BY started_at DESC LIMIT 200""")
def history_drift_events(spark, sf_dir):
    """Changes between consecutive runs joined to their run, newest ones of one dataset."""
    runs = monthly(spark, sf_dir)[2]
    prior = F.lag("status").over(Window.partitionBy("dataset_name").orderBy("started_at"))
    changes = runs.select("run_id", "status", prior.alias("prior")).where(F.col("prior") != F.col("status")) \
        .select("run_id", F.lit("type_changed").alias("change_type"), F.lit("status").alias("column"),
                F.lit("error").alias("severity"))
    return history.drift_events(changes, runs, "5-LOW", 200).select("run_id", "change_type", "column", "severity")


# --- reports ---------------------------------------------------------------------

@query("report_sarif_rows", f"""
    SELECT rule_id, CASE severity WHEN 'info' THEN 'note' WHEN 'warning' THEN 'warning' ELSE 'error' END AS level,
           severity, category, affected_rows,
           CAST(nullif(split_part(sample_rows, ',', 1), '') AS BIGINT) + 1 AS start_line FROM ({ALL_SQL})""")
def report_sarif_rows(spark, sf_dir):
    return reports.sarif_results(orders_validation(spark, sf_dir).findings).drop("message")


@query("report_sarif_rules", f"""
    SELECT rule_id, category FROM ({ALL_SQL})
    QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY {RANKS} DESC, category, "column") = 1""")
def report_sarif_rules(spark, sf_dir):
    found = orders_validation(spark, sf_dir, row_key=None).findings
    return reports.sarif_rules(found).select("rule_id", "category")


@query("report_junit_counts", f"""{BASE}
    SELECT run_id, CAST(greatest(1, count(rule_id)) AS BIGINT) AS tests,
           CAST(count(*) FILTER (severity IN ('error', 'critical')) AS BIGINT) AS failures,
           CAST(count(*) FILTER (severity IN ('warning', 'info')) AS BIGINT) AS skipped
    FROM (SELECT DISTINCT run_id FROM b) LEFT JOIN (SELECT run_id, rule_id, severity FROM f) USING (run_id) GROUP BY run_id""")
def report_junit_counts(spark, sf_dir):
    _, found, runs = monthly(spark, sf_dir)
    return reports.junit_counts(runs, found, ["run_id"])
