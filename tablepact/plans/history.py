"""Run history: Parquet tables partitioned by dataset and run, queried as DataFrames."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions.hashing import dataset_fingerprint
from tablepact.functions.schemas import flat_schema
from tablepact.operators.findings import FINDING_SCHEMA, summarize
from tablepact.plans.registry import contract_fingerprint
from tablepact.plans.validate import Validation

PARTITIONS = ["dataset_name", "run_id"]

DRIFT_SCHEMA = flat_schema(
    "change_type string, column string, before string, after string, severity string")

RUN_SCHEMA = flat_schema(
    "contract_id string, contract_version string, started_at timestamp, completed_at timestamp, "
    "duration_ms bigint, status string, passed boolean, fail_on string, findings_total bigint, "
    "info bigint, warnings bigint, errors bigint, critical bigint, row_count bigint, "
    "column_count bigint, contract_fingerprint string, data_fingerprint string")
PROFILE_SCHEMA = flat_schema(
    "column string, observed_type string, row_count bigint, null_count bigint, null_ratio double, "
    "distinct_count bigint, duplicate_count bigint, distinct_count_exact boolean, "
    "duplicate_count_exact boolean, minimum string, maximum string, mean double")
SIGNAL_SCHEMA = flat_schema(
    "column string, category string, confidence string, name_signal boolean, sampled_values bigint, "
    "matching_values bigint, match_ratio double, sampled boolean")


def _escaped(value: str) -> str:
    """Partition folder form of a value, as Spark itself would write it."""
    return re.sub(r"[^\w.\- ]", lambda m: f"%{ord(m[0]):02X}", value)


def _wanted(limit: int, least: int = 1) -> int:
    """The limit as asked for, however large; one that makes no sense is refused."""
    if int(limit) < least:
        raise ValueError(f"limit must be at least {least}, not {limit}")
    return int(limit)


def _partition_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("dataset_name", T.StringType()),
                         T.StructField("run_id", T.StringType())])


class RunHistory:
    """Runs, findings, profiles, signals and drift under one folder of the shared file system.

    Publishing a run replaces its own partition folder in every table, also with nothing,
    so a repeated or retried publish leaves exactly one copy. The run row is written last:
    readers that start from the runs table never see half a run.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _write(self, df: DataFrame, table: str, dataset: str, run_id: str) -> None:
        folder = f"dataset_name={_escaped(dataset)}/run_id={_escaped(run_id)}"
        df.drop(*PARTITIONS).write.mode("overwrite").parquet(f"{self.root}/{table}/{folder}")

    def record(self, made: Validation, started_at: datetime,
               completed_at: datetime | None = None) -> str:
        """Write a validation. Its findings are computed once: the counts of the run row
        are taken from what was written."""
        name, run_id = made.contract.dataset.name, made.run_id
        self._write(made.findings, "findings", name, run_id)
        # every table, also without rows: what an earlier publish of this run left is replaced
        for table, rows, schema in (("profiles", made.profile, PROFILE_SCHEMA), ("drift", made.drift, DRIFT_SCHEMA),
                                    ("signals", made.pii_signals, SIGNAL_SCHEMA)):
            self._write(self.spark.createDataFrame([], schema) if rows is None else rows, table, name, run_id)
        counts = summarize(self.run(run_id), fail_on=made.fail_on).first()
        data = dataset_fingerprint(made.source).first()
        done = completed_at or max(datetime.now(), started_at)
        row = {
            **counts.asDict(), **data.asDict(),
            "contract_id": made.contract.dataset.contract_id,
            "contract_version": made.contract.contract_version,
            "started_at": started_at, "completed_at": done,
            "duration_ms": int((done - started_at).total_seconds() * 1000),
            "column_count": len(made.source.columns),
            "contract_fingerprint": contract_fingerprint(made.contract),
        }
        run = self.spark.createDataFrame([tuple(row[c] for c in RUN_SCHEMA.names)], RUN_SCHEMA)
        self._write(run, "runs", name, run_id)
        return run_id

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        full = _partition_schema(schema)
        try:
            # a declared schema: no footer is opened to plan, and ids stay text
            return self.spark.read.schema(full).parquet(f"{self.root}/{table}")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)  # nothing of this kind recorded yet

    def runs(self) -> DataFrame:
        return self._read("runs", RUN_SCHEMA)

    def findings(self) -> DataFrame:
        return self._read("findings", FINDING_SCHEMA)

    def profiles(self) -> DataFrame:
        return self._read("profiles", PROFILE_SCHEMA)

    def drift(self) -> DataFrame:
        return self._read("drift", DRIFT_SCHEMA)

    def signals(self) -> DataFrame:
        """Personal-data signals of every run."""
        return self._read("signals", SIGNAL_SCHEMA)

    def lookup(self, run_id: str) -> DataFrame:
        """The run's own row."""
        return self.runs().where(F.col("run_id") == run_id)

    def run(self, run_id: str) -> DataFrame:
        """Findings of one run; the filter prunes partitions before any file is opened."""
        return self.findings().where(F.col("run_id") == run_id)

    def compare(self, older: str, newer: str) -> tuple[DataFrame, DataFrame]:
        """(deltas of the two run rows, findings as new, resolved or persistent)."""
        known = {r["run_id"] for r in
                 self.runs().where(F.col("run_id").isin(older, newer)).select("run_id").collect()}
        unknown = [r for r in (older, newer) if r not in known]
        if unknown:
            raise ValueError(f"unknown run '{unknown[0]}'")
        pair = self.spark.createDataFrame([(older, newer)], flat_schema("older_run_id string, newer_run_id string"))
        return compare_runs(self.runs(), pair), compare_findings(self.run(older), self.run(newer))


def runs_of_groups(df: DataFrame, findings: DataFrame, by: list[str],
                   fingerprint_columns: list[str] | None = None, fail_on: str = "error") -> DataFrame:
    """One run row per group of a table, clean groups included.

    ``findings`` come from ``validate_groups`` with the same ``by``; both sides are
    aggregated to one row per group before they are joined.
    """
    counts = dataset_fingerprint(df, fingerprint_columns, by)
    verdicts = summarize(findings, by, fail_on)
    zero = ("findings_total", "info", "warnings", "errors", "critical")
    return counts.join(verdicts, by, "left").select(
        *by, *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
        F.coalesce("passed", F.lit(True)).alias("passed"),
        F.coalesce("status", F.lit("passed")).alias("status"), "row_count", "data_fingerprint")


def latest_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first: a top-k, never a full sort."""
    return runs.orderBy(F.col("started_at").desc(), "run_id").limit(_wanted(limit))


def latest_per_dataset(runs: DataFrame) -> DataFrame:
    """The newest run of each dataset through one aggregate."""
    newest = F.max_by(F.struct(*runs.columns), F.struct("started_at", "run_id")).alias("r")
    return runs.groupBy("dataset_name").agg(newest).select("r.*")


def trend(runs: DataFrame, dataset: str | None = None, limit: int = 50) -> DataFrame:
    """The newest ``limit`` runs in time order."""
    chosen = runs if dataset is None else runs.where(F.col("dataset_name") == dataset)
    newest = chosen.orderBy(F.col("started_at").desc(), "run_id").limit(_wanted(limit, 2))
    return newest.orderBy("started_at", "run_id")


def trend_summary(runs: DataFrame) -> DataFrame:
    """Per dataset: runs, pass rate and the latest run's id and status."""
    when = F.struct("started_at", "run_id")
    return runs.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.round(F.avg((F.col("status") == "passed").cast("double")), 6).alias("pass_rate"),
        F.max_by("run_id", when).alias("latest_run_id"),
        F.max_by("status", when).alias("latest_status"))


def drift_events(drift: DataFrame, runs: DataFrame, dataset: str | None = None,
                 limit: int = 50) -> DataFrame:
    """The newest ``limit`` drift changes with their run's time, oldest first; the dataset filter comes first."""
    chosen = runs if dataset is None else runs.where(F.col("dataset_name") == dataset)
    events = drift.select("run_id", "change_type", "column", "severity") \
        .join(chosen.select("run_id", "started_at", "dataset_name"), "run_id")
    newest = events.orderBy(F.col("started_at").desc(), "run_id", "change_type", "column").limit(_wanted(limit))
    return newest.orderBy("started_at", "run_id", "change_type", "column")


def compare_findings(older: DataFrame, newer: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every finding id of two runs as new, resolved or persistent."""
    keys = [*(by or []), "finding_id"]
    o = older.select(*keys, F.col("rule_id").alias("_old_rule"), F.col("column").alias("_old_column"))
    n = newer.select(*keys, F.col("rule_id").alias("_new_rule"), F.col("column").alias("_new_column"))
    both = o.join(n, keys, "full_outer")
    state = (
        F.when(F.col("_old_rule").isNull(), "new")
        .when(F.col("_new_rule").isNull(), "resolved").otherwise("persistent"))
    return both.select(
        *keys, state.alias("state"), F.coalesce("_new_rule", "_old_rule").alias("rule_id"),
        F.coalesce("_new_column", "_old_column").alias("column"))


def compare_run_findings(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """New, resolved and persistent findings for every (older, newer) pair of runs."""
    by = ["older_run_id", "newer_run_id"]
    older = findings.join(pairs, findings["run_id"] == pairs["older_run_id"]).drop("run_id")
    newer = findings.join(pairs, findings["run_id"] == pairs["newer_run_id"]).drop("run_id")
    return compare_findings(older, newer, by)


def compare_runs(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Deltas for each (older_run_id, newer_run_id) pair; any number of pairs at once."""
    kept = ("run_id", "dataset_name", "status", "row_count", "findings_total",
            "contract_fingerprint", "data_fingerprint")
    o = runs.select(*[F.col(c).alias(f"o_{c}") for c in kept])
    n = runs.select(*[F.col(c).alias(f"n_{c}") for c in kept])
    joined = pairs.join(o, F.col("older_run_id") == F.col("o_run_id")) \
        .join(n, F.col("newer_run_id") == F.col("n_run_id"))
    return joined.select(
        "older_run_id", "newer_run_id", F.col("n_dataset_name").alias("dataset_name"),
        F.col("o_status").alias("status_before"), F.col("n_status").alias("status_after"),
        (F.col("n_row_count") - F.col("o_row_count")).alias("row_count_delta"),
        (F.col("n_findings_total") - F.col("o_findings_total")).alias("finding_count_delta"),
        (~F.col("n_contract_fingerprint").eqNullSafe(F.col("o_contract_fingerprint")))
        .alias("contract_changed"),
        (~F.col("n_data_fingerprint").eqNullSafe(F.col("o_data_fingerprint"))).alias("data_changed"))


def contract_versions(runs: DataFrame) -> DataFrame:
    """First and last sight of every contract, with the id and version seen last."""
    return runs.groupBy("contract_fingerprint", "dataset_name").agg(
        F.min("started_at").alias("first_seen_at"), F.max("started_at").alias("last_seen_at"),
        F.max_by("contract_id", F.struct("started_at", "run_id")).alias("contract_id"),
        F.max_by("contract_version", F.struct("started_at", "run_id")).alias("contract_version"),
        F.count(F.lit(1)).alias("runs"))


def artifact_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of every file below a folder, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"),
                        F.sha2("content", 256).alias("sha256")).orderBy("path")
