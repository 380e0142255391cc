"""Validation of one dataset against one contract.

``validate`` makes one pass over the data for all row rules, personal-data tests and
column statistics, and one for all key rules and references, side by side. Example rows are looked up only for
rules that were found broken. All of it is done when ``validate`` returns: findings, signals and profile
are small local tables, and reading them starts no job on the data.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame

from tablepact.contract import Contract, ContractError
from tablepact.functions.local import taken
from tablepact.operators import drift, findings, keys, pii, predicates, profile, samples
from tablepact.operators.key_scan import KeyScan
from tablepact.operators.schema_checks import schema_findings
from tablepact.plans.scan import Scan
from tablepact.sources.readers import shape_budget


@dataclass
class Validation:
    """Results of a run as DataFrames. ``profile``, ``pii_signals`` and ``drift`` may be None."""

    contract: Contract
    source: DataFrame
    run_id: str
    findings: DataFrame
    fail_on: str
    profile: DataFrame | None = None
    pii_signals: DataFrame | None = None
    drift: DataFrame | None = None
    sampled: bool = False

    def ranked(self, limit: int | None = None) -> DataFrame:
        """Findings as reported, most severe first: all of them unless a limit is asked for."""
        kept = self.findings if limit is None else findings.cap_findings(self.findings, limit)
        return findings.rank_findings(kept)

    def summary(self) -> DataFrame:
        """One row: counts per severity over all findings, and the verdict."""
        return findings.summarize(self.findings, fail_on=self.fail_on)


def validate(
    df: DataFrame,
    contract: Contract | dict,
    *,
    references: dict[str, DataFrame] | None = None,
    baseline: DataFrame | None = None,
    row_key: str | None = None,
    as_of: datetime | str | Column | None = None,
    distinct: str = "none",
    pii_sample: int | None = None,
    fail_on: str = "error",
    run_id: str | None = None,
    budget: dict[str, int] | None = None,
) -> Validation:
    """Check ``df`` against ``contract``.

    ``row_key`` names a whole-number column that identifies rows: with it, findings
    carry the ten smallest row keys as examples. ``references`` maps the names used by
    ``reference_exists`` rules to DataFrames; ``baseline`` is a schema snapshot to detect
    drift from. ``distinct`` sets how the profile counts distinct values. A dataset that
    exceeds one of the measures in ``budget`` is refused before any rule runs.
    """
    if isinstance(contract, dict):
        contract = Contract.from_dict(contract)
    if budget is not None:
        over = shape_budget(df, budget).where("not within").first()
        if over is not None:
            raise ContractError(
                f"{over['measure']} is {over['observed']}, allowed {over['allowed']}")
    checks = predicates.row_checks(df.schema, contract, as_of)
    want_profile = baseline is not None or distinct != "none"
    sampled = pii_sample is not None and contract.privacy.detect_pii

    scan = Scan(df)
    scan.add_checks(checks, row_key)
    if contract.privacy.detect_pii and not sampled:
        scan.add_pii()
    if want_profile:
        scan.add_statistics(approx_distinct=distinct == "approx")
    exact = [profile.distinct_counts(df)] if distinct == "exact" else []
    hits = [pii.sampled_counts(df, row_key, pii_sample)] if sampled else []
    # an exact profile has counted the duplicates of every column; naming rows still takes the keys
    key_scan = KeyScan(df, contract, references, row_key, counted_unique=bool(exact) and row_key is None)
    more = scan.run(also=exact + hits + ([key_scan.totals()] if key_scan else []))
    counted = more[0] if exact else None
    key_totals = more.pop().collect() if key_scan else []

    families = [schema_findings(df, contract), scan.findings(), *keys.found_findings(df, key_scan.described(), key_totals)]
    if exact and row_key is None:
        families += keys.counted_findings(df, contract, counted)

    columns, signals, changes = None, None, None
    if want_profile:
        columns = profile.assemble(scan.statistics(), counted)
    if contract.privacy.detect_pii:
        signals = pii.signals_of_counts(more[-1], True) if sampled else scan.signals()
        families.append(pii.privacy_findings(signals, contract))
    if baseline is not None:
        changes = drift.compare_snapshots(baseline, drift.snapshot(columns))
        families.append(drift.drift_findings(changes))

    families = [f for f in families if f is not None]
    found = reduce(DataFrame.unionByName, families) if families else findings.no_findings(df)
    if row_key is not None:
        rows = samples.check_samples(df, scan.broken(), row_key)
        of_keys = key_scan.examples(key_totals)
        named_rows = taken(rows + ([of_keys] if of_keys is not None else []))
        if of_keys is not None:
            named_rows.append(keys.named_examples(named_rows.pop(), key_scan.described()))
        if named_rows:
            found = samples.attach_samples(found, reduce(DataFrame.unionByName, named_rows))
    return Validation(contract, df, run_id or uuid.uuid4().hex, found, fail_on,
                      columns, signals, changes, sampled)


def validate_groups(df: DataFrame, contract: Contract | dict, by: list[str],
                    as_of: datetime | str | Column | None = None) -> DataFrame:
    """Row rules of every group (day, source, tenant) of a table in one scan.

    Each group is a run of its own; groups are folded in each task before the exchange.
    """
    if isinstance(contract, dict):
        contract = Contract.from_dict(contract)
    return predicates.row_findings(df, predicates.row_checks(df.schema, contract, as_of), by)
