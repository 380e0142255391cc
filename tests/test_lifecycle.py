from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablepact import Contract, ContractError, load_contract, validate
from tablepact.operators import drift, profile
from tablepact.plans import history, registry, reports
from tablepact.session import shared_dir


def test_contract_pair_is_breaking(spark):
    old = Contract.from_dict({"dataset": {"name": "tides", "required_columns": ["port", "metres"]},
                              "rules": {"metres": {"type": "number", "maximum": 9}}})
    new = Contract.from_dict({"dataset": {"name": "tides", "required_columns": ["port", "metres", "clock"]},
                              "rules": {"metres": {"type": "number", "maximum": 8}}})
    older, newer = (registry.registry_tables(spark, {"tides": c}) for c in (old, new))
    changes = registry.diff_contracts(older, newer)
    assert {(r["path"], r["classification"]) for r in changes.collect()} == {
        ("dataset.required_columns.clock", "breaking"), ("rules.metres.maximum", "breaking")}
    (summary,) = registry.diff_summary(changes, newer[0]).collect()
    assert (summary["classification"], summary["change_count"]) == ("breaking", 2)
    (same,) = registry.diff_summary(registry.diff_contracts(older, older), older[0]).collect()
    assert (same["classification"], same["change_count"]) == ("none", 0)


def test_summary_of_both_registries(spark):
    made = [registry.registry_tables(spark, {n: Contract.from_dict({"dataset": {"name": n}, "rules": {"v": {"minimum": 1}}}) for n in names})
            for names in (("kept", "gone"), ("kept", "new"))]
    rows = registry.diff_summary(registry.diff_contracts(*made), made[1][0], made[0][0]).collect()
    assert {r["contract"]: r["classification"] for r in rows} == {"kept": "none", "gone": "nonbreaking", "new": "breaking"}
    assert len(rows) == 3


@pytest.mark.parametrize("before,after,classification", [
    ({"minimum": 1}, {"minimum": 2}, "breaking"), ({"minimum": 1}, {"minimum": 0}, "nonbreaking"),
    ({}, {"minimum": 0}, "breaking"), ({"minimum": 1}, {}, "nonbreaking"),
    ({"maximum": 5}, {"maximum": 4}, "breaking"), ({"maximum": 5}, {"maximum": 6}, "nonbreaking"),
    ({"maximum_age_hours": 5}, {"maximum_age_hours": 4}, "breaking"),
    ({"allowed_values": ["a", "b"]}, {"allowed_values": ["a"]}, "breaking"),
    ({"allowed_values": ["a"]}, {"allowed_values": ["a", "b"]}, "potentially_breaking"),
    ({"allowed_values": ["a"]}, {}, "nonbreaking"), ({}, {"allowed_values": [1]}, "breaking"),
    ({"allowed_values": [1]}, {"allowed_values": ["1"]}, "potentially_breaking"),
    ({"unique": True}, {}, "nonbreaking"), ({}, {"unique": True}, "breaking"),
    ({"type": "string"}, {"type": "integer"}, "breaking"),
    ({"description": "a"}, {"description": "b"}, "documentation_only"),
    ({"max_length": 5}, {"max_length": 4, "pattern": "x", "severity": "info"}, "none"),
    ({"allowed_values": ["a", "b"]}, {"allowed_values": ["b", "a"]}, "none"),
])
def test_diff_classes(spark, before, after, classification):
    sides = [registry.registry_tables(spark, {"c": Contract.from_dict(
        {"dataset": {"name": "d"}, "rules": {"v": rule}})}) for rule in (before, after)]
    (row,) = registry.diff_summary(registry.diff_contracts(*sides), sides[1][0]).collect()
    assert row["classification"] == classification


def test_dataset_rule_and_header_changes(spark):
    def one(rules, **head):
        return registry.registry_tables(spark, {"c": Contract.from_dict(
            {"dataset": {"name": "d", **head}, "dataset_rules": rules})})

    base = [{"name": "n", "type": "row_count", "minimum": 1}, {"type": "row_count", "minimum": 2}]
    more = [{"name": "n", "type": "row_count", "minimum": 3}, {"name": "z", "type": "row_count", "maximum": 2}]
    got = {r["path"]: r["classification"] for r in registry.diff_contracts(
        one(base, owner="a", contract_id="1"), one(more, owner="b", contract_id="2")).collect()}
    assert got == {"dataset_rules.n": "potentially_breaking", "dataset_rules.unnamed:2:row_count": "nonbreaking",
                   "dataset_rules.z": "potentially_breaking", "dataset.owner": "documentation_only",
                   "dataset.contract_id": "potentially_breaking"}


def test_inventory(spark):
    contract = Contract.from_dict({
        "dataset": {"name": "d"}, "rules": {"a": {"nullable": False, "unique": True}, "b": {"pattern": "x"}},
        "dataset_rules": [{"type": "row_count", "minimum": 1}]})
    _, columns, rules = registry.registry_tables(spark, {"d": contract})
    assert {r["rule_id"] for r in registry.rule_inventory(columns, rules).collect()} == {
        "column.nullable:a", "column.unique:a", "column.pattern:b", "dataset.row_count:dataset_rule_1"}


def test_registry_round_trip(spark):
    contract = Contract.from_dict({
        "dataset": {"name": "d", "owner": "o", "required_columns": ["a", "b"]},
        "rules": {"a": {"nullable": False, "minimum": 1.5, "allowed_values": [1, "x", True]}, "b": {"pattern": "x'y"}},
        "dataset_rules": [
            {"name": "c", "type": "conditional_not_null", "when_column": "a", "when_equals": 1, "then_column": "b"},
            {"type": "unique_combination", "columns": ["a", "b"]}]})
    tables = registry.registry_tables(spark, {"k": contract, "other": Contract.from_dict({"dataset": {"name": "z"}})})
    back = registry.contracts_of(tables[0].where("contract = 'k'"), *tables[1:])
    assert back == {"k": contract}


ODCS = {
    "kind": "DataContract", "apiVersion": "v3.1.0", "dataProduct": "sea",
    "team": {"name": "harbour", "members": [{"username": "x", "role": "Member"},
                                        {"username": "keeper", "role": "Owner"}]},
    "schema": [
        {"name": "tide_gauges", "physicalName": "tide_gauges", "description": "d",
         "properties": [
             {"name": "gauge", "logicalType": "string", "required": True, "primaryKey": True,
              "classification": "internal", "quality": [{"metric": "nullValues", "mustBe": 0, "severity": "critical"}]},
             {"name": "x", "physicalName": "metres", "physicalType": "DECIMAL(10,2)"},
             {"name": "when", "logicalType": "timestamp", "quality": [{"metric": "duplicates", "mustBe": 0}]},
             {"name": " "}],
         "quality": [{"metric": "rowCount", "mustBeGreaterThan": 0, "severity": "error"}]},
        {"name": "second", "properties": [{"name": "only", "logicalType": "uuid"}],
         "quality": [{"metric": "rowCount", "mustBe": 5}, {"metric": "other", "mustBe": 1}]}],
}


def test_odcs(spark):
    c = registry.contract_from_odcs(spark, ODCS)
    assert (c.dataset.owner, c.source_format, c.source_standard_version) == ("keeper", "odcs", "v3.1.0")
    first = c.rules["gauge"]
    assert (first.unique, first.nullable, first.severity, first.classification) == (True, False, "critical", "internal")
    assert c.rules["metres"].type == "number" and c.rules["metres"].nullable
    assert c.rules["when"].type == "datetime" and c.rules["when"].unique
    assert list(c.rules) == ["gauge", "metres", "when"] and c.adapter_notes
    assert (c.dataset_rules[0].type, c.dataset_rules[0].minimum) == ("row_count", 1)
    second = registry.contract_from_odcs(spark, ODCS, "second")
    assert second.dataset.name == "second" and second.dataset_rules[0].maximum == 5
    with pytest.raises(ContractError):
        registry.contract_from_odcs(spark, ODCS, "absent")


def test_either_form_is_loaded(spark, tmp_path):
    native, odcs = tmp_path / "n.json", tmp_path / "o.json"
    native.write_text(json.dumps({"dataset": {"name": "x"}}))
    odcs.write_text(json.dumps(ODCS))
    assert registry.load_any_contract(spark, str(native)).source_format == "native"
    assert registry.load_any_contract(spark, str(odcs), "second").dataset.name == "second"
    native.write_text("[1]")
    with pytest.raises(ContractError):
        registry.load_any_contract(spark, str(native))


def test_load_contract(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"dataset": {"name": "x"}}))
    assert load_contract(str(path)).dataset.name == "x"
    path.write_text(json.dumps({"dataset": {"name": "x"}, "typo": 1}))
    with pytest.raises(ContractError):
        load_contract(str(path))


def test_drift(spark):
    before = spark.createDataFrame([(4.5, "Kiel", True)], "metres double, port string, calm boolean")
    after = spark.createDataFrame([("4.5m", True, 7), (None, False, 8)], "metres string, calm boolean, clock long")
    shots = [drift.snapshot(profile.profile(d, "none")) for d in (before, after)]
    changes = drift.compare_snapshots(*shots)
    assert {(r["change_type"], r["column"], r["severity"]) for r in changes.collect()} == {
        ("removed", "port", "error"), ("added", "clock", "warning"), ("type_changed", "metres", "error"),
        ("nullability_changed", "metres", "warning")}
    made = validate(after, {"dataset": {"name": "d"}}, baseline=shots[0])
    assert {r["rule_id"] for r in made.findings.collect()} == {
        "drift.removed", "drift.added", "drift.type_changed", "drift.nullability_changed"}


def test_history(spark):
    store = history.RunHistory(spark, shared_dir(spark, "test-history"))
    contract = {"dataset": {"name": "ids / 1", "contract_id": "c"}, "rules": {"id": {"unique": True}}}
    first = validate(spark.createDataFrame([(1,), (2,)], "id long"), contract, run_id="001")
    second = validate(spark.createDataFrame([(1,), (1,), (3,)], "id long"), contract, run_id="002", row_key="id",
                      distinct="exact")
    store.record(first, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 2))
    store.record(second, datetime(2024, 1, 2), datetime(2024, 1, 2))
    store.record(second, datetime(2024, 1, 2), datetime(2024, 1, 2))
    runs = store.runs()
    assert [r["run_id"] for r in history.latest_runs(runs, 5).collect()] == ["002", "001"]
    assert [r["run_id"] for r in history.trend(runs, "ids / 1", 5).collect()] == ["001", "002"]
    (trend,) = history.trend_summary(runs).collect()
    assert (trend["run_count"], trend["pass_rate"], trend["latest_run_id"]) == (2, 0.5, "002")
    pairs = spark.createDataFrame([("001", "002")], "older_run_id string, newer_run_id string")
    (delta,) = history.compare_runs(runs, pairs).collect()
    assert (delta["status_before"], delta["status_after"]) == ("passed", "failed")
    assert (delta["row_count_delta"], delta["finding_count_delta"]) == (1, 1)
    assert (delta["contract_changed"], delta["data_changed"]) == (False, True)
    (change,) = history.compare_findings(store.run("001"), store.run("002")).collect()
    assert (change["state"], change["rule_id"]) == ("new", "column.unique")
    assert store.profiles().count() == 1
    assert store.drift().count() == 0
    deltas, states = store.compare("001", "002")
    assert deltas.first()["finding_count_delta"] == 1 and states.first()["state"] == "new"
    with pytest.raises(ValueError, match="unknown run"):
        store.compare("001", "999")
    (version,) = history.contract_versions(runs).collect()
    assert version["runs"] == 2 and version["first_seen_at"] == datetime(2024, 1, 1)
    # publishing again with fewer findings leaves none of the old ones
    fixed = validate(spark.createDataFrame([(1,), (3,)], "id long"), contract, run_id="002")
    store.record(fixed, datetime(2024, 1, 2), datetime(2024, 1, 2))
    assert store.run("002").count() == 0
    (files,) = [history.artifact_inventory(spark, store.root + "/runs").count()]
    assert files >= 2


def test_reports(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "row long, v long")
    contract = {"dataset": {"name": "r"}, "rules": {"v": {"nullable": False, "maximum": 4, "severity": "info"}},
                "dataset_rules": [{"type": "row_count", "maximum": 1, "severity": "critical"}]}
    found = validate(df, contract, row_key="row").findings
    rows = {r["rule_id"]: (r["level"], r["start_line"]) for r in reports.sarif_results(found).collect()}
    assert rows == {"column.nullable": ("note", 2), "column.maximum": ("note", 3),
                    "dataset.row_count.dataset_rule_1": ("error", None)}
    assert reports.sarif_rules(found).count() == 3
    texts = [json.loads(r["value"]) for r in reports.sarif_json(reports.sarif_results(found)).collect()]
    assert {t["ruleId"] for t in texts} == set(rows)
    runs = spark.createDataFrame([("x",), ("clean",)], "run_id string")
    counted = reports.junit_counts(runs, found.withColumn("run_id", F.lit("x")), ["run_id"]).collect()
    assert sorted(tuple(r) for r in counted) == [("clean", 1, 0, 0), ("x", 3, 1, 2)]
