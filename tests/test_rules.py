"""Rules on small fixtures with literal expectations."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablepact import Contract, ContractError, validate, validate_groups
from tablepact.functions.expressions import ExpressionError, arithmetic, expression_columns
from tablepact.operators import findings as fnd
from tablepact.operators import keys, predicates, samples
from tablepact.plans.scan import Scan

NOW = datetime(2024, 6, 1, 12)

SHIPMENTS = {
    "dataset": {
        "name": "shipments", "owner": "Warehouse North",
        "required_columns": ["parcel", "depot", "scanned", "weight", "state", "contact"],
        "allow_extra_columns": False,
    },
    "rules": {
        "parcel": {"type": "uuid", "nullable": False, "unique": True, "severity": "critical"},
        "depot": {"type": "string", "nullable": False, "min_length": 2, "max_length": 4},
        "scanned": {"type": "datetime", "nullable": False, "maximum_age_hours": 72},
        "weight": {"type": "number", "minimum": 0.1, "maximum": 30},
        "state": {"allowed_values": ["packed", "moving", "there"], "severity": "warning"},
        "contact": {"type": "email"},
    },
    "dataset_rules": [
        {"name": "some", "type": "row_count", "minimum": 2},
        {"name": "seen_once", "type": "unique_combination", "columns": ["depot", "scanned"]},
        {"name": "reachable", "type": "null_ratio", "column": "contact", "max_ratio": 0.4},
    ],
    "privacy": {"allowed_categories": ["email", "address", "payment_card"]},
}
SHIPPED = "parcel string, depot string, scanned string, weight string, state string, contact string"


def parcel(i: int) -> str:
    return f"00000000-0000-4000-8000-{i:012d}"


def by_rule(made):
    return {(r["rule_id"], r["column"]): r for r in made.findings.collect()}


def test_conforming_shipments_pass(spark):
    rows = [(parcel(i), f"D{i}", (NOW - timedelta(hours=10 * i)).isoformat(), str(i / 2), "moving", f"d{i}@depot.example")
            for i in range(1, 6)]
    made = validate(spark.createDataFrame(rows, SHIPPED), SHIPMENTS, as_of=NOW)
    assert made.findings.count() == 0
    summary = made.summary().first()
    assert summary["passed"] and summary["status"] == "passed" and summary["findings_total"] == 0


def test_broken_shipments(spark):
    late = (NOW - timedelta(days=4)).isoformat()
    rows = [
        (parcel(1), "North depot", late, "31", "lost", None, "203.0.113.9"),
        (parcel(1), "N1", NOW.isoformat(), "heavy", "there", None, "203.0.113.10"),
        (parcel(2), None, NOW.isoformat(), "2", "there", "someone(at)depot", "203.0.113.11"),
    ]
    df = spark.createDataFrame(rows, SHIPPED + ", ip_address string")
    made = validate(df, SHIPMENTS, as_of=NOW)
    found = by_rule(made)
    assert set(found) == {
        ("column.unique", "parcel"), ("column.max_length", "depot"), ("column.nullable", "depot"),
        ("column.maximum_age_hours", "scanned"), ("column.maximum", "weight"), ("column.type", "weight"),
        ("column.allowed_values", "state"), ("column.type", "contact"), ("dataset.null_ratio.reachable", "contact"),
        ("schema.extra_column", "ip_address"), ("privacy.unapproved_pii_signal", "ip_address")}
    s = made.summary().first()
    assert (s["critical"], s["errors"], s["warnings"], s["findings_total"], s["passed"]) == (1, 7, 3, 11, False)
    text = str(made.ranked().collect())
    assert not any(raw in text for raw in ("North depot", "heavy", "lost", "(at)", "203.0.113"))
    again = {r["finding_id"] for r in validate(df, SHIPMENTS, as_of=NOW).findings.collect()}
    assert again == {r["finding_id"] for r in found.values()} and all(len(i) == 16 for i in again)
    order = [r["severity"] for r in made.ranked().collect()]
    assert order == sorted(order, key=["critical", "error", "warning", "info"].index)


def test_every_rule_on_typed_columns(spark):
    rows = [(i, 20.0 + i, "ok" if i % 4 else "hot", f"s{i % 6}", None if i % 5 == 0 else "north") for i in range(1, 13)]
    rows += [(13, -300.0, "ok", "sensor-13", "north"), (14, 99.5, "hot", "S", "south"), (15, 20.25, "", "s1", "")]
    df = spark.createDataFrame(rows, "row long, degrees double, state string, sensor string, room string")
    contract = {
        "dataset": {"name": "readings"},
        "rules": {
            "degrees": {"type": "integer", "minimum": -273.15, "maximum": 40},
            "sensor": {"min_length": 2, "max_length": 6, "pattern": "s.+"},
            "state": {"allowed_values": ["ok", "hot"]}},
        "dataset_rules": [
            {"name": "enough", "type": "row_count", "minimum": 16},
            {"name": "once", "type": "unique_combination", "columns": ["sensor", "room"]},
            {"name": "placed", "type": "null_ratio", "column": "room", "max_ratio": 0.1},
            {"name": "hot_room", "type": "conditional_not_null", "when_column": "state", "when_equals": "hot",
             "then_column": "room"}],
        "privacy": {"detect_pii": False},
    }
    found = {rule: (r["affected_rows"], r["sample_rows"]) for (rule, _), r in
             by_rule(validate(df, contract, row_key="row")).items()}
    pairs: dict = {}
    for r in rows:
        pairs.setdefault((r[3], r[4]), []).append(r[0])
    twins = sorted(x for group in pairs.values() if len(group) > 1 for x in group)
    assert found == {
        "column.type": (2, [14, 15]), "column.minimum": (1, [13]), "column.maximum": (1, [14]),
        "column.min_length": (1, [14]), "column.max_length": (1, [13]), "column.pattern": (1, [14]),
        "column.allowed_values": (1, [15]), "dataset.row_count.enough": (0, []),
        "dataset.unique_combination.once": (len(twins), twins[:10]), "dataset.null_ratio.placed": (2, [5, 10])}


def test_reconciliation_row(spark):
    df = spark.createDataFrame([(10.5, 10.0, 0.5), (9.0, 10.0, 0.5), (float("inf"), 1.0, 1.0)],
                               "total double, subtotal double, tax double")
    rule = {"name": "invoice", "type": "aggregate_reconciliation", "left_column": "total",
            "right_expression": "subtotal + tax", "tolerance": 0.01}
    made = validate(df, {"dataset": {"name": "i"}, "dataset_rules": [rule], "privacy": {"detect_pii": False}})
    (only,) = made.findings.collect()
    assert only["affected_rows"] == 1 and only["category"] == "reconciliation"


def test_arithmetic_only(spark):
    df = spark.createDataFrame([(6.0, 0.0), (6.0, 3.0)], "a double, b double")
    value = arithmetic("-(a + 2) * 3 / b - 1.5e0", F.col)
    assert [r[0] for r in df.select(value).collect()] == [None, -9.5]
    assert expression_columns("2*a + x1 - a / 1e3") == ["a", "x1"]
    for bad in ("", "a ** 2", "a // b", "f(a)", "a.b", "a if b else a", "a and b", "[a]", "a b", "'x'",
                "__import__('os')", "a; b", "a + 1_000", "a + 0x10", "(a", "a)", "a +", "a == b", "x" * 513):
        with pytest.raises(ExpressionError):
            arithmetic(bad, F.col)


def test_references(spark):
    orders = spark.createDataFrame([(1, 10), (2, 99), (3, 20), (4, 88), (5, None)], "order_id long, customer_id long")
    customers = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (None,)], "customer_id double")
    rule = {"type": "reference_exists", "column": "customer_id", "reference_dataset": "customers",
            "reference_column": "customer_id"}
    contract = {"dataset": {"name": "o"}, "dataset_rules": [rule], "privacy": {"detect_pii": False}}
    (only,) = validate(orders, contract, references={"customers": customers}, row_key="order_id").findings.collect()
    assert (only["rule_id"], only["affected_rows"], only["sample_rows"]) == (
        "dataset.reference_exists.dataset_rule_1", 2, [2, 4])
    for size in (0, 1 << 20):  # shuffled and broadcast
        absent = keys.missing_references(orders, "customer_id", customers, "customer_id", "order_id", size)
        assert sorted(r["key"] for r in absent.collect()) == ["88", "99"]
    with pytest.raises(ContractError):
        validate(orders, contract)
    with pytest.raises(ContractError):
        validate(orders, contract, references={"customers": customers.toDF("other")})


def test_duplicates_match_brute_force(spark):
    import random

    rng = random.Random(7)
    rows = [(i, rng.choice("abc") if rng.random() < 0.4 else f"u{i}", rng.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "row long, k string, v long").repartition(7)
    for columns in (["k"], ["k", "v"], ["v"]):
        index = [("row", "k", "v").index(c) for c in columns]
        groups: dict = {}
        for r in rows:
            key = tuple(r[i] for i in index)
            if any(x is not None for x in key):
                groups.setdefault(key, []).append(r[0])
        twins = sorted(x for g in groups.values() if len(g) > 1 for x in g)
        assert keys.duplicate_rows(df, columns).first()["affected"] == len(twins)
        assert keys.duplicate_samples(df, columns, "row").first()["sample_rows"] == twins[:10]


def test_partition_count_does_not_matter(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 7).alias("m"), (F.col("id") % 3).cast("string").alias("s"))
    contract = {"dataset": {"name": "t"}, "rules": {"m": {"maximum": 4, "unique": True}, "s": {"allowed_values": ["0"]}}}
    one = validate(df.coalesce(1), contract, row_key="id").findings.collect()
    many = validate(df.repartition(8), contract, row_key="id").findings.collect()
    assert sorted(one) == sorted(many) and len(one) == 3


@pytest.mark.parametrize("kind,values,bad", [
    ("number", [" 1 ", "1e3", "inf", "+.5", "5.", "1d", "0x10", "1_000", "nan", "true", ""], {"1d", "0x10", "1_000", "nan", "true", ""}),
    ("integer", ["1", "2.0", "2.5", "inf", "1e2"], {"2.5", "inf"}),
    ("boolean", [" Yes", "n", "TRUE", "0", "2", "on"], {"2", "on"}),
    ("datetime", ["2024-01-02", "01/02/2024", "13/02/2024", "Jan 5 2024", "January 5, 2024", "5 Jan 2024", "20240105",
                  "2024", "2024-01-02T10:00:00.123+02:00", "2024-01-02 10:00", "2024/01/05", "not", "1", "202401",
                  "2024-13-01"], {"not", "1", "202401", "2024-13-01"}),
    ("email", ["a@b.c", "a@b", "a b@c.d", "a@b.c\n"], {"a@b", "a b@c.d", "a@b.c\n"}),
    ("uuid", ["{12345678-1234-5678-1234-567812345678}", "urn:uuid:12345678-1234-5678-1234-567812345678", "1234"], {"1234"}),
])
def test_type_edges(spark, kind, values, bad):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "row long, v string")
    contract = {"dataset": {"name": "t"}, "rules": {"v": {"type": kind}}, "privacy": {"detect_pii": False}}
    found = validate(df, contract, row_key="row").findings.collect()
    got = {values[i] for f in found for i in f["sample_rows"]}
    assert got == bad


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, math.nan, True, [1], 1.0), (2, None, None, None, 0.0)],
                               "i int, d double, b boolean, a array<int>, f double")
    contract = {"dataset": {"name": "t"}, "privacy": {"detect_pii": False}, "rules": {
        "d": {"nullable": False}, "a": {"nullable": False, "max_length": 2}, "i": {"allowed_values": ["1", 2.0]},
        "b": {"type": "boolean", "allowed_values": [1]}, "f": {"type": "boolean"}}}
    found = {k: r["affected_rows"] for k, r in by_rule(validate(df, contract)).items()}
    assert found == {("column.nullable", "d"): 2, ("column.nullable", "a"): 1, ("column.max_length", "a"): 1,
                     ("column.allowed_values", "i"): 1, ("column.type", "f"): 2}


def test_strict_text_and_patterns(spark):
    df = spark.createDataFrame([(1, "ab\n", 5), (2, "AB", 6)], "row long, t string, n long")
    rules = {"t": {"pattern": r"(?P<x>[a-z])b", "strict_type": True, "type": "string"},
             "n": {"type": "string", "strict_type": True}}
    made = validate(df, {"dataset": {"name": "t"}, "rules": rules, "privacy": {"detect_pii": False}}, row_key="row")
    found = {k: r["sample_rows"] for k, r in by_rule(made).items()}
    assert found == {("column.pattern", "t"): [1, 2], ("column.type", "n"): [1, 2]}


def test_empty_dataset(spark):
    df = spark.createDataFrame([], "a long, b string")
    rules = [{"type": "null_ratio", "column": "b", "max_ratio": 0.0}, {"type": "row_count", "minimum": 1}]
    made = validate(df, {"dataset": {"name": "e"}, "rules": {"a": {"nullable": False, "unique": True}},
                         "dataset_rules": rules}, distinct="exact", row_key="a")
    assert [r["rule_id"] for r in made.findings.collect()] == ["dataset.row_count.dataset_rule_2"]
    assert {r["observed_type"] for r in made.profile.collect()} == {"unknown"}
    assert {r["null_ratio"] for r in made.profile.collect()} == {0.0}


def test_condition_null_never_applies(spark):
    df = spark.createDataFrame([(None, None)], "w string, t string")
    rule = {"type": "conditional_not_null", "when_column": "w", "when_equals": None, "then_column": "t"}
    made = validate(df, {"dataset": {"name": "c"}, "dataset_rules": [rule], "privacy": {"detect_pii": False}})
    assert made.findings.count() == 0


def test_evidence_cap(spark):
    df = spark.createDataFrame([(None,) * 5], "a long, b long, c long, d long, e long")
    contract = {"dataset": {"name": "n"}, "rules": {c: {"nullable": False} for c in "abcde"},
                "privacy": {"detect_pii": False}}
    made = validate(df, contract)
    assert made.ranked(5).count() == 5
    capped = made.ranked(3).collect()
    assert [r["rule_id"] for r in capped] == ["runtime.finding_limit", "column.nullable", "column.nullable"]
    assert capped[0]["severity"] == "critical" and capped[0]["observed"] == "5 findings"


def test_groups_and_merge(spark):
    df = spark.createDataFrame([("a", 1), ("a", -1), ("b", -2), ("c", 3)], "day string, v long")
    contract = {"dataset": {"name": "g"}, "rules": {"v": {"minimum": 0}}}
    found = validate_groups(df, contract, ["day"])
    assert {r["day"]: r["affected_rows"] for r in found.collect()} == {"a": 1, "b": 1}
    batches = found.drop("sample_rows").withColumn(
        "sample_rows", F.when(F.col("day") == "a", F.array(F.lit(5), F.lit(9))).otherwise(F.array(F.lit(2), F.lit(5)))
        .cast("array<bigint>"))
    (merged,) = fnd.merge_findings(batches).collect()
    assert merged["affected_rows"] == 2 and merged["sample_rows"] == [2, 5, 9]


def test_many_rules_are_split(spark):
    n = 230
    df = spark.range(3).select(*[F.lit(i).alias(f"c{i}") for i in range(n)])
    contract = {"dataset": {"name": "w"}, "rules": {f"c{i}": {"maximum": 100} for i in range(n)},
                "privacy": {"detect_pii": False}}
    assert validate(df, contract).findings.count() == n - 101


@pytest.mark.parametrize("payload,message", [
    ({"dataset": {"name": "x"}, "unexpected_setting": True}, "unexpected_setting"),
    ({"dataset": {"name": "x"}, "rules": {"v": {"pattern": "[broken"}}}, "does not compile"),
    ({"dataset": {"name": "x"}, "rules": {"v": {"minimum": 2, "maximum": 1}}}, "minimum"),
    ({"dataset": {"name": "x"}, "rules": {"v": {"type": "money"}}}, "money"),
    ({"dataset": {"name": "x"}, "dataset_rules": [{"type": "row_count"}]}, "row_count"),
    ({"dataset": {"name": "x"}, "dataset_rules": [{"type": "unique_combination"}]}, "columns"),
    ({"dataset": {"name": "x"}, "dataset_rules": [
        {"name": "same", "type": "row_count", "minimum": 1}, {"name": "same", "type": "row_count", "maximum": 9}]},
     "two dataset rules"),
    ({"rules": {}}, "dataset"),
])
def test_bad_contracts(payload, message):
    with pytest.raises(ContractError, match=message):
        Contract.from_dict(payload)


def test_column_with_rule_is_required(spark):
    contract = Contract.from_dict({"dataset": {"name": "x", "required_columns": ["a"]}, "rules": {"b": {}}})
    assert contract.required_columns == ["a", "b"]
    df = spark.createDataFrame([(1,)], "a long")
    made = validate(df, contract)
    assert [(r["rule_id"], r["column"]) for r in made.findings.collect()] == [("schema.required_column", "b")]


def test_examples_do_not_depend_on_frequency(spark):
    """Often, rarely and late broken rules give the smallest named rows; rows without a key are counted only."""
    df = spark.range(5000).repartition(6).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("row"), (F.col("id") % 3).alias("often"),
        F.when(F.col("id") > 4000, 9).otherwise(0).alias("late"),
        F.when(F.col("id").isin(6, 7, 4444), 9).otherwise(0).alias("rare"))
    contract = {"dataset": {"name": "h"}, "rules": {
        "often": {"maximum": 1}, "late": {"maximum": 1}, "rare": {"maximum": 1}}, "privacy": {"detect_pii": False}}
    found = {r["column"]: (r["affected_rows"], r["sample_rows"])
             for r in validate(df, contract, row_key="row").findings.collect()}
    assert found == {"often": (1666, [2 + 6 * i for i in range(10)]), "late": (999, list(range(4002, 4022, 2))),
                     "rare": (3, [6, 4444])}


def test_settings_have_types(spark):
    for bad in ({"rules": {"a": {"nullable": "false"}}}, {"privacy": {"severity": "eror"}},
                {"dataset": {"name": "t", "extra_columns_severity": "bad"}}, {"rules": {"a": {"min_length": "3"}}}):
        with pytest.raises(ContractError):
            Contract.from_dict({"dataset": {"name": "t"}, **bad})


def test_any_column_name(spark):
    name = "it's a \\ \"name\" `q` {n}.x"
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "a")], ["row", name])
    rule = {"nullable": False, "unique": True, "pattern": "[b']", "allowed_values": ["it's"]}
    made = validate(df, {"dataset": {"name": "n"}, "rules": {name: rule}}, row_key="row", distinct="exact")
    found = {r["rule_id"]: (r["column"], r["affected_rows"], r["sample_rows"]) for r in made.findings.collect()}
    assert found == {"column.nullable": (name, 1, [1]), "column.unique": (name, 2, [2, 3]),
                     "column.pattern": (name, 2, [2, 3]), "column.allowed_values": (name, 2, [2, 3])}
    assert [r["column"] for r in made.profile.collect()] == ["row", name]
