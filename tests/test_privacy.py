from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from tablepact import validate
from tablepact.operators import pii, profile
from tablepact.operators.redact import TEXT_LIMIT, redact_json, redact_text


def test_ip_matches_the_standard_library(spark):
    rng = random.Random(3)
    values = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1::2::3", "12345::",
              "1:2:3:4:5:6:1.2.3.4", "::ffff:1.2.3.4", "1::1.2.3.4", "1:2:3:4:5::1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4",
              "01.2.3.4", "1.2.3", "1.2.3.4", "256.1.1.1", "fe80::1%eth0", "fe80::1%", ":1", "1:", ":::", "", "x", "1.2.3.4.5"]
    for _ in range(600):
        parts = [rng.choice(["", "0", "1", "ab", "ffff", "10000", "g"]) for _ in range(rng.randint(1, 9))]
        values.append(":".join(parts) + rng.choice(["", "", "::", ":1.2.3.4"]))
        values.append(".".join(str(rng.choice([0, 7, 99, 255, 256, "00"])) for _ in range(rng.randint(3, 5))))

    def valid(v):
        try:
            ipaddress.ip_address(v)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", pii.value_detectors(F.col("v"))["ip_address"].alias("hit")).collect()
    assert [(r["v"], r["hit"]) for r in got if r["hit"] != valid(r["v"])] == []


def test_value_detectors(spark):
    rows = {
        "4111 1111 1111 1111": {"payment_card", "phone"}, "4111-1111-1111-1112": {"phone"}, "123-45-6789": {"government_id"},
        "123456789": {"government_id"}, "+1 (555) 010-1234": {"phone"}, " a@b.co ": {"email"}, "10.0.0.1": {"ip_address"},
        "plain words": set(), "555-0101": set(), "x" * 5000: set(),
    }
    df = spark.createDataFrame([(v,) for v in rows], "v string")
    hits = pii.value_detectors(F.col("v"))
    for r in df.select("v", *[h.alias(c) for c, h in hits.items()]).collect():
        assert {c for c in hits if r[c]} == rows[r["v"]], r["v"]


def test_signals_and_policy(spark):
    df = spark.createDataFrame([(1, "a@x.org", 10.0), (2, "b@x.org", 20.0)], "row long, customer_email string, amount double")
    (signal,) = pii.pii_signals(df).collect()
    assert (signal["category"], signal["confidence"], signal["matching_values"]) == ("email", "high", 2)
    assert sorted(pii.pii_signals(df, "row", 1).collect())[0]["sampled_values"] == 1
    stats = {r["column"]: r for r in profile.profile(df).collect()}
    assert stats["amount"]["mean"] == 15.0 and stats["amount"]["distinct_count"] == 2
    assert "a@x.org" not in str(stats) + str(signal)
    strict = {"dataset": {"name": "p"}, "privacy": {"fail_on_unapproved": True}}
    (found,) = validate(df, strict).findings.collect()
    assert (found["rule_id"], found["severity"]) == ("privacy.unapproved_pii_signal", "error")
    allowed = {"dataset": {"name": "p"}, "privacy": {"allowed_categories": ["email"]}}
    assert validate(df, allowed).findings.count() == 0
    assert pii.pii_signals(df, sample_limit=5).drop("sampled").collect() == pii.pii_signals(df).drop("sampled").collect()
    assert [r["sampled"] for r in pii.pii_signals(df, sample_limit=5).collect()] == [True]
    many = spark.range(0, 5000, 1, 4).select(F.concat(F.lit("u"), F.col("id"), F.lit("@x.org")).alias("contact"))
    (first,) = pii.pii_signals(many, sample_limit=200).collect()
    assert (first["sampled_values"], first["matching_values"], first["confidence"]) == (200, 200, "medium")


def test_type_possible_categories_lose_nothing(spark):
    df = spark.createDataFrame([(4111111111111111, 123456789, 5550101234.5)], "a long, b int, c double")
    got = {(r["column"], r["category"]) for r in pii.pii_signals(df).collect()}
    assert got == {("a", "payment_card"), ("a", "phone"), ("b", "government_id")} | {
        c for c in got if c[0] == "c"}


def test_redaction(spark):
    text = "api_key=abcdef password: hunter2 host=192.168.1.9"
    df = spark.createDataFrame([(text, '{"password":"x","note":"token=abc ip 10.0.0.1","n":5}', "y" * 30000)],
                               "t string, j string, long string")
    row = df.select(redact_text(F.col("t")).alias("t"), redact_json(F.col("j")).alias("j"),
                    F.length(redact_text(F.col("long"), TEXT_LIMIT)).alias("cut"),
                    F.length(redact_text(F.col("long"))).alias("whole")).first()
    assert row["t"] == "api_key=[REDACTED] password=[REDACTED] host=[IP_REDACTED]"
    assert row["j"] == '{"password":"[REDACTED]","note":"token=[REDACTED] ip [IP_REDACTED]","n":5}'
    assert (row["cut"], row["whole"]) == (20000, 30000)


def test_first_cells_are_the_first_ones(spark):
    """The first filled values in key order, wherever a column is filled."""
    rows = [(i, f"a{i}", None if i < 2500 and i % 400 else f"b{i}", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "row long, dense string, sparse string, empty string").repartition(6)
    got: dict = {}
    for r in profile.first_cells(df, "row", 5, ["dense", "sparse", "empty"]).collect():
        got.setdefault(r["column"], set()).add(r["value"])
    want = {"dense": {r[1] for r in rows[:5]}, "sparse": set([r[2] for r in rows if r[2]][:5])}
    assert got == want


def test_profile_of_text_and_typed_columns(spark):
    rows = [("1", "1.5", "true", "2024-01-01", "x", 1, None), ("2", "2", "False", "01/02/2024", None, 3, None)]
    df = spark.createDataFrame(rows, "i string, n string, b string, d string, s string, t long, e string")
    got = {r["column"]: r for r in profile.profile(df, "approx").collect()}
    assert {c: r["observed_type"] for c, r in got.items()} == {
        "i": "integer", "n": "number", "b": "boolean", "d": "datetime", "s": "string", "t": "integer", "e": "unknown"}
    assert [r["column"] for r in profile.profile(df).collect()] == df.columns
    assert (got["n"]["minimum"], got["n"]["maximum"], got["n"]["mean"]) == ("1.5", "2.0", 1.75)
    assert (got["t"]["minimum"], got["t"]["distinct_count"], got["s"]["null_ratio"]) == ("1", 2, 0.5)
    # the streaming form, one expression set per column, says the same
    plain = {r["column"]: r["observed_type"] for r in profile.column_stats(df).collect()}
    assert plain == {c: r["observed_type"] for c, r in got.items()}


def test_distinct_counts_match_brute_force(spark):
    long = "z" * 500
    rows = [(0.0, "a", long), (-0.0, "b", long), (float("nan"), "a", long + "!"), (None, None, None)]
    df = spark.createDataFrame(rows, "d double, s string, t string")
    got = {r["column"]: (r["distinct_count"], r["duplicate_count"]) for r in profile.distinct_counts(df).collect()}
    assert got == {"d": (1, 2), "s": (2, 2), "t": (2, 2)}


def test_validation_uses_profile_counts_for_uniqueness(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "row long, k string")
    contract = {"dataset": {"name": "u"}, "rules": {"k": {"unique": True}}, "privacy": {"detect_pii": False}}
    for distinct in ("none", "exact", "approx"):
        (found,) = validate(df, contract, row_key="row", distinct=distinct).findings.collect()
        assert (found["affected_rows"], found["sample_rows"]) == (2, [1, 2])
