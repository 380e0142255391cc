"""Rule counts on the caller's write, mergeable distinct counts, key state, late rows, fingerprints by range."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablepact import validate
from tablepact.contract import Contract
from tablepact.operators import distinct_state, findings, mentions, predicates, range_fingerprints
from tablepact.plans.observed import ObservedStream, ObservedValidation
from tablepact.sources import readers
from tablepact.streaming import checks, keystate
from tablepact.streaming.late import LateAwareWindows

CONTRACT = {
    "dataset": {"name": "parcels"},
    "rules": {"weight": {"type": "number", "minimum": 1, "nullable": False}, "state": {"allowed_values": ["new", "sent"], "severity": "warning"}},
    "dataset_rules": [{"name": "some", "type": "row_count", "minimum": 100}],
    "privacy": {"detect_pii": False},
}


@pytest.fixture(scope="module")
def parcels(spark):
    return spark.range(60).select(
        "id", F.when(F.col("id") % 7 != 0, (F.col("id") % 5).cast("double")).alias("weight"),
        F.element_at(F.array(F.lit("new"), F.lit("sent"), F.lit("lost")), (F.col("id") % 3 + 1).cast("int")).alias("state"))


def plain(findings):
    return sorted((r["rule_id"], r["column"], r["affected_rows"], r["message"], r["finding_id"]) for r in findings.collect())


def test_observed_findings_without_a_job(spark, parcels, tmp_path):
    observed = ObservedValidation(parcels, CONTRACT, row_key="id")
    spark.sparkContext.setJobGroup("own-write", "")
    observed.rows.write.parquet(str(tmp_path / "rows"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("own-write"))
    spark.sparkContext.setJobGroup("plain-write", "")
    parcels.write.parquet(str(tmp_path / "plain"))
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("plain-write"))
    spark.sparkContext.setJobGroup("after", "")
    observed.totals()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("after")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert plain(observed.findings()) == plain(validate(parcels, CONTRACT).findings)
    assert observed.first_rows() == {"column.minimum:weight": 5, "column.nullable:weight": 0, "column.allowed_values:state": 2}
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 60


def test_observed_empty_table_and_no_rules(spark, parcels, tmp_path):
    observed = ObservedValidation(parcels.limit(0), CONTRACT)
    observed.rows.write.parquet(str(tmp_path / "none"))
    assert plain(observed.findings()) == plain(validate(parcels.limit(0), CONTRACT).findings)
    bare = ObservedValidation(parcels, {"dataset": {"name": "x"}, "privacy": {"detect_pii": False}})
    assert bare.rows.count() == 60 and bare.findings().collect() == []


def test_observed_stream_goes_on_after_a_restart(spark, parcels, tmp_path):
    source, folder, before = str(tmp_path / "in"), str(tmp_path / "out"), None
    for part in (parcels.where("id < 30"), parcels.where("id >= 30")):
        part.repartition(2).write.mode("append").parquet(source)
        stream = checks.read_stream(spark, source + "/", parcels.schema, files_per_batch=1)
        observed = ObservedStream(stream, CONTRACT, row_key="id", before=before)
        observed.finish(observed.rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp")
                        .trigger(availableNow=True).start(f"{folder}/rows"))
        before = observed.totals()
    assert plain(observed.findings()) == plain(validate(parcels, CONTRACT).findings)
    assert observed.first_rows()["column.minimum:weight"] == 5


def test_distinct_counts_of_stored_parts(spark, tmp_path):
    rows = spark.range(50_000).select("id", (F.col("id") % 1500).alias("few"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("é"), F.col("id") % 9000)).alias("text"),
                                      F.lit(None).cast("string").alias("none"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).alias("part"))
    columns = ["id", "few", "text", "none", "x"]
    path = str(tmp_path / "parts")
    distinct_state.distinct_parts(rows, F.col("part"), columns).write.parquet(path)
    stored = spark.read.parquet(path)
    got = {r["column"]: r for r in distinct_state.distinct_of_parts(stored).collect()}
    true = {c: rows.select(c).where(F.col(c).isNotNull()).distinct().count() for c in columns}
    for c in columns:
        assert got[c]["distinct_at_least"] <= true[c] <= got[c]["distinct_at_most"] and got[c]["row_count"] == 50_000
        assert got[c]["distinct_count_exact"] == (true[c] <= 2048) and (not got[c]["distinct_count_exact"] or got[c]["distinct_count"] == true[c])
        assert abs(got[c]["distinct_count"] - true[c]) <= 0.07 * true[c]
    assert got["none"]["null_count"] == 50_000 and got["text"]["null_count"] == 12_500
    # a changed part is put in without reading the others
    changed = rows.where("part = 3").withColumn("few", F.col("few") + 1500)
    again = distinct_state.refreshed_parts(stored, changed, F.col("part"), columns)
    whole = rows.where("part <> 3").unionByName(changed)
    few = distinct_state.distinct_of_parts(again).where("column = 'few'").first()
    assert few["row_count"] == 50_000 and few["distinct_at_least"] <= whole.select("few").distinct().count() <= few["distinct_at_most"]
    met = {r["column"]: r for r in distinct_state.overlap_of_parts(stored, F.col("part") < 2, F.col("part") == 20).collect()}
    assert met["x"]["both"] == 0 and met["x"]["only_left"] == 7 and met["x"]["only_right"] == 0
    assert distinct_state.distinct_of_parts(stored.limit(0)).collect() == []


def test_key_state_over_restarts(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = [(i % 40, "a" if i % 3 else None) for i in range(300)] + [(None, None)] * 5 + [(1000 + i, "b") for i in range(20)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, kind string")
    sizes = []
    for step in range(4):  # restarts with two micro-batches each
        some = spark.createDataFrame(rows[step::4], "k int, kind string")
        some.repartition(2).write.mode("append").parquet(source)
        stream = checks.read_stream(spark, source + "/", df.schema, files_per_batch=1)
        keystate.count_keys(stream, ["k", "kind"], checkpoint).awaitTermination()
        # the newest version of the state alone: what remains once maintenance has deleted the older ones
        newest = [max((f for f in os.listdir(d) if f.endswith(".zip")), key=lambda f: int(f.split(".")[0].split("_")[0]), default=None)
                  for d, _, _ in os.walk(f"{checkpoint}/state") if any(f.endswith(".zip") for f in os.listdir(d))]
        sizes.append(len(newest))
    per_key: dict = {}
    for r in rows:
        per_key[r] = per_key.get(r, 0) + 1
    several = [n for k, n in per_key.items() if n > 1 and k != (None, None)]
    assert tuple(keystate.duplicates_in_state(spark, checkpoint).first()) == (len(several), sum(several))
    assert keystate.keys_in_state(spark, checkpoint).count() == len(per_key) - 1
    assert len(set(sizes)) == 1  # as many stores, four times the micro-batches; no other folder holds keys
    assert sorted(f for f in os.listdir(checkpoint) if f[0] != ".") == ["commits", "metadata", "offsets", "sources", "state"]


def test_late_rows_and_windows_are_the_table(spark, tmp_path):
    start, rng = datetime(2024, 1, 1), random.Random(5)
    batches = [[(k * 1000 + i, start + timedelta(hours=8 * k, minutes=rng.randrange(-900, 480)), rng.randrange(10)) for i in range(50)] for k in range(4)]
    batches[2].append((9999, None, 1))
    source, schema = str(tmp_path / "in"), "id int, at timestamp, value int"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = checks.read_stream(spark, source + "/", spark.createDataFrame([], schema).schema, files_per_batch=1)
    rules = predicates.column_checks(stream.schema, Contract.from_dict({"dataset": {"name": "x"}, "rules": {"value": {"minimum": 5}}}))
    made = LateAwareWindows(stream, rules, "at", "2 hours", "30 minutes", str(tmp_path / "out"))
    made.start().awaitTermination()
    counts, late, newest = {}, set(), None
    for rows in batches:
        mark = None if newest is None else newest - timedelta(minutes=30)
        for i, at, value in rows:
            if at is None:
                late.add(i)
                continue
            begin = start + timedelta(hours=2) * ((at - start) // timedelta(hours=2))
            if mark is not None and begin + timedelta(hours=2) <= mark:
                late.add(i)
                continue
            n = counts.setdefault(begin, [0, 0])
            n[0], n[1] = n[0] + 1, n[1] + (value < 5)
        newest = max([at for _, at, _ in rows if at is not None] + ([newest] if newest else []))
    got = {r["window_start"]: (r["rows"], r["affected_rows"], r["final"]) for r in made.windows(final=None).collect()}
    final = newest - timedelta(minutes=30)
    assert got == {b: (n, low, b + timedelta(hours=2) <= final) for b, (n, low) in counts.items()}
    assert {r["id"] for r in made.late().collect()} == late and late > {9999}
    assert sum(n for n, _, _ in got.values()) + len(late) == 201
    made.start().awaitTermination()  # nothing new: nothing changes
    assert made.late().count() == len(late)


def test_range_fingerprints(spark):
    rows = [(i, f"name {i % 50}", None if i % 9 == 0 else i / 3) for i in range(3000)] + [(7, "twice", 1.0)] * 2
    schema, part = "id long, name string, x double", F.floor(F.col("id") / 100)
    old = spark.createDataFrame(rows, schema)
    sums = range_fingerprints.range_fingerprints(old, part)
    shuffled = range_fingerprints.range_fingerprints(old.orderBy(F.rand(1)).repartition(7), part)
    assert range_fingerprints.changed_parts(sums, shuffled).collect() == []
    whole = range_fingerprints.table_fingerprint(sums).first()
    assert whole == range_fingerprints.table_fingerprint(range_fingerprints.rolled_up(sums, 8)).first() and whole["row_count"] == 3002
    edits = [(i, n, x) for i, n, x in rows if i != 2500]  # one removed
    edits = [(i, "other" if i == 1234 else n, x) for i, n, x in edits] + [(9100, "new", 0.0), (7, "twice", 1.0)]
    new = spark.createDataFrame(edits, schema).repartition(3)
    for levels in (0, 1, 3):
        changed = range_fingerprints.changed_parts(sums, range_fingerprints.range_fingerprints(new, part), levels, 4)
        assert sorted(map(tuple, changed.collect())) == [(0, 102, 103), (12, 100, 100), (25, 100, 99), (91, 0, 1)]
    found = range_fingerprints.changed_rows(old, new, changed, part, "id").collect()
    assert sorted(map(tuple, found)) == [(0, 7, "added"), (12, 1234, "edited"), (25, 2500, "removed"), (91, 9100, "added")]
    assert range_fingerprints.table_fingerprint(sums.limit(0)).first()["row_count"] == 0


def test_unreadable_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(20).repartition(2).write.parquet(folder)
    spark.range(0).coalesce(1).write.mode("append").parquet(folder)  # an empty file is a readable one
    whole = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    with open(f"{folder}/{whole}", "rb") as f:
        content = f.read()
    for name, data in (("cut", content[:-20]), ("text", b"PAR1 no footer PAR1"), ("nothing", b"")):
        with open(f"{folder}/{name}.parquet", "wb") as f:
            f.write(data)
    found = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in readers.unreadable_files(spark, folder).collect()}
    assert set(found) == {"cut.parquet", "text.parquet"} and all(found.values())  # Spark passes over files of no bytes
    assert readers.readable_parquet(spark, folder).count() == 20
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "good.csv").write_bytes("a,é\n1,�\n".encode())
    (lines / "bad.csv").write_bytes("a,b\n1,é\n".encode("latin-1"))
    rows = readers.unreadable_files(spark, str(lines), "csv").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["reason"]) for r in rows] == [("bad.csv", "not UTF-8")]


def test_rollup_levels(spark):
    rows = [("validity", "error", 3), ("validity", "error", 4), ("validity", "info", 1), ("schema", None, 0)]
    df = spark.createDataFrame(rows, "category string, severity string, affected_rows long")
    got = {(r["category"], r["severity"], r["level"]): (r["findings"], r["affected_rows"]) for r in findings.summarize_levels(df, ["category", "severity"]).collect()}
    assert got == {("validity", "error", 0): (2, 7), ("validity", "info", 0): (1, 1), ("schema", None, 0): (1, 0), ("validity", None, 1): (3, 8),
                   ("schema", None, 1): (1, 0), (None, None, 3): (4, 8)}


def test_mentions_in_running_text(spark):
    texts = ["Write to é.o@x.org, ann.b+c@mail.example.com or 10.0.0.7; not 10.0.0.700.", "card 4111-1111-1111-1111, call +1 (555) 010-2345 🙂 id 123-45-6789.",
             "nothing 2023 here", "", None, "a@b.co", "a@b.coa@b.co 999.1.1.1"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(5, "a@b.co", "again")], "id int, text string, m string").repartition(3)
    rows = mentions.mentions(df, "id", "text").collect()
    got = sorted((r["id"], texts[r["id"]][r["start"]:r["end"]], r["category"], r["values"]) for r in rows)
    assert got == [(0, ".o@x.org", "email", 1), (0, "10.0.0.7", "ip_address", 1), (0, "ann.b+c@mail.example.com", "email", 1),
                   (1, "+1 (555) 010-2345", "phone", 1), (1, "123-45-6789", "government_id", 1), (1, "4111-1111-1111-1111", "payment_card", 2),
                   (5, "a@b.co", "email", 1), (6, "a@b.coa", "email", 1)]
    masked = {r["id"]: r["text"] for r in mentions.redact_mentions(df.where("m = 'x'"), "id", "text").collect()}
    assert masked[1] == "card [PAYMENT_CARD], call [PHONE] 🙂 id [GOVERNMENT_ID]."
    assert masked[2] == texts[2] and masked[3] == "" and masked[4] is None and masked[5] == "[EMAIL]"
    assert mentions.mentions(df.limit(0), "id", "text").collect() == []
