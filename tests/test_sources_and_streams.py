from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from tablepact import Contract, ContractError, validate
from tablepact.functions.schemas import flat_schema
from tablepact.session import shared_dir
from tablepact.sources import readers, sinks
from tablepact.streaming import checks
from tablepact.streaming.validate import StreamValidation


def test_csv_tokens_and_quotes(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('id,when,note\n1,2024-01-01,"a ""b"", c"\n2,NA,null\n')
    df = readers.read_dataset(spark, str(path))
    assert df.dtypes == [("id", "string"), ("when", "string"), ("note", "string")]
    assert sorted(map(tuple, df.collect())) == [("1", "2024-01-01", 'a "b", c'), ("2", None, None)]


def test_json_shapes(spark, tmp_path):
    rows = [{"id": 1, "when": "x"}, {"id": 2, "when": "y"}]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "d.json").write_text(json.dumps(rows, indent=2))
    for name in ("d.jsonl", "d.json"):
        df = readers.read_dataset(spark, str(tmp_path / name))
        assert (df.count(), len(df.columns)) == (2, 2)
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "x.unknown")


def test_registered_reader_and_row_position(spark, tmp_path):
    readers.register_reader("numbers", lambda s, path: s.range(5))
    assert readers.read_dataset(spark, "any.numbers").count() == 5
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "p"))
    df = readers.read_parquet(spark, str(tmp_path / "p"), row_position="pos")
    assert sorted(r["pos"] for r in df.collect()) == [1, 2, 3, 4]
    assert readers.discover_readers() == []


def test_python_data_source(spark):
    class LettersReader(DataSourceReader):
        def read(self, partition):
            yield ("a",)
            yield ("b",)

    class Letters(DataSource):
        @classmethod
        def name(cls):
            return "letters"

        def schema(self):
            return "letter string"

        def reader(self, schema):
            return LettersReader()

    spark.dataSource.register(Letters)
    df = readers.read_dataset(spark, "", format="letters")
    made = validate(df, {"dataset": {"name": "l"}, "rules": {"letter": {"allowed_values": ["a"]}}})
    assert [r["affected_rows"] for r in made.findings.collect()] == [1]


def test_rejects(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{"a": "x"}\n{"a": \n{"a": 4}\n')
    schema = flat_schema("a bigint")
    row = readers.reject_counts(readers.read_with_rejects(spark, str(tmp_path / "r.jsonl"), schema), schema).first()
    assert (row["records"], row["corrupt_records"], row["filled_cells"]) == (4, 2, 2)


def test_shape_budget(spark):
    df = spark.createDataFrame([("abc", 1), ("abcdef", 2)], "t string, n long")
    got = {r["measure"]: (r["observed"], r["within"]) for r in readers.shape_budget(
        df, {"max_rows": 1, "max_field_length": 6}).collect()}
    assert got == {"max_rows": (2, False), "max_field_length": (6, True)}
    with pytest.raises(ValueError, match="max_size"):
        readers.shape_budget(df, {"max_size": 1})


def test_budget_is_checked_before_validating(spark):
    contract = {"dataset": {"name": "b"}, "rules": {"id": {"minimum": 5}}}
    with pytest.raises(ContractError, match="max_rows is 3, allowed 1"):
        validate(spark.range(3), contract, budget={"max_rows": 1})
    assert validate(spark.range(3), contract, budget={"max_rows": 3}).findings.count() == 1


def test_evidence_formats(spark, tmp_path):
    df = spark.createDataFrame([(None,)], "a long")
    found = validate(df, {"dataset": {"name": "e"}, "rules": {"a": {"nullable": False}}}).findings
    sinks.write_findings(found, str(tmp_path / "j"), "json", ["category"])
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_findings(found, str(tmp_path / "x"), "xlsx")


@pytest.fixture()
def batches(spark, tmp_path):
    """Three files of two rows: order ids 1,2 | 3,1 | 5,2 with row numbers 1..6."""
    ids = [1, 2, 3, 1, 5, 2]
    for i in range(3):
        rows = [(2 * i + k + 1, ids[2 * i + k], (2 * i + k) * 10) for k in range(2)]
        spark.createDataFrame(rows, "row long, order_id long, amount long").coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
    schema = flat_schema("row bigint, order_id bigint, amount bigint")
    return lambda: checks.read_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1), str(tmp_path / "in")


def test_stream_equals_batch(spark, batches):
    stream, path = batches
    contract = Contract.from_dict({"dataset": {"name": "o"}, "rules": {"amount": {"minimum": 30}, "order_id": {"maximum": 2}}})
    merged = checks.stream_row_findings(stream(), contract, shared_dir(spark, "t"), "row")
    whole = validate(spark.read.parquet(path), contract, row_key="row").findings
    pick = ["rule_id", "column", "affected_rows", "sample_rows"]
    assert sorted(merged.select(pick).collect()) == sorted(whole.select(pick).collect())


def test_whole_contract_on_a_stream(spark, batches):
    stream, path = batches
    contract = {
        "dataset": {"name": "o", "required_columns": ["gone"], "allow_extra_columns": False},
        "rules": {"amount": {"minimum": 30}, "order_id": {"unique": True, "maximum": 2}},
        "dataset_rules": [
            {"type": "row_count", "maximum": 5}, {"type": "unique_combination", "columns": ["order_id", "amount"]},
            {"type": "reference_exists", "column": "order_id", "reference_dataset": "known", "reference_column": "id"}],
        "privacy": {"detect_pii": True},
    }
    known = {"known": spark.createDataFrame([(1,), (3,)], "id long")}
    run = StreamValidation(stream(), contract, shared_dir(spark, "t"), references=known, row_key="row")
    query = run.start()
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 2
    whole = validate(spark.read.parquet(path), contract, references=known, row_key="row").findings
    pick = ["finding_id", "rule_id", "column", "affected_rows", "message"]
    assert sorted(run.findings().select(pick).collect()) == sorted(whole.select(pick).collect())
    row_rules = "rule_id in ('column.minimum', 'column.maximum')"
    assert sorted(run.findings().where(row_rules).collect()) == sorted(whole.where(row_rules).collect())


def test_stream_unique_across_batches(spark, batches):
    stream, _ = batches
    folder = shared_dir(spark, "t")
    assert checks.stream_duplicate_rows(stream(), ["order_id"], folder).first()["affected"] == 4
    done = checks.batch_results(spark, f"{folder}/out", flat_schema("k0 bigint, n bigint"))
    assert done.select("batch_id").distinct().count() >= 3


def test_stream_newly_affected_rows(spark, batches):
    stream, _ = batches
    with checks.state_on_disk(spark):
        rows = checks.newly_affected_rows(stream(), ["order_id"], "row")
        sink = checks.drain(rows, shared_dir(spark, "t"))
    got = checks.batch_results(spark, sink, rows.schema)
    assert sorted(r["row"] for r in got.collect()) == [1, 2, 4, 6]


def test_stream_references_and_totals(spark, batches):
    stream, _ = batches
    known = spark.createDataFrame([(1,), (3,)], "id long")
    assert checks.stream_reference_misses(stream(), "order_id", known, "id", shared_dir(spark, "t")).first()["affected"] == 3
    totals = checks.stream_totals(stream(), shared_dir(spark, "t")).collect()
    assert {(r["column"], r["row_count"], r["null_count"]) for r in totals} == {
        ("row", 6, 0), ("order_id", 6, 0), ("amount", 6, 0)}
    stats = {r["column"]: r for r in checks.stream_profile(stream(), shared_dir(spark, "t")).collect()}
    assert stats["order_id"]["distinct_count"] == 4 and stats["amount"]["mean"] == 25.0


def test_stream_bounded_deduplication(spark, batches):
    stream, _ = batches
    timed = stream().withColumn("at", F.timestamp_seconds(F.col("row")))
    rows = checks.unseen_within(timed, ["order_id"], "at", "1 hour").select("row")
    sink = checks.drain(rows, shared_dir(spark, "t"))
    assert checks.batch_results(spark, sink, rows.schema).count() == 4


def test_csv_stream(spark, tmp_path):
    for i, body in enumerate(("id,v\n1,NA\n2,5\n", "id,v\n3,x\n")):
        (tmp_path / f"{i}.csv").write_text(body)
    stream = readers.nulls_from_tokens(checks.read_stream(
        spark, str(tmp_path), flat_schema("id string, v string"), "csv", 1, header=True))
    contract = {"dataset": {"name": "c"}, "rules": {"v": {"type": "number", "nullable": False}}}
    run = StreamValidation(stream, contract, shared_dir(spark, "t"))
    run.start().awaitTermination()
    assert {(r["rule_id"], r["affected_rows"]) for r in run.findings().collect()} == {
        ("column.nullable", 1), ("column.type", 1)}


def test_key_examples_on_a_stream(spark, batches):
    stream, path = batches
    contract = {
        "dataset": {"name": "o"}, "rules": {"order_id": {"unique": True}},
        "dataset_rules": [
            {"name": "pair", "type": "unique_combination", "columns": ["order_id"]},
            {"name": "fk", "type": "reference_exists", "column": "order_id", "reference_dataset": "known", "reference_column": "id"}]}
    known = {"known": spark.createDataFrame([(1,), (3,)], "id long")}
    run = StreamValidation(stream(), contract, shared_dir(spark, "t"), references=known, row_key="row")
    run.start().awaitTermination()
    whole = validate(spark.read.parquet(path), contract, references=known, row_key="row").findings
    assert sorted(run.findings().collect()) == sorted(whole.collect())
    assert {r["rule_id"]: len(r["sample_rows"]) for r in run.findings().collect()} == {
        "column.unique": 4, "dataset.unique_combination.pair": 4, "dataset.reference_exists.fk": 3}


@pytest.mark.parametrize("change", ["row bigint, order_id bigint", "row bigint, order_id bigint, amount bigint, more bigint"])
def test_streams_stop_at_changed_columns(spark, batches, change):
    stream, path = batches
    folders = [shared_dir(spark, "t") for _ in range(2)]
    contract = {"dataset": {"name": "o"}, "rules": {"amount": {"minimum": 0}}}
    starts = [lambda: StreamValidation(stream(), contract, folders[0]).start(),
              lambda: checks.run_batches(checks.running_totals(stream().select("amount")), f"{folders[1]}/out",
                                         f"{folders[1]}/checkpoint", mode="complete")]
    for start in starts:
        start().awaitTermination()
    names = [c.split()[0] for c in change.split(", ")]
    spark.createDataFrame([tuple(range(7, 7 + len(names)))], change).write.mode("append").parquet(path)
    for start in starts:
        with pytest.raises(Exception, match="Columns changed between files"):
            start().awaitTermination()


def test_csv_streams_stop_at_changed_columns(spark, tmp_path):
    for i, body in enumerate(("id,v\n1,2\n", "id\n3\n")):
        (tmp_path / f"{i}.csv").write_text(body)
    stream = checks.read_stream(spark, str(tmp_path), flat_schema("id string, v string"), "csv", 1, header=True)
    with pytest.raises(Exception, match="Columns changed between files"):
        checks.drain(stream, shared_dir(spark, "t"))


def test_stream_files_grow_in_number_with_the_table(spark, tmp_path):
    """A table that is read in many parts is no three files, whatever the number of micro-batches."""
    from catalog.streams import stream_of

    spark.range(0, 4000, 1, 40).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "t.parquet"))
    settings = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        parts = spark.read.parquet(str(tmp_path / "t.parquet")).rdd.getNumPartitions()
        stream = stream_of(spark, str(tmp_path), "t")
        seen = []

        def each(batch):
            seen.append([r["n"] for r in batch.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()])
            return batch
        sink = checks.drain(stream, str(tmp_path / "out"), each=each)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert parts >= 12 and len(seen) == 3 and sum(map(len, seen)) >= 12  # before: three files in all
    assert max(map(max, seen)) <= 4000 / 3 / 2
    assert sorted(r["k"] for r in spark.read.parquet(sink).collect()) == list(range(4000))
