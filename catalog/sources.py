"""Sources and sinks: what is written can be read back and checked like the table itself."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.base import compact, query, table
from catalog.rules import ALL_SQL, contract_of, orders_validation
from tablepact import validate
from tablepact.functions.schemas import flat_schema
from tablepact.operators.findings import FINDING_SCHEMA
from tablepact.plans import history, reports
from tablepact.session import shared_dir
from tablepact.sources import readers, sinks

TEXT_RULES = {
    "o_orderkey": {"type": "integer", "nullable": False, "unique": True},
    "o_orderstatus": {"nullable": False},
    "o_totalprice": {"type": "number", "minimum": 50000},
    "o_orderdate": {"type": "datetime", "nullable": False},
}
COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
TEXT_SQL = """
    SELECT 'column.nullable' AS rule_id, 'error' AS severity, 'completeness' AS category, 'o_orderstatus' AS "column",
           CAST(count(*) AS BIGINT) AS affected_rows, '' AS sample_rows FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0
    UNION ALL SELECT 'column.minimum', 'error', 'validity', 'o_totalprice', CAST(count(*) AS BIGINT), ''
    FROM orders WHERE o_totalprice < 50000 HAVING count(*) > 0"""


def _written(spark, sf_dir, format, **options):
    """Orders written as text, with one status spelled as a missing value."""
    folder = shared_dir(spark, format)
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("o_orderdate"))
    df.write.format(format).options(**options).save(folder)
    return folder


@query("src_csv_roundtrip", TEXT_SQL)
def src_csv_roundtrip(spark, sf_dir):
    folder = _written(spark, sf_dir, "csv", header=True)
    df = readers.read_csv(spark, folder, columns=COLUMNS)
    return compact(validate(df, contract_of("orders", TEXT_RULES)).findings)


@query("src_csv_reordered", TEXT_SQL)
def src_csv_reordered(spark, sf_dir):
    """Columns are picked by the names in the header, wherever they stand."""
    folder = _written(spark, sf_dir, "csv", header=True)
    df = readers.read_csv(spark, folder, columns=list(reversed(COLUMNS)))
    return compact(validate(df, contract_of("orders", TEXT_RULES)).findings)


@query("src_jsonl_roundtrip", TEXT_SQL)
def src_jsonl_roundtrip(spark, sf_dir):
    folder = _written(spark, sf_dir, "json")
    df = readers.nulls_from_tokens(readers.read_json_lines(spark, folder))
    return compact(validate(df, contract_of("orders", TEXT_RULES)).findings)


@query("src_json_arrays", """
    SELECT kind, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM (SELECT 'status' AS kind, o_orderkey FROM orders
          UNION ALL SELECT 'priority', o_orderkey FROM orders) GROUP BY kind""")
def src_json_arrays(spark, sf_dir):
    """Documents that are arrays of objects become one row per object."""
    folder = shared_dir(spark, "json-arrays")
    pair = F.array(*[F.struct("o_orderkey", F.lit(kind).alias("kind"), F.col(c).alias("text"))
                     for kind, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))])
    table(spark, sf_dir, "orders").select(F.to_json(pair).alias("value")).write.text(folder)
    df = readers.read_dataset(spark, folder, format="json")
    return df.groupBy("kind").agg(F.count(F.lit(1)).alias("row_count"), F.sum("o_orderkey").alias("key_sum"))


@query("src_corrupt_records", """
    SELECT CAST(count(*) AS BIGINT) AS records,
           CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS corrupt_records,
           CAST(2 * count(*) FILTER (o_orderstatus <> 'P') AS BIGINT) AS filled_cells FROM orders""")
def src_corrupt_records(spark, sf_dir):
    """JSON lines of which some are cut short and some hold text where a number belongs."""
    folder = shared_dir(spark, "rejects")
    whole = F.to_json(F.struct("o_orderkey", "o_totalprice"))
    broken = F.when(F.col("o_orderpriority") == "5-LOW", F.substring(whole, 1, 12)) \
        .otherwise(F.to_json(F.struct(F.col("o_orderpriority").alias("o_orderkey"))))
    table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "P", broken).otherwise(whole).alias("value")).write.text(folder)
    schema = flat_schema("o_orderkey bigint, o_totalprice double")
    return readers.reject_counts(readers.read_with_rejects(spark, folder, schema), schema)


@query("shape_budget", """
    SELECT 'max_rows' AS measure, CAST(count(*) AS BIGINT) AS observed, CAST(500 AS BIGINT) AS allowed,
           count(*) <= 500 AS within FROM documents
    UNION ALL SELECT 'max_columns', 5, 4, false FROM documents HAVING count(*) > 0
    UNION ALL SELECT 'max_field_length', CAST(max(greatest(length(text), length(lang), length(source))) AS BIGINT), 1000000,
           max(length(text)) <= 1000000 FROM documents""")
def shape_budget(spark, sf_dir):
    return readers.shape_budget(
        table(spark, sf_dir, "documents"), {"max_rows": 500, "max_columns": 4, "max_field_length": 1_000_000})


@query("sink_findings_json", ALL_SQL)
def sink_findings_json(spark, sf_dir):
    folder = shared_dir(spark, "evidence")
    sinks.write_findings(orders_validation(spark, sf_dir).findings, folder, "json", ["category"])
    back = spark.read.schema(FINDING_SCHEMA).json(folder)
    return compact(back)


@query("sink_findings_parquet", ALL_SQL)
def sink_findings_parquet(spark, sf_dir):
    folder = shared_dir(spark, "evidence")
    sinks.write_findings(orders_validation(spark, sf_dir).findings, folder, "parquet")
    return compact(spark.read.parquet(folder))


@query("publish_run", ALL_SQL)
def publish_run(spark, sf_dir):
    """A run recorded twice in the history is there once."""
    store = history.RunHistory(spark, shared_dir(spark, "history"))
    made = orders_validation(spark, sf_dir)
    for _ in range(2):
        store.record(made, datetime(2001, 8, 1))
    latest = history.latest_per_dataset(store.runs())
    return compact(store.findings().join(latest.select("run_id"), "run_id", "left_semi"))


@query("artifact_inventory", """
    SELECT CAST(count(*) AS BIGINT) AS sarif_documents, true AS all_hashed FROM orders
    WHERE o_totalprice < 50000 AND 1 = 0 HAVING count(*) >= 0""".replace(
        "CAST(count(*) AS BIGINT)", f"(SELECT CAST(count(*) AS BIGINT) FROM ({ALL_SQL}))"))
def artifact_inventory(spark, sf_dir):
    """A report folder with one SARIF document per finding, listed with sizes and digests."""
    folder = shared_dir(spark, "sarif")
    results = reports.sarif_results(orders_validation(spark, sf_dir, row_key=None).findings)
    reports.sarif_json(results).write.text(folder)
    listed = history.artifact_inventory(spark, folder)
    texts = spark.read.text(folder).agg(F.count(F.lit(1)).alias("sarif_documents"))
    hashed = listed.agg(F.bool_and((F.length("sha256") == 64) & (F.col("size") >= 0)).alias("all_hashed"))
    return texts.withColumn("all_hashed", hashed.scalar())
