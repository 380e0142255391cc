"""The same rules over the tables read as streams, everything available in one run."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import AS_OF, compact, query, row_rule_sql, table
from catalog.rules import KEY_SQL, ORDERS, ROW_SQL, SCHEMA_SQL, contract_of
from tablepact import Contract
from tablepact.operators import predicates
from tablepact.session import shared_dir
from tablepact.streaming import checks
from tablepact.streaming.validate import StreamValidation


BATCHES = 3


def stream_of(spark, sf_dir, name):
    return in_batches(table(spark, sf_dir, name))


def in_batches(df):
    """The rows as a stream of several micro-batches.

    Files grow in number with the partitions of ``df``, not in size: a task deals out and writes no more than
    about a partition, and a micro-batch takes its share of the files.
    """
    files = max(BATCHES, df.rdd.getNumPartitions())
    folder = shared_dir(df.sparkSession, "stream-source")
    df.repartition(files).write.parquet(folder)
    return checks.read_stream(df.sparkSession, folder + "/", df.schema, files_per_batch=-(-files // BATCHES))


def stream_at_once(spark, sf_dir, name):
    """The table as one micro-batch: with a watermark, later files would hold late rows."""
    path = f"{sf_dir}/{name}.parquet"
    return checks.read_stream(spark, path, spark.read.parquet(path).schema)


ROW_RULES = {
    "o_totalprice": {"minimum": 50000, "severity": "warning"},
    "o_orderstatus": {"allowed_values": ["O", "F"]},
    "o_orderdate": {"type": "datetime", "maximum_age_hours": 48},
}


@query("stream_row_rules", " UNION ALL ".join([
    row_rule_sql("column.minimum", "validity", "o_totalprice", "orders", "o_totalprice < 50000", "o_orderkey", "warning"),
    row_rule_sql("column.allowed_values", "validity", "o_orderstatus", "orders", "o_orderstatus NOT IN ('O', 'F')",
                 "o_orderkey"),
    row_rule_sql("column.maximum_age_hours", "freshness", "o_orderdate", "orders",
                 f"o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR", "o_orderkey")]))
def stream_row_rules(spark, sf_dir):
    contract = Contract.from_dict(contract_of("orders", ROW_RULES))
    return compact(checks.stream_row_findings(
        stream_of(spark, sf_dir, "orders"), contract, shared_dir(spark, "stream"), "o_orderkey", AS_OF))


@query("stream_unique", """
    SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS affected
    FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)""")
def stream_unique(spark, sf_dir):
    return checks.stream_duplicate_rows(
        stream_of(spark, sf_dir, "events"), ["user_id", "event_type"], shared_dir(spark, "stream"))


@query("stream_reference_exists", """
    SELECT CAST(count(*) AS BIGINT) AS affected FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def stream_reference_exists(spark, sf_dir):
    return checks.stream_reference_misses(
        stream_of(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"), "doc_id",
        shared_dir(spark, "stream"))


@query("stream_totals", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS row_count,
        CAST(count(*) - count({e}) AS BIGINT) AS null_count FROM events"""
    for c, e in (("event_id", "event_id"), ("kind", "nullif(event_type, 'click')"), ("value", "value"))))
def stream_totals(spark, sf_dir):
    stream = stream_of(spark, sf_dir, "events").select(
        "event_id", F.nullif("event_type", F.lit("click")).alias("kind"), "value")
    return checks.stream_totals(stream, shared_dir(spark, "stream"))


@query("stream_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS observed_type, CAST(count(*) AS BIGINT) AS row_count,
        CAST(count(*) - count({c}) AS BIGINT) AS null_count, {m} AS mean, false AS distinct_count_exact FROM events"""
    for c, t, m in (("event_id", "integer", "round(avg(event_id), 4)"), ("user_id", "integer", "round(avg(user_id), 4)"),
                    ("event_type", "string", "CAST(NULL AS DOUBLE)"), ("value", "number", "round(avg(value), 4)"))))
def stream_profile(spark, sf_dir):
    stream = stream_of(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return checks.stream_profile(stream, shared_dir(spark, "stream")).select(
        "column", "observed_type", "row_count", "null_count", F.round("mean", 4).alias("mean"), "distinct_count_exact")


@query("stream_windowed_quality", """
    WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s, count(*) AS n, count(*) FILTER (value < 5) AS low,
                      count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS odd FROM events GROUP BY 1),
         kept AS (SELECT * FROM w WHERE s + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))
    SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, 'column.minimum' AS rule_id, 'value' AS "column",
           CAST(n AS BIGINT) AS "rows", CAST(low AS BIGINT) AS affected_rows FROM kept
    UNION ALL SELECT strftime(s, '%Y-%m-%d %H:%M'), 'column.allowed_values', 'event_type', CAST(n AS BIGINT),
           CAST(odd AS BIGINT) FROM kept""")
def stream_windowed_quality(spark, sf_dir):
    """Rule counts per six-hour window; a window is final once the watermark passed its end."""
    stream = stream_at_once(spark, sf_dir, "events")
    rules = {"value": {"minimum": 5}, "event_type": {"allowed_values": ["click", "view", "purchase"]}}
    made = predicates.column_checks(stream.schema, Contract.from_dict(contract_of("events", rules)))
    windows = checks.windowed_quality(stream, made, "ts", "6 hours", "1 hour")
    sink = checks.drain(windows, shared_dir(spark, "stream"))
    done = checks.batch_results(spark, sink, windows.schema)
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
                       "rule_id", "column", "rows", "affected_rows")


@query("stream_validation", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT * EXCLUDE (sample_rows) FROM ({sql})" for sql in [*ROW_SQL, *KEY_SQL, SCHEMA_SQL]) + ")")
def stream_validation(spark, sf_dir):
    """A whole contract on a stream: row rules, keys and references merged over all batches."""
    run = StreamValidation(stream_of(spark, sf_dir, "orders"), ORDERS, shared_dir(spark, "stream"), as_of=AS_OF,
                           references={"lineitem": table(spark, sf_dir, "lineitem")})
    run.start().awaitTermination()
    return run.findings().select("rule_id", "severity", "category", "column", "affected_rows")
