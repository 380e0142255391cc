"""Checks without a scan of their own, mergeable state, and comparisons by ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import AS_OF, compact, query, table
from catalog.privacy import CONTACTS, _signals_sql, contacts, test_sql
from catalog.rules import ALL_SQL, KEY_SQL, ORDERS, ROW_SQL, SCHEMA_SQL, column_rule, contract_of, orders_validation
from catalog.streams import in_batches, stream_of
from tablepact import Contract, validate
from tablepact.operators import distinct_state, findings, mentions, predicates, range_fingerprints
from tablepact.plans.observed import ObservedStream, ObservedValidation
from tablepact.session import shared_dir
from tablepact.sources import readers
from tablepact.streaming import checks, keystate
from tablepact.streaming.late import LateAwareWindows
from tablepact.streaming.validate import StreamValidation

ROW_RULES_SQL = " UNION ALL ".join(f"SELECT * EXCLUDE (sample_rows) FROM ({sql})" for sql in ROW_SQL)
SHOWN = ("rule_id", "severity", "category", "column", "affected_rows")


@query("observed_validation", ROW_RULES_SQL)
def observed_validation(spark, sf_dir):
    """Row rules counted while the caller writes the table."""
    observed = ObservedValidation(table(spark, sf_dir, "orders"), ORDERS, row_key="o_orderkey", as_of=AS_OF)
    observed.rows.write.parquet(shared_dir(spark, "observed"))
    return observed.findings().select(*SHOWN)


@query("stream_observed_validation", ROW_RULES_SQL)
def stream_observed_validation(spark, sf_dir):
    """Row rules counted on a stream's own write, added up from the progress of three micro-batches."""
    observed = ObservedStream(stream_of(spark, sf_dir, "orders"), ORDERS, row_key="o_orderkey", as_of=AS_OF)
    folder = shared_dir(spark, "observed")
    query_ = (observed.rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
              .trigger(availableNow=True).start(f"{folder}/rows"))
    return observed.finish(query_).findings().select(*SHOWN)


COUNTED = ("event_id", "user_id", "event_type", "value", "day")


@query("profile_mergeable_distinct", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count,
        count(DISTINCT {c}) <= 2048 AS distinct_count_exact,
        CAST(CASE WHEN count(DISTINCT {c}) <= 2048 THEN count(DISTINCT {c}) END AS BIGINT) AS distinct_count
        FROM (SELECT event_id, user_id, nullif(event_type, 'click') AS event_type, value, CAST(ts AS DATE) AS day FROM events)""" for c in COUNTED))
def profile_mergeable_distinct(spark, sf_dir):
    """Distinct counts of the whole table from one stored sketch per day and column."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.nullif("event_type", F.lit("click")).alias("event_type"), "value", F.to_date("ts").alias("day"))
    path = shared_dir(spark, "distinct-parts")
    distinct_state.distinct_parts(events, F.col("day").cast("string"), list(COUNTED)).write.parquet(path)
    found = distinct_state.distinct_of_parts(spark.read.parquet(path))
    return found.select("column", "row_count", "null_count", "distinct_count_exact",
                        F.when(F.col("distinct_count_exact"), F.col("distinct_count")).alias("distinct_count"))


@query("stream_unique_state", """
    SELECT CAST(count(*) AS BIGINT) AS "keys", CAST(coalesce(sum(n), 0) AS BIGINT) AS affected
    FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type) WHERE n > 1""")
def stream_unique_state(spark, sf_dir):
    """Uniqueness over three micro-batches, read from the state store."""
    checkpoint = shared_dir(spark, "key-state")
    keystate.count_keys(stream_of(spark, sf_dir, "events"), ["user_id", "event_type"], checkpoint).awaitTermination()
    return keystate.duplicates_in_state(spark, checkpoint)


@query("stream_late_rows", """
    WITH e AS (SELECT *, event_id % 3 AS batch, time_bucket(INTERVAL 6 HOUR, ts) AS s FROM events),
    newest AS (SELECT batch, max(ts) AS ts FROM e GROUP BY batch),
    marks AS (SELECT b.batch, (SELECT max(n.ts) - INTERVAL 2 HOUR FROM newest n WHERE n.batch < b.batch) AS mark FROM newest b),
    judged AS (SELECT e.*, coalesce(s + INTERVAL 6 HOUR <= mark, false) AS late FROM e JOIN marks USING (batch)),
    final AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM newest)
    SELECT CASE WHEN late THEN 'late' WHEN s + INTERVAL 6 HOUR <= mark THEN 'final' ELSE 'open' END AS part,
           strftime(s, '%Y-%m-%d %H:%M') AS window_start, CAST(count(*) AS BIGINT) AS "rows",
           CAST(count(*) FILTER (value < 5) AS BIGINT) AS affected_rows
    FROM judged, final GROUP BY 1, 2""")
def stream_late_rows(spark, sf_dir):
    """Windows of three micro-batches in a stated order, and the rows that came too late for them: together the table."""
    events, source = table(spark, sf_dir, "events"), shared_dir(spark, "stream-source")
    for k in range(3):  # one after another, so that they are read in this order
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    stream = checks.read_stream(spark, source + "/", events.schema, files_per_batch=1)
    rules = predicates.column_checks(stream.schema, Contract.from_dict(contract_of("events", {"value": {"minimum": 5}})))
    made = LateAwareWindows(stream, rules, "ts", "6 hours", "2 hours", shared_dir(spark, "stream"))
    made.start().awaitTermination()
    windows = made.windows(final=None).select(F.when(F.col("final"), "final").otherwise("open").alias("part"), "window_start", "rows", "affected_rows")
    late = made.late().groupBy(F.window("ts", "6 hours")["start"].alias("window_start")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value") < 5).alias("affected_rows"))
    found = windows.unionByName(late.withColumn("part", F.lit("late")))
    return found.select("part", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "rows", "affected_rows")


@query("fingerprint_changed_parts", """
    WITH n AS (SELECT o_orderkey, o_orderkey // 1000 AS part, o_orderkey % 9973 = 0 AS edited, o_orderkey % 14983 = 1 AS gone FROM orders)
    SELECT CAST(part AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS rows_old, CAST(count(*) FILTER (NOT gone) AS BIGINT) AS rows_new,
           CAST(count(*) FILTER (edited AND NOT gone) AS BIGINT) AS edited, CAST(count(*) FILTER (gone) AS BIGINT) AS removed
    FROM n GROUP BY part HAVING bool_or(edited OR gone)""")
def fingerprint_changed_parts(spark, sf_dir):
    """Ranges of a thousand order keys whose rows were edited or removed, found by sums; only their rows are compared."""
    old = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 9973 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = old.where("o_orderkey % 14983 <> 1").withColumn("o_totalprice", price)
    part = F.floor(F.col("o_orderkey") / 1000)
    stored = []
    for df in (old, new):
        path = shared_dir(spark, "range-sums")
        range_fingerprints.range_fingerprints(df, part).write.parquet(path)
        stored.append(spark.read.parquet(path))
    changed = range_fingerprints.changed_parts(*stored)
    rows = range_fingerprints.changed_rows(old, new, changed, part, "o_orderkey")
    per_part = rows.groupBy("part").agg(F.count_if(F.col("change") == "edited").alias("edited"), F.count_if(F.col("change") == "removed").alias("removed"))
    return changed.join(per_part, "part").select("part", "rows_old", "rows_new", "edited", "removed")


@query("summary_rollup", f"""
    SELECT category, severity, CAST(grouping_id(category, severity) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS findings,
           CAST(sum(affected_rows) AS BIGINT) AS affected_rows FROM ({ALL_SQL}) GROUP BY ROLLUP (category, severity)""")
def summary_rollup(spark, sf_dir):
    """Findings by category and severity with subtotals."""
    return findings.summarize_levels(orders_validation(spark, sf_dir).findings, ["category", "severity"])


@query("stream_validation_examples", " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in [*ROW_SQL, *KEY_SQL, SCHEMA_SQL]))
def stream_validation_examples(spark, sf_dir):
    """A whole contract on three micro-batches, with the example rows a batch run names."""
    run = StreamValidation(stream_of(spark, sf_dir, "orders"), ORDERS, shared_dir(spark, "stream"), as_of=AS_OF, row_key="o_orderkey",
                           references={"lineitem": table(spark, sf_dir, "lineitem")})
    run.start().awaitTermination()
    return compact(run.findings())


@query("stream_pii_sampled", _signals_sql(f"(SELECT * FROM {CONTACTS} ORDER BY customer_id LIMIT 200)", "true"))
def stream_pii_sampled(spark, sf_dir):
    """The first 200 filled values of each column over three micro-batches, in key order."""
    return checks.stream_pii_signals(in_batches(contacts(spark, sf_dir)), "customer_id", 200, shared_dir(spark, "stream"))


@query("src_unreadable_files", """
    SELECT 'read' AS part, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders
    UNION ALL SELECT 'set aside', 2, NULL""")
def src_unreadable_files(spark, sf_dir):
    """A folder of the orders with a file of text and an empty file that only claim to be Parquet."""
    folder = shared_dir(spark, "unreadable")
    table(spark, sf_dir, "orders").repartition(4).write.parquet(folder)
    for name, text in (("broken", "PAR1 no footer"), ("short", "PA")):
        made = shared_dir(spark, "not-parquet")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(made)
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        part = next(f.getPath() for f in fs.listStatus(path(made)) if f.getPath().getName().startswith("part-"))
        fs.rename(part, path(f"{folder}/{name}.parquet"))
    good = readers.readable_parquet(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))
    bad = readers.unreadable_files(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("key_sum"))
    return good.select(F.lit("read").alias("part"), "*").unionByName(bad.select(F.lit("set aside").alias("part"), "*"))


column_rule("rule_string_strict", "column.type", "validity", "orders", "o_orderkey", "o_totalprice",
            {"type": "string", "strict_type": True}, "o_totalprice IS NOT NULL")


@query("rule_absent_column", """
    SELECT 'schema.required_column' AS rule_id, 'critical' AS severity, 'schema' AS category, 'gone' AS "column",
           CAST(0 AS BIGINT) AS affected_rows, '' AS sample_rows FROM (SELECT count(*) FROM orders)""")
def rule_absent_column(spark, sf_dir):
    """Rules on a column that is not there count nothing; its absence is the finding."""
    contract = contract_of("orders", {"gone": {"nullable": False, "minimum": 1, "pattern": "x"}, "o_orderkey": {"nullable": False}})
    return compact(validate(table(spark, sf_dir, "orders"), contract, row_key="o_orderkey").findings)


@query("src_json_document", """
    SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY 1""")
def src_json_document(spark, sf_dir):
    """Files that each hold one array of objects, read by their suffix."""
    folder = shared_dir(spark, "documents") + ".json"
    rows = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 5000).alias("part")).agg(
        F.to_json(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("value"))  # a file of at most 5000 rows each
    rows.repartition("part").select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(folder)
    read = readers.read_dataset(spark, folder, schema="o_orderkey bigint, o_orderstatus string")
    return read.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


def _mentions_sql(source: str) -> str:
    spans = " UNION ALL ".join(f"""
        SELECT id, '{c}' AS category, {rank} AS rank, v, ahead + coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) AS start
        FROM (SELECT id, gaps, unnest(found) AS v, generate_subscripts(found, 1) AS i,
                     unnest(list_transform(range(1, len(found) + 1), lambda k: coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0))) AS ahead
              FROM (SELECT id, regexp_extract_all(text, '{p}') AS found, regexp_split_to_array(text, '{p}') AS gaps FROM ({source}))
              WHERE len(found) > 0)
        WHERE {test_sql(c, 'v')}""" for rank, (c, p) in enumerate(mentions.CANDIDATES.items()))
    return f"""
        WITH spans AS (SELECT id, category, rank, length(v) AS n, start, start + length(v) AS stop FROM ({spans})),
        opened AS (SELECT *, coalesce(start >= max(stop) OVER (PARTITION BY id ORDER BY start, stop DESC, rank
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM spans),
        placed AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY id ORDER BY start, stop DESC, rank ROWS UNBOUNDED PRECEDING) AS place FROM opened)
        SELECT id, CAST(min(start) AS BIGINT) AS "start", CAST(max(stop) AS BIGINT) AS "end",
               arg_max(category, n * 10 - rank) AS category, CAST(count(*) AS BIGINT) AS "values" FROM placed GROUP BY id, place"""


_TEXTS = "SELECT 'document-' || doc_id AS id, text FROM documents UNION ALL SELECT 'page-' || page_id, html FROM pages"


@query("pii_text_mentions", _mentions_sql(_TEXTS))
def pii_text_mentions(spark, sf_dir):
    """Personal data inside the texts of documents and pages."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    return mentions.mentions(docs.unionByName(pages), "id", "text")
