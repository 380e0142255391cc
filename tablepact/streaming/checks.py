"""Contract checks on unbounded inputs.

Row rules need no memory between batches, so every micro-batch is validated with the
batch operators and leaves a few finding rows. What must be remembered (keys, totals,
profiles) lives in Spark's state store as mergeable aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablepact.contract import Contract
from tablepact.functions.coercion import as_text, missing, named
from tablepact.functions.sizing import fits_broadcast
from tablepact.functions.schemas import flat_schema
from tablepact.operators import pii, predicates, profile, samples
from tablepact.operators.findings import FINDING_SCHEMA, merge_findings
from tablepact.operators.keys import missing_references, reference_is_small, with_keys
from tablepact.plans.history import PROFILE_SCHEMA
from tablepact.streaming.columns import SourceColumns, literal_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCH = "batch_id"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in RocksDB: key state outgrows executor heaps."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet",
                files_per_batch: int | None = None, **options) -> DataFrame:
    """A file or folder as a stream with a declared schema; a query stops at files with other columns."""
    reader = spark.readStream.schema(schema).format(format).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a glob, one file is taken as well as a folder of files; a name's own glob characters are literal
    bare = literal_path(path.rstrip("/"))
    return reader.load(bare if bare[-1] in "]}*?\\" else f"{bare[:-1]}[{bare[-1]}]")


def run_batches(stream: DataFrame, sink: str, checkpoint: str, each: Callable[[DataFrame], DataFrame]
                | None = None, mode: str = "append") -> StreamingQuery:
    """Start the stream; every batch is written to its own folder, replaced if retried."""
    columns = SourceColumns(stream, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        columns.check(batch_id)
        out = batch if each is None else each(batch)
        out.write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch_id}")

    return (stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def drain(stream: DataFrame, folder: str, each=None, mode: str = "append") -> str:
    """Process everything available now and return the folder of batch results."""
    run_batches(stream, f"{folder}/out", f"{folder}/checkpoint", each, mode).awaitTermination()
    return f"{folder}/out"


def batch_results(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(full).parquet(sink)


def latest_batch(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """The last complete-mode result: each batch holds the whole (small) table."""
    rows = batch_results(spark, sink, schema)
    last = rows.agg(F.max(BATCH))
    return rows.where(F.col(BATCH) == last.scalar()).drop(BATCH)


# --- row rules -------------------------------------------------------------------

def batch_findings(contract: Contract, row_key: str | None = None,
                   as_of=None) -> Callable[[DataFrame], DataFrame]:
    """What each micro-batch contributes: findings of the rules a single batch can decide."""
    def check(batch: DataFrame) -> DataFrame:
        checks = predicates.column_checks(batch.schema, contract, as_of) + [
            c for c in predicates.dataset_checks(batch.schema, contract.named_dataset_rules())
            if c.threshold is None
        ]
        found = predicates.row_findings(batch, checks)
        if row_key is not None and checks:
            decided = [c for c in checks if c.violated is not None]
            found = samples.attach_samples(found, samples.check_samples(batch, decided, row_key)[0])
        return found
    return check


def stream_row_findings(stream: DataFrame, contract: Contract, folder: str,
                        row_key: str | None = None, as_of=None) -> DataFrame:
    """Row-rule findings over everything available, merged across batches."""
    sink = drain(stream, folder, batch_findings(contract, row_key, as_of))
    return merge_findings(batch_results(stream.sparkSession, sink, FINDING_SCHEMA))


def windowed_quality(stream: DataFrame, checks: list[predicates.RowCheck], event_time: str,
                     window: str, delay: str) -> DataFrame:
    """Rule counts per event-time window; the watermark lets finished windows go."""
    timed = stream.withColumn("_at", named(event_time).cast("timestamp")).withWatermark("_at", delay)
    counts = [F.count_if(c.violated).alias(f"n{i}") for i, c in enumerate(checks)]
    per_window = timed.groupBy(F.window("_at", window)).agg(F.count(F.lit(1)).alias("total"), *counts)
    rows = [F.struct(F.lit(c.rule_id).alias("rule_id"), F.lit(c.column).cast("string").alias("column"),
                     F.col(f"n{i}").alias("affected_rows")) for i, c in enumerate(checks)]
    return per_window.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "total", F.explode(F.array(*rows)).alias("r")).select(
        "window_start", "window_end", F.col("total").alias("rows"), "r.*")


# --- keys ------------------------------------------------------------------------

def stream_duplicate_rows(stream: DataFrame, columns: list[str], folder: str) -> DataFrame:
    """Exact duplicate participants across all batches, as one row.

    A streaming count per key runs in update mode: each batch emits only the keys it
    touched. Counts never shrink, so the largest one seen per key is the final one, even
    if a batch was written twice.
    """
    names = [f"k{i}" for i in range(len(columns))]
    counts = with_keys(stream, columns).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    with state_on_disk(stream.sparkSession):
        sink = drain(counts, folder, mode="update")
    final = batch_results(stream.sparkSession, sink, counts.schema).groupBy(*names).agg(F.max("n").alias("n"))
    return final.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("affected"))


def newly_affected_rows(stream: DataFrame, columns: list[str], row_key: str) -> DataFrame:
    """A stream of the rows that became duplicates, each exactly once.

    State per key is the number of rows and the first row, whatever the number of rows;
    start it inside ``state_on_disk``.
    """
    from tablepact.streaming.processors import FirstRowState, OUTPUT

    names = [f"k{i}" for i in range(len(columns))]
    keyed = with_keys(stream, columns, [row_key]).select(
        F.sha2(F.concat_ws("|", *[F.coalesce(F.sha2(F.col(n).cast("string"), 256), F.lit("NULL"))
                                  for n in names]), 256).alias("key"),
        named(row_key).cast("bigint").alias("row"))
    return keyed.groupBy("key").transformWithState(
        statefulProcessor=FirstRowState(), outputStructType=OUTPUT, outputMode="Append",
        timeMode="None")


def unmatched_rows(stream: DataFrame, column: str, reference: DataFrame,
                   reference_column: str) -> DataFrame:
    """Stream rows whose non-null key a static reference lacks (stream-static anti join)."""
    ref = reference.select(named(reference_column).alias("_ref")).where(F.col("_ref").isNotNull()).distinct()
    if fits_broadcast(ref, ["_ref"]):
        ref = F.broadcast(ref)
    present = stream.where(~missing(named(column), stream.schema[column].dataType))
    return present.join(ref, named(column) == F.col("_ref"), "left_anti")


def stream_reference_misses(stream: DataFrame, column: str, reference: DataFrame,
                            reference_column: str, folder: str) -> DataFrame:
    """How many rows lack their reference over everything available, as one row.

    Each micro-batch is folded to (key, count) before it meets the reference, so a hot key is one row.
    """
    small = reference_is_small(reference, reference_column)

    def absent(batch: DataFrame) -> DataFrame:
        found = missing_references(batch, column, reference, reference_column, small=small)
        return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    sink = drain(stream.select(named(column)), folder, each=absent)
    done = batch_results(stream.sparkSession, sink, flat_schema("n bigint"))
    return done.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("affected"))


# --- running aggregates ----------------------------------------------------------

def running_totals(stream: DataFrame) -> DataFrame:
    """Row count and nulls per column as a streaming aggregate (one state row)."""
    fields = stream.schema.fields
    totals = stream.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(missing(named(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)])
    rows = [F.struct(F.lit(f.name).alias("column"), F.col("total").alias("row_count"),
                     F.col(f"n{i}").alias("null_count")) for i, f in enumerate(fields)]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def stream_totals(stream: DataFrame, folder: str) -> DataFrame:
    totals = running_totals(stream)
    sink = drain(totals, folder, mode="complete")
    return latest_batch(stream.sparkSession, sink, totals.schema)


def stream_profile(stream: DataFrame, folder: str) -> DataFrame:
    """Incremental profile: mergeable state per column, distinct counts approximate."""
    running = profile.column_stats(stream, approx_distinct=True)
    sink = drain(running, folder, mode="complete")
    final = latest_batch(stream.sparkSession, sink, running.schema)
    return final.withColumn("duplicate_count", F.lit(None).cast("bigint")) \
        .withColumn("distinct_count_exact", F.lit(False)) \
        .withColumn("duplicate_count_exact", F.lit(False)).select(*PROFILE_SCHEMA.names)


def stream_pii_signals(stream: DataFrame, row_key: str, limit: int, folder: str) -> DataFrame:
    """Personal-data signals from the first ``limit`` filled values of each column in row-key order, over all micro-batches.

    A micro-batch leaves which categories its first values match, never the values; the first of all micro-batches are among the
    first of each, so batch borders make no difference.
    """
    fields = {f.name: f.dataType for f in stream.schema.fields}
    fits = {c: [n for n, t in fields.items() if c in pii.possible_categories(t)] for c in pii.VALUE_CATEGORIES}
    cells = F.array_compact(F.array(*[
        F.when(~missing(named(n), t), F.struct(F.lit(n).alias("column"), as_text(named(n), t).alias("value"))) for n, t in fields.items()]))

    def first_hits(batch: DataFrame) -> DataFrame:
        rows = batch.select(named(row_key).cast("bigint").alias("_row"), F.explode(cells).alias("c")).select("_row", "c.*")
        few = samples.smallest_per_group(rows, ["column"], "_row", limit)
        hits = pii.value_detectors(F.col("value"))
        return few.select("column", "_row", *[
            (F.col("column").isin(*fits[c]) & F.coalesce(hits[c], F.lit(False)) if fits[c] else F.lit(False)).alias(c) for c in pii.VALUE_CATEGORIES])

    sink = drain(stream, folder, each=first_hits)
    schema = flat_schema(", ".join(["column string, _row bigint", *(f"{c} boolean" for c in pii.VALUE_CATEGORIES)]))
    first = samples.smallest_per_group(batch_results(stream.sparkSession, sink, schema), ["column"], "_row", limit)
    counted = first.groupBy(F.col("column").alias("_of")).agg(F.count(F.lit(1)).alias("sampled_values"), *[F.count_if(c).alias(c) for c in pii.VALUE_CATEGORIES])
    names = stream.sparkSession.createDataFrame([(n,) for n in fields], "column string")
    every = names.join(counted, F.col("column") == F.col("_of"), "left").select(
        "column", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sampled_values", *pii.VALUE_CATEGORIES)])
    return pii.signals_of_counts(every, True)


def unseen_within(stream: DataFrame, columns: list[str], event_time: str, delay: str) -> DataFrame:
    """First rows per key with bounded state: repeats are caught within the watermark only."""
    at: Column = named(event_time).cast("timestamp")
    return stream.withColumn("_at", at).withWatermark("_at", delay) \
        .dropDuplicatesWithinWatermark(columns).drop("_at")
