"""Uniqueness across micro-batches with the state store as the only store.

A streaming count per key digest keeps one row per key in RocksDB, below the query's checkpoint. Nothing else is
written: the counts are read back with the ``statestore`` source once the query has stopped. A restart goes on from the same
checkpoint. Only the last few versions of the state are retained (Spark's maintenance deletes the others), so the folder
follows the number of keys, not of micro-batches.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablepact.functions.hashing import key_digest
from tablepact.operators.keys import with_keys
from tablepact.streaming.checks import state_on_disk

VERSIONS = 2


@contextmanager
def _few_versions(spark: SparkSession):
    settings = {"spark.sql.streaming.minBatchesToRetain": str(VERSIONS),
                "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def count_keys(stream: DataFrame, columns: list[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Start counting the keys of a stream into its state; by default everything available now."""
    spark = stream.sparkSession
    names = [f"k{i}" for i in range(len(columns))]
    digests = with_keys(stream, columns).select(key_digest(*[F.col(n).cast("string") for n in names]).alias("key"))
    counts = digests.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    with state_on_disk(spark), _few_versions(spark):
        return (counts.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())


def keys_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key (a digest), n of the last finished micro-batch, read where the state lies."""
    with state_on_disk(spark):
        held = spark.read.format("statestore").load(checkpoint)
    value = held.schema["value"].dataType.names[0]
    return held.select(F.col("key.key").alias("key"), F.col(f"value.`{value}`").alias("n"))


def duplicates_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row: keys that stand more than once, and the rows that share one."""
    several = keys_in_state(spark, checkpoint).where("n > 1")
    return several.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("affected"))
