"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.session import shared_dir


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """The rows of ``df``, written once below the cluster's shared folder and read again.

    Cuts lineage: a lost executor costs no recomputation of what is stored, and plans that
    read it twice do not run it twice. The schema is given, so an empty table reads back too.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand at most ``rows`` rows at once to Python: for rows that are whole texts."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, rows)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def text_of(column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def ids_and_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under its own names: others cannot clash."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text",
                  limit: int = 8 << 20, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (or list elements) and at most ``rows``;
    a longer row is one alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        measure = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        lengths = np.asarray(measure(values).fill_null(0))
        part = np.cumsum(lengths, dtype=np.int64) // limit + np.arange(len(lengths)) // rows
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def lists_of(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of longs without nulls, as views."""
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def packed_rows(batch: pa.RecordBatch) -> bytes:
    """A batch with all its columns as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked_rows(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
