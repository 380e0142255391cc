"""Reading datasets: CSV, JSON Lines, JSON documents, Parquet and registered formats.

Text sources stay text: every CSV column is a string, so a value that is not what the
contract expects becomes a finding instead of a failed or silently nulled read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib.metadata import entry_points

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions.coercion import as_text, is_text, named

# CSV cells that count as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CORRUPT = "_corrupt_record"
ENTRY_POINT_GROUP = "tablepact.readers"

# What a shape budget can limit.
BUDGET_MEASURES = ("max_rows", "max_columns", "max_header_length", "max_field_length")


def nulls_from_tokens(df: DataFrame, tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """Text cells that spell a missing value become NULL; one projection."""
    return df.select(*[
        F.when(~named(f.name).isin(*tokens), named(f.name)).alias(f.name)
        if is_text(f.dataType) else named(f.name)
        for f in df.schema.fields
    ])


def read_csv(spark: SparkSession, path: str, *, columns: list[str] | None = None,
             na_tokens: tuple[str, ...] = NA_TOKENS, multi_line: bool = False,
             **options) -> DataFrame:
    """CSV with a header, all columns as text.

    ``columns`` picks columns by their names in the header. A folder's files must agree on
    the header: one that orders its columns otherwise is refused when it is read, never bound
    by position. ``multi_line`` is only for files with line breaks inside quotes: those cannot
    be split.
    """
    reader = spark.read.options(
        header=True, escape='"', multiLine=multi_line, mode="PERMISSIVE", enforceSchema=False, **options)
    found = reader.csv(path)
    if columns:
        absent = [c for c in columns if c not in found.columns]
        if absent:
            raise ValueError(f"'{path}' has no column {', '.join(absent)}")
        found = found.select(*[named(c) for c in columns])
    return nulls_from_tokens(found, na_tokens)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object per line; without a schema it is inferred, mixed columns become text."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_json_document(spark: SparkSession, path: str,
                       schema: T.StructType | str | None = None) -> DataFrame:
    """Files that each hold one array of objects."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_parquet(spark: SparkSession, path: str, row_position: str | None = None) -> DataFrame:
    """Parquet; ``row_position`` adds the 1-based position of each row within its file."""
    df = spark.read.parquet(path)
    if row_position is None:
        return df
    return df.select("*", (F.col("_metadata.row_index") + 1).alias(row_position))


Reader = Callable[[SparkSession, str], DataFrame]

_READERS: dict[str, Reader] = {
    ".csv": read_csv,
    ".jsonl": read_json_lines,
    ".ndjson": read_json_lines,
    ".json": read_json_document,
    ".parquet": read_parquet,
}


def register_reader(suffix: str, reader: Reader) -> None:
    """Make ``read_dataset`` use ``reader(spark, path)`` for paths with this suffix."""
    _READERS["." + suffix.lower().lstrip(".")] = reader


def discover_readers() -> list[str]:
    """Register readers that installed packages offer; a broken one is skipped."""
    found = []
    for entry in entry_points(group=ENTRY_POINT_GROUP):
        try:
            register_reader(entry.name, entry.load())
        except Exception:  # a plugin must not stop the others
            continue
        found.append(entry.name)
    return found


def read_dataset(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Read by suffix, or through any Spark data source by its format name.

    Sources written in Python join through ``spark.dataSource.register``.
    """
    if format is not None:
        return spark.read.format(format).options(**options).load(path)
    bare = path.rstrip("/").lower()
    for suffix, reader in _READERS.items():
        if bare.endswith(suffix):
            return reader(spark, path, **options)
    raise ValueError(f"no reader for '{path}': register one or name a format")


def read_with_rejects(spark: SparkSession, path: str, schema: T.StructType, format: str = "json",
                      **options) -> DataFrame:
    """Rows in the declared types plus the raw text of every record that does not fit."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.format(format).schema(full).options(
        mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options).load(path)


def reject_counts(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row: records read, records that did not fit, and cells that hold a value.

    Counting the cells makes every declared column take part: a parser skips the columns
    nobody asks for and would not notice their bad values.
    """
    filled = F.lit(0)
    for f in schema.fields:
        filled = filled + F.when(named(f.name).isNotNull(), 1).otherwise(0)
    return df.agg(F.count(F.lit(1)).alias("records"), F.count(CORRUPT).alias("corrupt_records"),
                  F.coalesce(F.sum(filled), F.lit(0)).alias("filled_cells"))


UNREADABLE = "path string, reason string"


def _parquet_faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            try:
                pq.ParquetFile(pa.BufferReader(content.as_buffer())).read()
            except Exception as exc:  # whatever a broken file brings up is its reason
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([type(exc).__name__])], names=["path", "reason"])


def unreadable_files(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """(path, reason) of the files below ``path`` that cannot be read; the others are not in the way.

    Text formats: files with a line that is not UTF-8. Parquet: one scan of no column says which files give rows; only the
    others (broken or empty) are opened whole, in tasks. Files of no bytes hold nothing and are passed over.
    """
    file = F.col("_metadata.file_path").alias("path")
    if format != "parquet":
        lines = spark.read.text(path).select(file, F.is_valid_utf8("value").alias("valid"))
        return lines.groupBy("path").agg(F.bool_and("valid").alias("valid")).where("NOT valid").select("path", F.lit("not UTF-8").alias("reason"))
    every = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    with_rows = readable_parquet(spark, path).select(file).distinct()
    suspicious = every.join(with_rows.select(F.col("path").alias("good")), F.expr("replace(path, 'file:/', 'file:///') = good OR path = good"), "left_anti")
    return suspicious.select("path", "content").mapInArrow(_parquet_faults, UNREADABLE)


def readable_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of all Parquet files that can be read."""
    reader = spark.read.option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    # without a schema every footer that can be read gives its part: the first file may be a broken one
    return (reader.option("mergeSchema", True) if schema is None else reader.schema(schema)).parquet(path)


def shape_budget(df: DataFrame, budget: dict[str, int]) -> DataFrame:
    """(measure, observed, allowed, within) for the measures that ``budget`` names; one scan."""
    unknown = sorted(set(budget) - set(BUDGET_MEASURES))
    if unknown or not budget:
        raise ValueError(f"a budget names some of {', '.join(BUDGET_MEASURES)}, not {', '.join(unknown) or 'nothing'}")
    texts = [f for f in df.schema.fields if is_text(f.dataType)]
    longest = [F.max(F.length(as_text(named(f.name), f.dataType))).cast("bigint").alias(f"t{i}")
               for i, f in enumerate(texts)]
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *longest)
    cells = [F.col(f"t{i}") for i in range(len(texts))]
    field = F.coalesce(F.greatest(*cells) if len(cells) > 1 else (cells or [F.lit(None)])[0], F.lit(0))
    measures = {
        "max_rows": F.col("rows"),
        "max_columns": F.lit(len(df.columns)).cast("bigint"),
        "max_header_length": F.lit(max((len(c) for c in df.columns), default=0)).cast("bigint"),
        "max_field_length": field.cast("bigint"),
    }
    rows = [F.struct(F.lit(m).alias("measure"), seen.alias("observed"),
                     F.lit(budget[m]).cast("bigint").alias("allowed")) for m, seen in measures.items() if m in budget]
    return totals.select(F.explode(F.array(*rows)).alias("m")).select("m.*") \
        .withColumn("within", F.col("observed") <= F.col("allowed"))
