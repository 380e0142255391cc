"""Column profiles: null, distinct and duplicate counts, bounds, mean, observed type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions import coercion as C
from tablepact.functions.hashing import compact_key
from tablepact.functions.sqltext import quoted
from tablepact.operators.samples import smallest_per_group

DATETIME_SHARE = 0.95  # fixed value: share of text values that must parse as dates
TYPE_SAMPLE = 200  # fixed value: values looked at per text column
BOOLEAN_TEXT = ("True", "False", "TRUE", "FALSE", "true", "false")  # fixed values
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
COLUMNS_PER_PASS = 60  # wider tables are profiled in several narrow scans


def long_values(df: DataFrame, keep: list[str] | None = None,
                columns: list[str] | None = None) -> DataFrame:
    """(kept columns, column, value): one row per non-null cell, values as text."""
    cells = [F.struct(F.lit("").alias("column"), F.lit(None).cast("string").alias("value"))] \
        if columns == [] else []
    for f in df.schema.fields:
        if columns is None or f.name in columns:
            col = C.named(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                col = col + F.lit(0.0)  # -0.0 and 0.0 are one value
            cells.append(F.struct(
                F.lit(f.name).alias("column"),
                F.when(~C.missing(C.named(f.name), f.dataType), C.as_text(col, f.dataType)).alias("value")))
    kept = [C.named(k) for k in keep or []]
    return df.select(*kept, F.explode(F.array(*cells)).alias("c")) \
        .select(*(keep or []), "c.column", "c.value").where(F.col("value").isNotNull())


def _value_family(dtype: T.DataType) -> T.DataType:
    """The type in which values of this type are compared and shuffled."""
    if isinstance(dtype, T.IntegralType):
        return T.LongType()
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if C.is_time(dtype) or isinstance(dtype, (T.BooleanType, T.DecimalType)):
        return dtype
    return T.StringType()


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact distinct values and rows in duplicates for all columns, one shuffle per type.

    Columns of one type share a scan: their cells are folded to (column, value, n) in
    each task before the exchange, numbers travel as numbers and long texts as digests. A
    value that fills a third of a column is one row per task.
    """
    families: dict[T.DataType, list[tuple[int, T.StructField]]] = {}
    for i, f in enumerate(df.schema.fields):
        if columns is None or f.name in columns:
            families.setdefault(_value_family(f.dataType), []).append((i, f))
    parts = []
    for family, members in families.items():
        cells = []
        for i, f in members:
            col = C.named(f.name)
            if isinstance(family, T.DoubleType):
                value = F.nanvl(col.cast("double"), F.lit(None).cast("double")) + F.lit(0.0)
            elif isinstance(family, T.StringType):
                value = compact_key(C.as_text(col, f.dataType))
            else:
                value = col.cast(family)
            cells.append(F.struct(F.lit(i).alias("position"), value.alias("value")))
        filled = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("value is not null")
        parts.append(filled.groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))
                     .groupBy("position").agg(
                         F.count(F.lit(1)).alias("distinct_count"),
                         F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_count")))
    names = F.array(*[F.lit(c) for c in df.columns])
    return reduce(DataFrame.unionByName, parts).select(
        F.get(names, F.col("position")).alias("column"), "distinct_count", "duplicate_count")


def typed_kind(dtype: T.DataType) -> str | None:
    """Observed type known from the schema; None for text, which must be looked at."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType) or (isinstance(dtype, T.DecimalType) and dtype.scale == 0):
        return "integer"
    if C.is_number(dtype):
        return "number"
    if C.is_time(dtype):
        return "datetime"
    return None if C.is_text(dtype) else "string"


def text_aggregates(v: Column, suffix: str = "") -> list[Column]:
    """What the observed type, bounds and mean of a text column are read from."""
    number = C.as_number(v, T.StringType())
    return [*_kind_counts(v, suffix), F.min(number).alias(f"min{suffix}"),
            F.max(number).alias(f"max{suffix}"), F.avg(number).alias(f"avg{suffix}")]


def _kind_counts(v: Column, suffix: str = "") -> list[Column]:
    return [
        F.count_if(v.isin(*BOOLEAN_TEXT)).alias(f"bool{suffix}"),
        F.count_if(v.rlike(INTEGER_TEXT)).alias(f"int{suffix}"),
        F.count(C.as_number(v, T.StringType())).alias(f"num{suffix}"),
        F.count(C.as_timestamp(v, T.StringType())).alias(f"time{suffix}"),
    ]


def _text_kind(filled: Column, suffix: str = "") -> tuple[Column, Column]:
    """Observed type of a text column from its counts: the narrowest that fits every value."""
    every = {k: (F.col(f"{k}{suffix}") == filled) & (filled > 0) for k in ("bool", "int", "num")}
    kind = (
        F.when(every["bool"], "boolean").when(every["int"], "integer").when(every["num"], "number")
        .when(F.col(f"time{suffix}") >= filled * DATETIME_SHARE, "datetime").otherwise("string"))
    return kind, every["num"]


def _profile_row(column: Column, position: Column, null: Column, observed: Column, distinct: Column,
                 minimum: Column, maximum: Column, mean: Column) -> Column:
    total = F.col("total")
    return F.struct(
        column.alias("column"), position.alias("_position"),
        F.when(total == null, "unknown").otherwise(observed).alias("observed_type"),
        total.alias("row_count"), null.alias("null_count"),
        F.coalesce(F.round(F.try_divide(null, total), 6), F.lit(0.0)).alias("null_ratio"),
        distinct.cast("bigint").alias("distinct_count"),
        minimum.cast("string").alias("minimum"), maximum.cast("string").alias("maximum"),
        mean.cast("double").alias("mean"))


def _text_row(column: Column, position: Column, null: Column, distinct: Column, suffix: str = "") -> Column:
    observed, numeric = _text_kind(F.col("total") - null, suffix)
    low, high = F.col(f"min{suffix}") + F.lit(0.0), F.col(f"max{suffix}") + F.lit(0.0)
    return _profile_row(column, position, null, observed, distinct, F.when(numeric, low),
                        F.when(numeric, high), F.when(numeric, F.round(F.col(f"avg{suffix}"), 6)))


def column_summary(i: int, f: T.StructField, approx: bool) -> tuple[list[Column], Column]:
    """Aggregates of one column and the struct that turns their results into a profile row."""
    col, dtype = C.named(f.name), f.dataType
    kind = typed_kind(dtype)
    null = F.col(f"null{i}")
    aggs = [F.count_if(C.missing(col, dtype)).alias(f"null{i}")]
    nothing = F.lit(None)
    distinct = nothing
    if approx:
        aggs.append(F.approx_count_distinct(C.as_text(col, dtype)).alias(f"distinct{i}"))
        distinct = F.col(f"distinct{i}")
    name, position = F.lit(f.name), F.lit(i)
    if kind is None:
        return aggs + text_aggregates(col, str(i)), _text_row(name, position, null, distinct, str(i))
    low, high, mean = nothing, nothing, nothing
    if kind in ("integer", "number", "datetime"):
        bound = C.as_number(col, dtype) + F.lit(0.0) if kind == "number" else col
        aggs += [F.min(bound).alias(f"min{i}"), F.max(bound).alias(f"max{i}")]
        low, high = F.col(f"min{i}"), F.col(f"max{i}")
    if kind in ("integer", "number"):
        aggs.append(F.avg(C.as_number(col, dtype)).alias(f"avg{i}"))
        mean = F.round(F.col(f"avg{i}"), 6)
    return aggs, _profile_row(name, position, null, F.lit(kind), distinct, low, high, mean)


def text_totals(df: DataFrame, columns: dict[int, str], aggregates: list[Column]) -> DataFrame:
    """Aggregates of ``value`` for each of the columns, one row per column.

    All cells run through one piece of generated code, grouped by column in each task:
    on wide tables that compiles and runs better than one set of expressions per column.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), C.as_text(C.named(c), types[c]).alias("value"))
        for i, c in columns.items()])).alias("c")).select("c.*")
    per_column = cells.groupBy("position").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("value").isNull()).alias("null"), *aggregates)
    # a list of column names: an empty table still has its columns
    listed = ", ".join(f"named_struct('position', {i}, 'column', {quoted(c)})" for i, c in columns.items())
    names = df.sparkSession.range(0, 1, 1, 1).select(F.expr(f"inline(array({listed}))"))
    counts = [f.name for f in per_column.schema.fields if isinstance(f.dataType, T.LongType)]
    return names.join(per_column, "position", "left").na.fill(0, counts)


def text_columns(df: DataFrame) -> dict[int, str]:
    return {i: f.name for i, f in enumerate(df.schema.fields) if C.is_text(f.dataType)}


def text_profile_aggregates(approx_distinct: bool) -> list[Column]:
    v = F.col("value")
    return text_aggregates(v) + ([F.approx_count_distinct(v).alias("distinct")] if approx_distinct else [])


def text_statistics(totals: DataFrame) -> DataFrame:
    """Profile rows from ``text_totals``."""
    distinct = F.col("distinct") if "distinct" in totals.columns else F.lit(None)
    return totals.select(
        _text_row(F.col("column"), F.col("position"), F.col("null"), distinct).alias("p")).select("p.*")


def column_stats(df: DataFrame, approx_distinct: bool = False,
                 columns: list[str] | None = None) -> DataFrame:
    """Nulls, bounds, mean and type of every column in one scan, without a row shuffle."""
    chosen = [(i, f) for i, f in enumerate(df.schema.fields) if columns is None or f.name in columns]
    parts = []
    for start in range(0, len(chosen), COLUMNS_PER_PASS):
        pairs = [column_summary(i, f, approx_distinct) for i, f in chosen[start:start + COLUMNS_PER_PASS]]
        totals = df.agg(F.count(F.lit(1)).alias("total"), *[a for aggs, _ in pairs for a in aggs])
        parts.append(totals.select(F.explode(F.array(*[r for _, r in pairs])).alias("p")).select("p.*"))
    return reduce(DataFrame.unionByName, parts)


def profile(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """One row per column. ``distinct``: 'exact' (one shuffle), 'approx' (none) or 'none'."""
    approx, texts = distinct == "approx", text_columns(df)
    typed = [c for c in df.columns if c not in texts.values()]
    parts = [column_stats(df, approx, typed)] if typed else []
    if texts:
        parts.append(text_statistics(text_totals(df, texts, text_profile_aggregates(approx))))
    return assemble(reduce(DataFrame.unionByName, parts), distinct_counts(df) if distinct == "exact" else None)


def assemble(stats: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """Profile rows from column statistics and, if counted, exact distinct values."""
    if exact is not None:
        counts = exact.select(
            F.col("column").alias("_c"), F.col("distinct_count").alias("_d"), "duplicate_count")
        stats = stats.drop("distinct_count").join(counts, F.col("column") == F.col("_c"), "left")
        stats = stats.withColumn("distinct_count", F.coalesce("_d", F.lit(0))) \
            .withColumn("duplicate_count", F.coalesce("duplicate_count", F.lit(0)))
    else:
        stats = stats.withColumn("duplicate_count", F.lit(None).cast("bigint"))
    flag = F.lit(exact is not None)
    return stats.orderBy("_position").select(
        "column", "observed_type", "row_count", "null_count", "null_ratio", "distinct_count",
        "duplicate_count", flag.alias("distinct_count_exact"), flag.alias("duplicate_count_exact"),
        "minimum", "maximum", "mean")


def sampled_types(df: DataFrame, row_key: str, limit: int = TYPE_SAMPLE) -> DataFrame:
    """Observed type of the text columns from their first ``limit`` filled values only."""
    texts = [f.name for f in df.schema.fields if C.is_text(f.dataType) and f.name != row_key]
    v = F.col("value")
    counted = first_cells(df, row_key, limit, texts).groupBy("column").agg(
        F.count(F.lit(1)).alias("sampled_values"), *_kind_counts(v))
    kind, _ = _text_kind(F.col("sampled_values"))
    return counted.select("column", kind.alias("observed_type"), "sampled_values")


def first_cells(df: DataFrame, row_key: str, limit: int, columns: list[str]) -> DataFrame:
    """(column, value): the first ``limit`` filled values of each column in ``row_key`` order.

    Every task keeps ``limit`` cells per column before the exchange.
    """
    cells = long_values(df, [row_key], columns)
    return smallest_per_group(cells, ["column"], row_key, limit).select("column", "value")


def table_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")) \
        .withColumn("column_count", F.lit(len(df.columns)).cast("bigint"))
