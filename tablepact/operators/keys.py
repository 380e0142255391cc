"""Key rules: uniqueness, composite uniqueness and membership in a reference table.

All of them work on pre-aggregated keys: each task first folds its rows into
(key, count), so a key that owns a third of the table is one small row per task when
it reaches the shuffle. Whole rows are never shuffled to count duplicates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import Contract, ContractError, DatasetRule
from tablepact.functions.coercion import NUMERIC_TEXT, as_text, is_number, is_text, missing, named, strip
from tablepact.functions.hashing import compact_key
from tablepact.functions.sizing import BROADCAST_BYTES, fits_broadcast
from tablepact.operators.findings import SAMPLE_LIMIT, finding_rows, finding_sql


def _key_value(df: DataFrame, column: str) -> Column:
    """A grouping value: text is compacted, nested values go by their JSON, NaN is NULL."""
    dtype, col = df.schema[column].dataType, named(column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(col, F.lit(None).cast(dtype))
    if is_text(dtype) or isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return compact_key(as_text(col, dtype))
    return col


def with_keys(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows as k0..kn (plus kept columns); rows whose whole key is missing have no key."""
    filled = reduce(lambda a, b: a | b, [~missing(named(c), df.schema[c].dataType) for c in columns])
    keys = [_key_value(df, c).alias(f"k{i}") for i, c in enumerate(columns)]
    return df.where(filled).select(*[named(k) for k in (keep or [])], *keys)


def key_counts(df: DataFrame, columns: list[str], row_key: str | None = None) -> DataFrame:
    """(k0..kn, n) and, with a row key, the smallest row of each group."""
    names = [f"k{i}" for i in range(len(columns))]
    row = None if row_key is None else named(row_key).cast("bigint")
    return with_keys(df, columns, [row_key] if row_key else None).groupBy(*names).agg(*_group_counts(row))


def _group_counts(row: Column | None) -> list[Column]:
    """n and, with row keys, first_row.

    n then also reads first_row (adding nothing): counts and examples keep the very same
    aggregate, so Spark shuffles the keys once and reuses that exchange for both.
    """
    n = F.count(F.lit(1))
    if row is None:
        return [n.alias("n")]
    zero = F.lit(0).cast("bigint")
    return [(n + F.coalesce(F.min(row), zero).bitwiseAND(zero)).alias("n"), F.min(row).alias("first_row")]


def duplicate_rows(df: DataFrame, columns: list[str], row_key: str | None = None) -> DataFrame:
    """One row: how many rows share their key with another row (all of them count)."""
    return key_counts(df, columns, row_key).agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("affected"))


def _smallest_rows(rows: DataFrame, names: list[str], groups: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` smallest ``_row`` over all groups, as one array.

    They lie in the ``limit`` groups whose first rows are smallest, because every earlier
    group holds an earlier row. So at most ``limit`` keys are broadcast, whatever the
    number of groups, and no row is shuffled.
    """
    first = groups.where("first_row IS NOT NULL").orderBy("first_row").limit(limit)  # others have no row to name
    first = first.select(*[F.col(n).alias(f"_g{n}") for n in names])
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_g{n}")) for n in names])
    found = rows.where("_row IS NOT NULL").join(F.broadcast(first), same, "left_semi").orderBy("_row").limit(limit)
    return found.agg(F.array_sort(F.collect_list("_row")).alias("sample_rows"))


def duplicate_samples(df: DataFrame, columns: list[str], row_key: str,
                      limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Smallest row keys among all duplicate rows, the first of each group included."""
    names = [f"k{i}" for i in range(len(columns))]
    groups = key_counts(df, columns, row_key).where("n > 1")
    rows = with_keys(df, columns, [row_key]) \
        .select(*names, named(row_key).cast("bigint").alias("_row"))
    return _smallest_rows(rows, names, groups, limit)


def missing_references(df: DataFrame, column: str, reference: DataFrame, reference_column: str,
                       row_key: str | None = None, broadcast_bytes: int = BROADCAST_BYTES,
                       small: bool | None = None) -> DataFrame:
    """(key, n and first_row) for every non-null key that the reference lacks.

    A reference measured to be small is broadcast and the rows are filtered where they
    are. Otherwise both sides are reduced to distinct keys first and meet in one
    co-partitioned anti join, which no hot key can skew. ``small`` states the outcome of
    an earlier measurement.
    """
    ref = _reference_keys(reference, reference_column)
    rows = _source_keys(df, column, ref, row_key)
    theirs = ref.schema["ref_key"].dataType
    ref = ref.select(_comparable(F.col("ref_key"), theirs, df.schema[column].dataType).alias("ref_key"))
    if small is None:
        small = fits_broadcast(ref, ["ref_key"], broadcast_bytes)
    counts = _group_counts(None if row_key is None else F.col("_row"))
    if small:
        absent = rows.join(F.broadcast(ref.distinct()), F.col("key") == F.col("ref_key"), "left_anti")
        return absent.groupBy("key").agg(*counts)
    return rows.groupBy("key").agg(*counts) \
        .join(ref.distinct(), F.col("key") == F.col("ref_key"), "left_anti")


def reference_samples(df: DataFrame, column: str, absent: DataFrame, reference: DataFrame,
                      reference_column: str, row_key: str, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Smallest row keys among the rows whose key the reference lacks."""
    rows = _source_keys(df, column, _reference_keys(reference, reference_column), row_key)
    # every group has rows; asking for n keeps the aggregate the one that was counted
    return _smallest_rows(rows, ["key"], absent.where("n > 0"), limit)


def _source_keys(df: DataFrame, column: str, ref: DataFrame, row_key: str | None) -> DataFrame:
    row = [] if row_key is None else [named(row_key).cast("bigint").alias("_row")]
    ours, theirs = df.schema[column].dataType, ref.schema["ref_key"].dataType
    return df.where(~missing(named(column), ours)).select(_comparable(named(column), ours, theirs).alias("key"), *row)


def _reference_keys(reference: DataFrame, column: str) -> DataFrame:
    if column not in reference.columns:
        raise ContractError(f"Reference column '{column}' is not present")
    dtype = reference.schema[column].dataType
    return reference.where(~missing(named(column), dtype)).select(named(column).alias("ref_key"))


def _comparable(key: Column, dtype: T.DataType, other: T.DataType) -> Column:
    """A key in a form that equals the other side's key if their values are equal.

    Whole numbers and equal types compare as they are. Numbers of different kinds, and numbers
    against text, meet as canonical text: `10`, `10.0` and `1e1` are one value, and whole
    numbers keep all their digits.
    """
    def whole(t):
        return isinstance(t, T.IntegralType)

    if dtype == other or whole(dtype) and whole(other) or not (is_number(dtype) or is_number(other)):
        return key
    if whole(dtype):
        return key.cast("string")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _number_text(as_text(key, dtype))
    return _number_text(key.cast("string"))


def _number_text(text: Column) -> Column:
    """Text of a number without blanks, sign of plus, exponent or needless zeros; other text as it is."""
    bare = strip(text)
    digits = F.when(bare.rlike(r"^[+-]?\d{1,38}(\.0*)?$"), bare.try_cast("decimal(38,0)").cast("string"))
    exact = F.regexp_replace(F.regexp_replace(bare.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(~bare.rlike(NUMERIC_TEXT), text).otherwise(F.coalesce(digits, exact, bare))


def count_findings(count: DataFrame, **texts) -> DataFrame:
    """A one-row count becomes a finding, or nothing when it is zero."""
    return finding_rows(count.where(F.col("affected") > 0), finding_sql(affected="affected", **texts))


def key_rules(df: DataFrame, contract: Contract) -> list[tuple[str, str | None, list[str], dict]]:
    """(rule_id, column, key columns, texts) of the uniqueness rules that apply."""
    found = []
    for name, rule in contract.rules.items():
        if rule.unique and name in df.columns:
            found.append(("column.unique", name, [name], dict(
                severity=rule.severity, category="uniqueness", title="Values used more than once",
                message=f"{{n}} row(s) hold a '{name}' that another row holds, too.",
                expected="each filled value in one row", observed="{n} rows with a shared value",
                remediation="Find out why several rows carry one value; keep one of them, or drop the rule.")))
    for name, rule in contract.named_dataset_rules():
        if rule.type == "unique_combination" and set(rule.columns) <= set(df.columns):
            found.append((f"dataset.unique_combination.{name}", None, list(rule.columns), dict(
                severity=rule.severity, category="uniqueness", title="Composite key used more than once",
                message=f"{{n}} row(s) share their combination of {len(rule.columns)} columns.",
                expected="one row for each composite key", observed="{n} rows with a shared key",
                remediation="Check what loads these rows twice, or add the column that tells them apart.")))
    return found


def reference_rules(df: DataFrame, contract: Contract) -> list[tuple[str, object]]:
    return [
        (name, rule) for name, rule in contract.named_dataset_rules()
        if rule.type == "reference_exists" and rule.column in df.columns
    ]


def reference_is_small(reference: DataFrame, column: str) -> bool:
    return fits_broadcast(_reference_keys(reference, column), ["ref_key"])


def reference_of(references: dict[str, DataFrame], rule) -> DataFrame:
    if rule.reference_dataset not in references:
        raise ContractError(f"Reference dataset '{rule.reference_dataset}' was not supplied")
    return references[rule.reference_dataset]


def found_findings(df: DataFrame, described: list[tuple], totals: list) -> list[DataFrame]:
    """Findings of key rules from their counts; ``described`` has rule_id, column and texts by the rule's number."""
    spark = df.sparkSession
    return [finding_rows(spark.createDataFrame([(r["affected"],)], "affected bigint"), finding_sql(affected="affected", **described[r["rule"]][2]))
            for r in sorted(totals, key=lambda r: r["rule"])]


def counted_findings(df: DataFrame, contract: Contract, counted: DataFrame) -> list[DataFrame]:
    """Findings of single-column uniqueness from a profile's duplicate counts."""
    return [count_findings(counted.where(F.col("column") == column).select(F.col("duplicate_count").alias("affected")),
                           rule_id=rule_id, column=column, **texts)
            for rule_id, column, _, texts in key_rules(df, contract) if column is not None]


def named_examples(examples: DataFrame, described: list[tuple]) -> DataFrame:
    """rule_id, column, sample_rows of examples that carry the rule's number."""
    names = F.array(*[F.struct(F.lit(rule_id).alias("rule_id"), F.lit(column).cast("string").alias("column")) for rule_id, column, _ in described])
    return examples.select(F.get(names, F.col("rule")).alias("r"), "sample_rows").select("r.rule_id", "r.column", "sample_rows")


def reference_texts(name: str, rule: DatasetRule) -> dict:
    return dict(
        rule_id=f"dataset.reference_exists.{name}", severity=rule.severity,
        category="referential_integrity", title="Referenced values missing", column=rule.column,
        message=f"{{n}} row(s) of '{rule.column}' are absent from "
                f"'{rule.reference_dataset}'.{rule.reference_column}.",
        expected="every non-null key exists in the reference", observed="{n} unmatched rows",
        remediation="Repair the relationship at the source.")


def group_reconciliation(header: DataFrame, key: str, amount: str, detail: DataFrame,
                         detail_key: str, detail_amount: str, tolerance: float) -> DataFrame:
    """Header amounts against the sum of their detail rows, one row per key that does not balance.

    Details without a header and headers without an amount do not balance either (unless there
    is nothing to balance: no details, or details that sum to nothing). Details are summed
    before the join, so it sees one row per key on their side.
    """
    sums = detail.groupBy(named(detail_key).alias("_key")).agg(
        F.sum(named(detail_amount)).alias("detail_total"), F.count(F.lit(1)).alias("detail_rows"))
    pairs = header.select(named(key).alias("key"), named(amount).alias("header_total")) \
        .join(sums, F.col("key") == F.col("_key"), "full_outer")
    total = F.coalesce("detail_total", F.lit(0.0))
    off = F.abs(F.coalesce("header_total", F.lit(0.0)) - total) > float(tolerance)
    return pairs.where(off).select(
        F.coalesce("key", "_key").alias("key"), "header_total", total.alias("detail_total"),
        F.coalesce("detail_rows", F.lit(0)).alias("detail_rows"))
