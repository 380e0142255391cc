"""Personal-data signals from column names and whole-cell values, and the policy on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import Contract, Privacy
from tablepact.functions.coercion import EMAIL, as_text, missing, named, strip
from tablepact.functions.local import taken
from tablepact.functions.sqltext import Sql
from tablepact.operators.findings import finding_rows, finding_sql
from tablepact.operators.profile import text_totals

# Name patterns per category (case-insensitive, matched anywhere).
NAME_PATTERNS = {
    "email": r"(^|_)(e_?mail|email_?address)($|_)",
    "phone": r"(^|_)(phone|mobile|telephone|cell)($|_)",
    "government_id": r"(^|_)(ssn|social_?security|tax_?id|passport)($|_)",
    "payment_card": r"(^|_)(card_?number|pan|credit_?card)($|_)",
    "ip_address": r"(^|_)(ip|ip_?address)($|_)",
    "date_of_birth": r"(^|_)(dob|birth_?date|date_?of_?birth)($|_)",
    "address": r"(^|_)(street|address|postal|zip_?code)($|_)",
    "person_name": r"(^|_)(first_?name|last_?name|full_?name|surname)($|_)",
    "account_identifier": r"(^|_)(account_?id|customer_?id|member_?id)($|_)",
}
# Whole-cell patterns, card length, signal thresholds and sample size.
VALUE_CATEGORIES = ("email", "government_id", "phone", "payment_card", "ip_address")
GOVERNMENT_ID = r"\d{3}-?\d{2}-?\d{4}"
PHONE = r"\+?[\d\s().-]{10,20}"
PHONE_DIGITS = 10
CARD_DIGITS = (13, 19)
STRONG_RATIO = 0.5
SAMPLE_VALUES = 200

_V4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_H = "[0-9a-fA-F]{1,4}"
_V6 = "|".join([
    rf"(?:{_H}:){{7}}{_H}",
    rf"(?:{_H}:){{6}}{_V4}",
    *[rf"(?:{_H}:){{{n}}}(?::{_H}){{1,{7 - n}}}" for n in range(1, 7)],
    *[rf"(?:{_H}:){{{n}}}(?::{_H}){{0,{5 - n}}}:{_V4}" for n in range(1, 6)],
    rf":(?::{_H}){{1,7}}",
    rf"::(?:{_H}:){{0,5}}{_V4}",
    rf"(?:{_H}:){{1,7}}:",
    "::",
])
# the lookahead turns most other text away at its second character
IP_ADDRESS = rf"(?=[0-9a-fA-F:.]+(?:%|\z))(?:{_V4}|(?:{_V6})(?:%[^\s%/]+)?)"


def _full(value: Column, pattern: str) -> Column:
    return value.rlike(r"(?U)\A(?:" + pattern + r")\z")


def value_detectors(text: Column) -> dict[str, Column]:
    """Boolean column per category: the stripped cell as a whole looks like one.

    Cheap length checks run before the regular expressions, so long prose costs little.
    """
    v = strip(text)
    size = F.length(v)
    digits = F.regexp_replace(v, r"\D+", "")
    low, high = CARD_DIGITS
    # possessive, so counting digits in long prose stays linear and allocates nothing
    card_length = v.rlike(rf"\A\D*+(?:\d\D*+){{{low},{high}}}+\z")
    return {
        "email": v.contains("@") & _full(v, EMAIL),
        "government_id": size.between(9, 11) & _full(v, GOVERNMENT_ID),
        "phone": size.between(10, 21) & _full(v, PHONE) & (F.length(digits) >= PHONE_DIGITS),
        "payment_card": (size >= low) & card_length & F.call_function("luhn_check", digits),
        "ip_address": (v.contains(".") | v.contains(":")) & v.rlike(r"\A" + IP_ADDRESS + r"\z"),
    }


def possible_categories(dtype: T.DataType) -> tuple[str, ...]:
    """Value categories a column of this type can hold at all; the others need no test."""
    if isinstance(dtype, (T.BooleanType, T.DateType)):
        return ()
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return ("payment_card",)
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        return ("government_id", "phone", "payment_card")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return ("phone", "payment_card")
    return VALUE_CATEGORIES


def name_categories(column_name: Column) -> Column:
    """Array of the categories a column name points to."""
    hits = [F.when(column_name.rlike("(?i)" + p), F.lit(c)) for c, p in NAME_PATTERNS.items()]
    return F.array_compact(F.array(*hits))


def name_signals(columns: DataFrame, column: str = "column") -> DataFrame:
    """One row per column and category its name points to; nine patterns, one projection."""
    return columns.withColumn("category", F.explode(name_categories(named(column))))


def column_hits(i: int, f: T.StructField) -> tuple[list[Column], Column]:
    """Aggregates of one typed column's value tests, and the counts as a struct."""
    possible = possible_categories(f.dataType)
    hits = value_detectors(as_text(named(f.name), f.dataType)) if possible else {}
    aggs = [F.count_if(~missing(named(f.name), f.dataType)).alias(f"s{i}")]
    aggs += [F.count_if(hits[category]).alias(f"{category}{i}") for category in possible]
    return aggs, F.struct(
        F.lit(f.name).alias("column"), F.col(f"s{i}").alias("sampled_values"),
        *[(F.col(f"{category}{i}") if category in possible else F.lit(0).cast("bigint"))
          .alias(category) for category in VALUE_CATEGORIES])


def text_like_columns(df: DataFrame) -> dict[int, str]:
    """Columns that may hold any category: text, and nested values read as JSON."""
    return {i: f.name for i, f in enumerate(df.schema.fields)
            if possible_categories(f.dataType) == VALUE_CATEGORIES}


def text_hit_aggregates() -> list[Column]:
    return [F.count_if(hit).alias(c) for c, hit in value_detectors(F.col("value")).items()]


def text_counts(totals: DataFrame) -> DataFrame:
    """Match counts from ``text_totals``."""
    return totals.select("column", (F.col("total") - F.col("null")).alias("sampled_values"), *VALUE_CATEGORIES)


def _whole_counts(df: DataFrame) -> DataFrame:
    """(column, sampled, matches per category) over every value."""
    texts = text_like_columns(df)
    parts = [text_counts(text_totals(df, texts, text_hit_aggregates()))] if texts else []
    pairs = [column_hits(i, f) for i, f in enumerate(df.schema.fields) if i not in texts]
    if pairs:
        totals = df.agg(*[a for aggs, _ in pairs for a in aggs])
        parts.append(totals.select(F.explode(F.array(*[r for _, r in pairs])).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def sampled_counts(df: DataFrame, row_key: str | None, limit: int) -> DataFrame:
    """(column, sampled, matches per category) over the first filled values of each column.

    One small job per column, several at a time. Without a row key Spark opens one partition
    after another until it has enough filled values, wherever they begin; with one, every task
    keeps its ``limit`` first rows. Only verdicts come back, never the values.
    """
    parts = []
    for f in df.schema.fields:
        possible = possible_categories(f.dataType)
        hits = value_detectors(as_text(named(f.name), f.dataType)) if possible else {}
        filled = df.where(~missing(named(f.name), f.dataType))
        ordered = filled if row_key is None else filled.orderBy(named(row_key))
        parts.append(ordered.select(F.lit(f.name).alias("column"), *[
            (F.coalesce(hits[c], F.lit(False)) if c in possible else F.lit(False)).alias(c) for c in VALUE_CATEGORIES]).limit(limit))
    first = reduce(DataFrame.unionByName, taken(parts))
    counted = first.groupBy("column").agg(
        F.count(F.lit(1)).alias("sampled_values"), *[F.count_if(c).alias(c) for c in VALUE_CATEGORIES])
    names = F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("name")
    columns = df.sparkSession.range(0, 1, 1, 1).select(names)
    return columns.join(counted, F.col("name") == F.col("column"), "left").select(
        F.col("name").alias("column"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sampled_values", *VALUE_CATEGORIES)])


def pii_signals(df: DataFrame, row_key: str | None = None,
                sample_limit: int | None = None) -> DataFrame:
    """(column, category, confidence, ...) from names and values.

    Every value is tested in one scan unless ``sample_limit`` asks for the first values of
    each column, in ``row_key`` order or as the source yields them; ``sampled`` says which.
    """
    sampled = sample_limit is not None
    return signals_of_counts(sampled_counts(df, row_key, sample_limit) if sampled else _whole_counts(df), sampled)


def signals_of_counts(counts: DataFrame, sampled: bool = False) -> DataFrame:
    """Signals from one row of match counts per column; ``sampled`` is told with each."""
    candidates = [
        F.struct(
            F.lit(category).alias("category"),
            F.col("column").rlike("(?i)" + pattern).alias("name_signal"),
            (F.col(category) if category in VALUE_CATEGORIES else F.lit(0).cast("bigint")).alias("matching_values"))
        for category, pattern in NAME_PATTERNS.items()
    ]
    rows = counts.select("column", "sampled_values", F.explode(F.array(*candidates)).alias("c")) \
        .select("column", "sampled_values", "c.*") \
        .where(F.col("name_signal") | (F.col("matching_values") > 0))
    ratio = F.coalesce(F.try_divide("matching_values", "sampled_values"), F.lit(0.0))
    strong = ratio >= STRONG_RATIO
    confidence = (
        F.when(F.col("name_signal") & strong, "high")
        .when(F.col("name_signal") | strong, "medium").otherwise("low"))
    return rows.select(
        "column", "category", confidence.alias("confidence"), "name_signal", "sampled_values",
        "matching_values", F.round(ratio, 4).alias("match_ratio"), F.lit(sampled).alias("sampled"))


def unapproved_signals(signals: DataFrame, privacy: Privacy) -> DataFrame:
    """Signals whose category the contract does not allow."""
    allowed = list(privacy.allowed_categories)
    return signals.where(~F.col("category").isin(*allowed)) if allowed else signals


def privacy_findings(signals: DataFrame, contract: Contract) -> DataFrame:
    privacy = contract.privacy
    said = "{confidence}-confidence {kind} signal"
    return finding_rows(unapproved_signals(signals, privacy), finding_sql(
        rule_id="privacy.unapproved_pii_signal",
        severity="error" if privacy.fail_on_unapproved else privacy.severity, category="privacy",
        title="Unapproved personal-data signal", column=Sql("`column`"),
        message="Column '{name}': " + said + ".",
        expected="approved category or reviewed false positive", observed=said,
        remediation="Review the column: allow the category, mask it or drop it.",
        name="`column`", confidence="confidence", kind="category"))
