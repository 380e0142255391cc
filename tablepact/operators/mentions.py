"""Personal data inside running text: spans with offsets, and redaction by them.

For each category a broad pattern finds candidates, and the whole-cell test of the category decides on each of them. Where
candidates stand follows from the lengths of the matches and of the text between them. Spans of different categories
may overlap (a card number also looks like a phone number): a sweep over each text's spans joins what overlaps and names it
by its longest span. All of it is built-in expressions; only candidates are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.functions.coercion import named
from tablepact.operators.pii import value_detectors

#: Candidates per category: maximal runs of what a value is made of. On equal lengths the earlier category names a span.
CANDIDATES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip_address": r"[0-9]+(?:\.[0-9]+)+",
    "government_id": r"[0-9]+(?:-[0-9]+)+",
    "payment_card": r"[0-9]+(?:[ -][0-9]+)*",
    "phone": r"\+?[0-9(][0-9 ().-]*[0-9]",
}


def _places(text: Column, category: str, rank: int) -> Column:
    """Per match: category, rank, its number, the length of the text before it (after the last match) and the match."""
    pattern = CANDIDATES[category]
    found, between = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    return F.transform(found, lambda m, i: F.struct(
        F.lit(category).alias("category"), F.lit(rank).alias("rank"), i.alias("nth"), F.length(F.get(between, i)).alias("gap"), m.alias("value")))


def mentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, start, end (code points, end exclusive), category, values (spans joined here): one row per place.

    Rows equal in id and text count as one; rows that share an id only are told apart by their texts.
    """
    text = named(text_col)
    every = F.concat(*[_places(text, c, rank) for rank, c in enumerate(CANDIDATES)])
    rows = df.where(text.isNotNull()).select(named(id_col).alias("id"), F.xxhash64(text).alias("_mark"), F.explode(every).alias("m"))
    rows = rows.select("id", "_mark", "m.*").dropDuplicates(["id", "_mark", "category", "nth"])
    of_text = ["id", "_mark"]
    ends = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy(*of_text, "category").orderBy("nth"))
    tests = value_detectors(F.col("value"))
    fits = F.lit(False)
    for category in CANDIDATES:
        fits = F.when(F.col("category") == category, tests[category]).otherwise(fits)
    spans = rows.withColumn("end", ends).withColumn("start", F.col("end") - F.length("value")).where(fits)
    # the sweep: a span that starts where all before it have ended begins a new place
    order = Window.partitionBy(*of_text).orderBy("start", F.desc("end"), "rank")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    placed = opened.withColumn("_place", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    longest = F.max_by("category", F.struct(F.length("value"), -F.col("rank")))
    return placed.groupBy(*of_text, "_place").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), longest.alias("category"), F.count(F.lit(1)).alias("values")).select(
        "id", "start", "end", "category", "values")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, category; sorted, not overlapping) replaced by its category in brackets."""
    last = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    parts = F.transform(spans, lambda s, i: F.concat(
        F.substring(text, last(i).cast("int") + 1, (s["start"] - last(i)).cast("int")), F.lit("["), F.upper(s["category"]), F.lit("]")))
    return F.concat(F.array_join(parts, ""), F.substring(text, last(F.size(spans)).cast("int") + 1, F.length(text)))


def redact_mentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with the mentions of its texts masked; ids must be unique. Texts meet their spans by id, not the other way round."""
    spans = mentions(df, id_col, text_col).groupBy(F.col("id").alias("_id")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "category"))).alias("_spans"))
    met = df.join(spans, named(id_col).eqNullSafe(F.col("_id")), "left")
    masked = F.when(F.col("_spans").isNull(), named(text_col)).otherwise(redacted(named(text_col), F.col("_spans")))
    return met.select(*[masked.alias(c) if c == text_col else named(c) for c in df.columns])
