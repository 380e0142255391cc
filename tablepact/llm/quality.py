"""Quality rules: a table of thresholds compiled into one Spark projection.

Every signal is a built-in expression over the words and lines of one text: no shuffle and
no user function. The rules are data (``THRESHOLDS``): a numerator, a denominator and
bounds in hundredths, compared in whole numbers, so results do not depend on rounding.

Stop words are those of ``LISTED`` languages. Where the table has a language column, documents of
any other language pass the rule on stop words; documents without a language, and tables without
such a column, are judged by all lists.

Defined results: a null text counts as empty (no words, base rule failed, not kept); texts
of any length are read whole; repeated rows are judged alike, each on its own; an empty
table gives an empty result; other columns, also of clashing names, pass through
``keep_good`` untouched and are ignored by ``quality``.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import text_of

# White space between words, symbols, common words of four languages.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to a in is that for it was on with be as by are this at from or an not have "
    "de la le et les des en un une du que est pour qui dans par pas au sur avec il ce "
    "der die und den von zu das mit auf sich für ist im dem nicht ein eine als es "
    "el y los se del las por no con su para al lo como más"
).split()
LISTED = ("en", "fr", "de", "es")

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30


class Threshold(NamedTuple):
    """``low * denominator <= 100 * numerator <= high * denominator``; None: unbounded."""

    name: str
    numerator: str
    denominator: str
    low: int | None
    high: int | None


THRESHOLDS = (
    Threshold("mean word length", "word_chars", "n_words", 200, 1200),
    Threshold("symbols per word", "n_symbols", "n_words", None, 10),
    Threshold("stop words per word", "n_stop_words", "n_words", 2, None),
    Threshold("repeated lines", "n_dup_lines", "n_lines", None, 30),
    Threshold("lines ending in an ellipsis", "n_ellipsis_lines", "n_lines", None, 30),
    Threshold("bullet lines", "n_bullet_lines", "n_lines", None, 90),
)


def compiled(thresholds: Iterable[Threshold], unlisted: Column | None = None) -> Column:
    """One boolean expression for the whole table; rules on stop words hold where ``unlisted`` does."""
    verdict = F.lit(True)
    for rule in thresholds:
        share, base = F.lit(100) * F.col(rule.numerator), F.col(rule.denominator)
        passes = F.lit(True)
        if rule.low is not None:
            passes = passes & (share >= F.lit(rule.low) * base)
        if rule.high is not None:
            passes = passes & (share <= F.lit(rule.high) * base)
        if unlisted is not None and rule.numerator == "n_stop_words":
            passes = unlisted | passes
        verdict = verdict & passes
    return verdict


def _count(array: Column) -> Column:
    return F.size(array).cast("long")


def with_signals(df: DataFrame, text: Column) -> DataFrame:
    """``row`` (all columns of ``df``) and the signals of ``text`` beside it.

    Each step names arrays that later steps read more than once, so they are computed once
    per row: words and lines, word hashes, 8-word window hashes, repeated window positions.
    """
    row = df.select(F.struct("*").alias("row"), text.alias("t"))
    split = row.select(
        "row", "t",
        F.array_remove(F.split("t", BLANK_RUN), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0).alias("lines"))
    hashed = split.select(
        "row", "lines", _count(F.col("words")).alias("n_words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _count(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    windows = hashed.select(
        "row", "n_words", "word_chars", "n_symbols", "n_stop_words", _count(F.col("lines")).alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _count(F.filter("lines", lambda x: F.endswith(F.rtrim(x), F.lit("...")) | F.endswith(F.rtrim(x), F.lit("…"))))
        .alias("n_ellipsis_lines"),
        _count(F.filter("lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).alias("n_bullet_lines"),
        F.when(F.size("codes") >= WINDOW,
               F.transform(F.sequence(F.lit(0), F.size("codes") - WINDOW),
                           lambda i: F.xxhash64(*[F.get("codes", i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("windows"))
    base = [c for c in windows.columns if c != "windows"]
    # only texts in which some window repeats pay for sorting
    ordered = windows.select(
        *base,
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"),
               F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .alias("ordered"))
    repeated = ordered.select(
        *base,
        F.sort_array(F.transform(
            F.filter("ordered", lambda x, k: (F.get("ordered", k - 1)["h"] == x["h"])
                     | (F.get("ordered", k + 1)["h"] == x["h"])),
            lambda x: x["i"])).alias("starts"))
    covered = F.aggregate(
        F.transform("starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    return repeated.select(*base, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def _unlisted(df: DataFrame, lang_col: str) -> Column | None:
    """Whether a row of ``df`` is of a language without stop words; regions (``en-GB``, ``pt_BR``) do not count."""
    if lang_col not in df.columns or df.schema[lang_col].dataType.typeName() != "string":
        return None
    language = F.lower(F.substring_index(F.translate(F.trim(F.col("row")[lang_col]), "_", "-"), "-", 1))
    return F.coalesce((language != "") & ~language.isin(*LISTED), F.lit(False))


def judged(signals: DataFrame, thresholds: Iterable[Threshold] = THRESHOLDS, unlisted: Column | None = None) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    with_base = signals.withColumn("base_failed", failed)
    return with_base.withColumn("kept", ~F.col("base_failed") & compiled(thresholds, unlisted))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            thresholds: Iterable[Threshold] = THRESHOLDS, lang_col: str = "lang") -> DataFrame:
    """Signals and verdict per row of ``df``, in whatever order Spark reads them."""
    language = [F.col(f"`{lang_col}`")] if lang_col in df.columns else []
    narrow = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("t"), *language)
    made = judged(with_signals(narrow, F.col("t")), thresholds, _unlisted(narrow, lang_col))
    return made.select("row.doc_id", *[c for c in made.columns if c != "row"])


def keep_good(df: DataFrame, text_col: str = "text", thresholds: Iterable[Threshold] = THRESHOLDS,
              lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` whose text is kept, with all their columns."""
    # the optimizer would move the filter below the steps above, writing each array out wherever it is
    # used; a condition on a row number, which is never negative, keeps it here
    made = judged(with_signals(df, text_of(text_col)), thresholds, _unlisted(df, lang_col)).withColumn("nth", F.monotonically_increasing_id())
    return made.filter(F.col("kept") & (F.col("nth") >= 0)).select("row.*")
