"""Merkle fingerprints of documents: sentences, paragraphs, sections, root.

A fingerprint is the whole tree in one string: the root, then per section its node and in
brackets its paragraphs, each with its node and the leaves of its sentences. Roots test
equality; where they differ, comparing nodes from the top shows the sections and paragraphs
that were edited; the share of common leaves is the likeness of two fingerprints. Everything
is built-in expressions. Nodes are SHA-256 all the way up; the string shows the first ``SHOWN_DIGITS`` digits of those below the root.

``with_next`` sets every document beside its successor in ascending doc_id, without one task
seeing all rows: ranges of doc_id between sampled values (percentiles of all ids) are windows
of their own, and the row on a bound also stands at the end of the range before.

Defined results: a null text counts as empty, an empty text is one empty leaf; texts of any
length are read whole; null doc_ids come first, equal ones are ordered by text digest; the
only row follows itself; an empty table gives an empty result; other columns are ignored.
doc_id is a number, a date or a string (in the order of its bytes).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.common import ids_and_texts, partitions

SHOWN_DIGITS = 12
SENTENCE_ENDS = (". ", "! ", "? ")
CUT, ESCAPE = "\x01", "\x02"
PLACE_BYTES = 6  # of a string id after what all ids begin with; decides the ranges only


def _node(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _shown(node: Column) -> Column:
    return F.substring(node, 1, SHOWN_DIGITS)


def tree(text: Column) -> Column:
    """Leaves by section, paragraph and sentence. A text's own control characters are escaped, so none can pass for a cut."""
    text = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(CUT), F.lit(ESCAPE + "a"))
    for end in SENTENCE_ENDS:
        text = F.replace(text, F.lit(end), F.lit(end[0] + CUT))
    return F.transform(F.split(text, "\n\n"), lambda section: F.transform(
        F.split(section, "\n"), lambda paragraph: F.transform(F.split(paragraph, CUT), _node)))


def leaves(of: Column) -> Column:
    return F.flatten(F.flatten(of))


def fingerprint(of: Column) -> Column:
    """The string of a tree."""
    def paragraph(p: Column) -> Column:
        return F.concat(_shown(_node(F.array_join(p, ""))), F.lit("("), F.array_join(F.transform(p, _shown), "."), F.lit(")"))

    def section_node(s: Column) -> Column:
        return _node(F.array_join(F.transform(s, lambda p: _node(F.array_join(p, ""))), ""))

    root = F.sha2(F.array_join(F.transform(of, section_node), ""), 256)
    sections = F.transform(of, lambda s: F.concat(
        _shown(section_node(s)), F.lit("["), F.array_join(F.transform(s, paragraph), ","), F.lit("]")))
    return F.concat(root, F.lit("|"), F.array_join(sections, "|"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the leaves of either tree that both have."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def root(print_: Column) -> Column:
    return F.substring_index(print_, "|", 1)


def differing(a: Column, b: Column) -> Column:
    """Sections and paragraphs of fingerprint ``a`` (numbered from 0) whose node ``b`` does not have there."""
    def sections(p: Column) -> Column:
        return F.slice(F.split(p, "\\|"), F.lit(2), F.size(F.split(p, "\\|")))

    def paragraphs(s: Column) -> Column:
        return F.split(F.regexp_extract(s, "\\[(.*)\\]", 1), ",")

    changed = F.filter(
        F.transform(sections(a), lambda s, i: F.struct(i.alias("section"), s.alias("own"), F.get(sections(b), i).alias("other"))),
        lambda x: ~x["own"].eqNullSafe(x["other"]))
    found = F.flatten(F.transform(changed, lambda x: F.filter(
        F.transform(paragraphs(x["own"]), lambda p, k: F.struct(
            x["section"].alias("section"), k.alias("paragraph"),
            (~p.eqNullSafe(F.get(paragraphs(F.coalesce(x["other"], F.lit("[]"))), k))).alias("edited"))),
        lambda p: p["edited"])))
    return F.when(root(a) == root(b), F.array().cast(
        "array<struct<section:int,paragraph:int,edited:boolean>>")).otherwise(found)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the following document, of the first one after the last."""
    ranges = 4 * partitions(docs.sparkSession)
    shares = [k / ranges for k in range(1, ranges)]
    # percentiles are doubles: ids are placed by numbers in their order that doubles hold exactly; several ids may share one
    place, of = F.col("doc_id"), docs.schema["doc_id"].dataType.simpleString()
    if of in ("string", "bigint"):
        ends = [x for x in docs.agg(F.min("doc_id"), F.max("doc_id")).first() if x is not None]
    if of == "string":
        digits = F.hex(F.substring(F.encode("doc_id", "utf-8"), len(os.path.commonprefix([x.encode() for x in ends])) + 1, PLACE_BYTES))
        place = F.conv(F.rpad(digits, 2 * PLACE_BYTES, "0"), 16, 10).cast("bigint")
    elif of == "bigint" and any(abs(x) >= 1 << 53 for x in ends):
        place = F.shiftright("doc_id", 11)
    elif of.startswith("decimal"):
        place = place.cast("double")
    docs = docs.withColumn("place", place)
    # one row: at most ``ranges`` places
    low, lowest, bounds, nulls = docs.agg(
        F.min("doc_id"), F.min("place"), F.percentile_approx("place", shares, 100 * ranges), F.max(F.col("doc_id").isNull())).first()
    bounds = sorted({b for b in bounds or [] if b > lowest})
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[k:k + width] for k in range(0, len(bounds), width)]
    kind = docs.schema["place"].dataType.simpleString()
    coarse = F.array(*[F.lit(r[0]) for r in rows]).cast(f"array<{kind}>")
    fine = F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows]).cast(f"array<array<{kind}>>")

    def reached(bounds_: Column, id_: Column) -> Column:
        return F.size(F.filter(bounds_, lambda b: b <= id_))

    # the range of an id: bounds up to it, looked up in two steps
    line = reached(coarse, F.col("place"))
    part = F.when(F.col("place").isNull() | (line == 0), 0).otherwise(
        (line - 1) * width + reached(F.get(fine, line - 1), F.col("place")))
    placed = docs.withColumn("part", part.cast("int"))
    on_bound = (F.col("part") > 0) & F.array_contains(F.get(fine, F.floor((F.col("part") - 1) / width).cast("int")), F.col("place")) \
        if bounds else F.lit(False)
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(low)
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    before = F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("guest"))
    after_all = F.struct(F.lit(len(bounds)).alias("part"), F.lit(2).alias("guest"))
    stands = F.array_compact(F.array(own, F.when(on_bound, before), F.when(first, after_all)))
    spread = placed.select("doc_id", "text", F.explode(stands).alias("at")).select("doc_id", "text", "at.part", "at.guest")
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.md5(F.col("text").cast("binary")))
    return spread.withColumn("next_text", F.lead("text").over(order)).filter("guest = 0").select("doc_id", "text", "next_text")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of ``df`` alone: doc_id, n_chars, fingerprint."""
    docs = ids_and_texts(df, id_col, text_col)
    made = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), tree(F.col("text")).alias("tree"))
    return made.select("doc_id", "n_chars", fingerprint(F.col("tree")).alias("fingerprint"))


def against_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses.

    The edit replaces the last quarter of the characters by as many from the start of the next document.
    """
    pairs = with_next(ids_and_texts(df, id_col, text_col))
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = pairs.select(
        "doc_id", "text", "next_text", F.length("text").cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - quarter),
                 F.substring(F.col("next_text"), F.lit(1), quarter)).alias("edited"))
    trees = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("own"),
        tree(F.col("edited")).alias("changed"), leaves(tree(F.col("next_text"))).alias("next_leaves"))
    flat = trees.select("*", leaves(F.col("own")).alias("own_leaves"), leaves(F.col("changed")).alias("changed_leaves"))
    return flat.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own_leaves"), F.col("changed_leaves")).alias("near_edited"),
        likeness(F.col("own_leaves"), F.col("next_leaves")).alias("near_next"))
