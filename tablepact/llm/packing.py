"""Best-fit packing by exact-complement hashing of lengths.

Documents become pieces of at most ``capacity`` tokens. How pieces share sequences depends on
their lengths alone, so the plan is made from the histogram of lengths (at most ``capacity``
counts, whatever the corpus): for the longest length left, the gap is looked up among single
lengths, pair sums and triple sums of available lengths; an exact combination is consumed as
often as all its counts allow. Where none is exact the longest length that fits goes in and
the smaller gap is looked up again. The plan is a short list of patterns with a multiplicity.

Pieces then find their place in parallel: the rank of a piece among those of its length falls
into one slot of one pattern, which gives its sequence and offset. Ranks are counted in salted
parts, so a length that a third of all pieces has is not one task.

Defined results: null and empty texts are one piece holding the end id; texts of any length
are cut every ``capacity`` ids; repeated rows are packed each on its own; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.common import ids_and_texts, small_batches, stored
from tablepact.llm.words import WordTokenizer

CAPACITY = 2048
END_ID = 0
SALTS = 64


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece."""
    docs = ids_and_texts(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer_path)
        for batch in small_batches(batches, limit=8 << 20):
            row, start, length, crc, ids = [], [], [], [], []
            for k, coded in enumerate(words.encode(batch.column("text"), end_id)):
                for a in range(0, len(coded), 4 * capacity):
                    part = coded[a:a + 4 * capacity]
                    row.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part)
            first = np.asarray(start, dtype=np.int64)
            out = [batch.column("doc_id").take(pa.array(row)), pa.array((first // capacity).astype(np.int32)),
                   pa.array(first), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(
                out, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.mapInArrow(cut, schema)


class Lengths:
    """How many pieces of each length are left, with bit sets to look sums up."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        self.mask = self.mirror = 0
        for length, n in counts.items():
            self.add(length, n)

    def add(self, length: int, n: int) -> None:
        before, self.left[length] = self.left[length], self.left[length] + n
        if (before > 0) != (self.left[length] > 0):
            self.mask ^= 1 << length
            self.mirror ^= 1 << (self.capacity - length)

    def longest(self, limit: int) -> int:
        """The longest length up to ``limit`` that is left, or 0."""
        return max((self.mask & ((1 << (limit + 1)) - 1)).bit_length() - 1, 0)

    def pair(self, total: int, limit: int) -> tuple[int, int] | None:
        """Two lengths that sum to ``total``, the longer one as long as can be up to ``limit``."""
        both = self.mask & (self.mirror >> (self.capacity - total)) & ((1 << (min(total, limit + 1))) - 1)
        while both:
            a = both.bit_length() - 1
            if 2 * a < total:
                return None
            if 2 * a > total or self.left[a] > 1:
                return a, total - a
            both ^= 1 << a
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap, with the counts there are."""
        if self.left[gap]:
            return (gap,)
        if found := self.pair(gap, gap):
            return found
        a = self.longest(gap - 2) if gap > 2 else 0
        while 3 * a >= gap and a:
            self.add(a, -1)
            found = self.pair(gap - a, a)
            self.add(a, 1)
            if found:
                return (a, *found)
            a = self.longest(a - 1)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths that share a sequence) and how often each is used; uses up all counts."""
    left = Lengths(counts, capacity)
    made = []
    while longest := left.longest(capacity):
        pattern, gap = [longest], capacity - longest
        left.add(longest, -1)
        while gap:
            fill = left.exact(gap) or ((best,) if (best := left.longest(gap)) else None)
            if fill is None:
                break
            for length in fill:
                left.add(length, -1)
                pattern.append(length)
                gap -= length
        need = Counter(pattern)
        times = 1 + min(left.left[length] // n for length, n in need.items())
        for length, n in need.items():
            left.add(length, -n * (times - 1))
        made.append((pattern, times))
    return made


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) per slot of a pattern."""
    rows, taken, base = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], taken[length] + times, base, offset))
            taken[length] += times
            offset += length
        base += times
    return rows


def ranked(made: DataFrame, salts: int = SALTS) -> DataFrame:
    """``made`` with the rank of each piece among those of its length, counted in salted parts."""
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # at most capacity x salts rows
    bases = salted.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (salted.withColumn("n", F.row_number().over(within) - 1)
            .join(F.broadcast(bases), ["length", "salt"])
            .withColumn("rank", F.col("base") + F.col("n")).drop("salt", "n", "base"))


def packed(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. ``made`` is read twice: store it first."""
    spark = made.sparkSession
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = spark.createDataFrame(slots(plan(counts, capacity)),
                                   "length long, first long, after long, base_id long, offset long")
    at = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after"))
    # as many rows as the plan has slots: set by the capacity, not by the corpus
    return (ranked(made).join(F.broadcast(places), "length").filter(at)
            .withColumn("sequence_id", F.col("base_id") + F.col("rank") - F.col("first"))
            .select(*made.columns, "sequence_id", "offset"))


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    made = pieces(df, tokenizer_path, id_col, text_col, capacity, end_id, with_ids)
    return packed(stored(made, "pieces", compression="zstd"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order; a group holds one sequence, so at most ``capacity`` ids."""
    return placed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
