"""All key rules of a contract in one pass.

Every row contributes one (rule, key) per uniqueness, composite and reference rule. Tasks fold them to counts before
the one exchange, so a key that owns a third of the rows is one small row per task. Keys of references are reduced to
distinct (rule, key) and meet the folded keys in one co-partitioned join. What comes back is a row per rule with its
count and the groups that its example rows are in; one more pass over the rows names these, for all rules together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import Contract
from tablepact.functions.coercion import as_text, is_text, missing, named
from tablepact.functions.hashing import compact_key
from tablepact.operators import keys
from tablepact.operators.findings import SAMPLE_LIMIT
from tablepact.operators.samples import smallest_rows

GROUPS = "rule int, affected bigint, first_row bigint, key string"


def key_text(col: Column, dtype: T.DataType) -> Column:
    """A key as text: equal values give equal texts, different ones different texts. NULL and NaN have none."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(col + F.lit(0.0).cast(dtype), F.lit(None).cast(dtype)).cast("string")  # minus zero is zero
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col).cast("string")  # local times repeat when clocks go back
    if isinstance(dtype, T.BinaryType):
        return compact_key(F.hex(col))
    if is_text(dtype) or isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return compact_key(as_text(col, dtype))
    return col.cast("string")


def _composite(df: DataFrame, columns: list[str]) -> Column:
    """The texts of several columns, each led by its length; no key where all are missing."""
    texts = [F.when(~missing(named(c), df.schema[c].dataType), key_text(named(c), df.schema[c].dataType)) for c in columns]
    if len(texts) == 1:
        return texts[0]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit("+"), t), F.lit("-")) for t in texts]
    return F.when(F.coalesce(*texts).isNotNull(), F.concat(*parts))


class KeyScan:
    """The key rules that apply to a table, counted together. ``counted_unique``: uniqueness of single columns is known already."""

    def __init__(self, df: DataFrame, contract: Contract, references: dict[str, DataFrame] | None, row_key: str | None,
                 counted_unique: bool = False):
        self.df, self.row_key = df, row_key
        self.unique = [r for r in keys.key_rules(df, contract) if not (counted_unique and r[1] is not None)]
        self.references = [(name, rule, keys.reference_of(references or {}, rule)) for name, rule in keys.reference_rules(df, contract)]
        self._keys = [_composite(df, columns) for _, _, columns, _ in self.unique]
        self._theirs = []
        for _, rule, reference in self.references:
            ref = keys._reference_keys(reference, rule.reference_column)
            ours, theirs = df.schema[rule.column].dataType, ref.schema["ref_key"].dataType
            mine = keys._comparable(named(rule.column), ours, theirs)
            other = ref.select(keys._comparable(F.col("ref_key"), theirs, ours).alias("key"))
            self._keys.append(F.when(~missing(named(rule.column), ours), key_text(mine, df.select(mine.alias("k")).schema["k"].dataType)))
            self._theirs.append(other.select(key_text(F.col("key"), other.schema["key"].dataType).alias("key")))

    def __bool__(self) -> bool:
        return bool(self._keys)

    def _exploded(self, only: list[int] | None = None) -> DataFrame:
        """rule, key and (with a row key) _row: one scan."""
        chosen = range(len(self._keys)) if only is None else only
        marks = [F.when(self._keys[i].isNotNull(), F.struct(F.lit(i).alias("rule"), self._keys[i].alias("key"))) for i in chosen]
        row = [] if self.row_key is None else [named(self.row_key).cast("bigint").alias("_row")]
        return self.df.select(*row, F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.rule", "m.key", *(["_row"] if row else []))

    def totals(self) -> DataFrame:
        """rule, affected, firsts: per broken rule its rows, and the groups with the smallest first rows (row, key)."""
        count = [F.count(F.lit(1)).alias("n"), *([F.min("_row").alias("first_row")] if self.row_key else [])]
        folded = self._exploded().groupBy("rule", "key").agg(*count)
        first = len(self.unique)
        if self._theirs:
            present = reduce(DataFrame.unionByName, [t.select(F.lit(first + i).alias("rule"), "key") for i, t in enumerate(self._theirs)])
            present = present.where(F.col("key").isNotNull()).distinct().withColumn("present", F.lit(True))
            folded = folded.join(present, ["rule", "key"], "left")
            broken = folded.where(F.when(F.col("rule") < first, F.col("n") > 1).otherwise(F.col("present").isNull()))
        else:
            broken = folded.where("n > 1")
        if self.row_key is None:
            return broken.groupBy("rule").agg(F.sum("n").alias("affected")).withColumn("firsts", F.array().cast("array<struct<row:bigint,key:string>>"))
        some = broken.select("rule", F.col("n").alias("affected"), "first_row", "key").mapInArrow(_smallest_groups, GROUPS)
        place = F.when(F.col("first_row").isNotNull(), F.struct(F.col("first_row").alias("row"), "key"))
        return some.groupBy("rule").agg(F.sum("affected").alias("affected"),
                                        F.slice(F.array_sort(F.collect_list(place)), 1, SAMPLE_LIMIT).alias("firsts"))

    def examples(self, totals: list) -> DataFrame | None:
        """rule, sample_rows of the broken rules: the smallest rows lie in the groups whose first rows are smallest."""
        groups = [(r["rule"], g["key"]) for r in totals for g in r["firsts"]]
        if self.row_key is None or not groups:
            return None
        wanted = F.broadcast(self.df.sparkSession.createDataFrame(groups, "rule int, key string"))  # at most ten for each rule
        rows = self._exploded(sorted({rule for rule, _ in groups})).where("_row IS NOT NULL").join(wanted, ["rule", "key"], "left_semi")
        return smallest_rows(rows.select("rule", "_row"), "rule")

    def described(self) -> list[tuple[str, str | None, dict]]:
        """rule_id, column and texts by the rule's number."""
        made = [(rule_id, column, dict(rule_id=rule_id, column=column, **texts)) for rule_id, column, _, texts in self.unique]
        return made + [(f"dataset.reference_exists.{name}", rule.column, keys.reference_texts(name, rule)) for name, rule, _ in self.references]


def _smallest_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per rule of a task: a row with the sum of its groups, and its groups with the smallest first rows."""
    sums: dict[int, int] = {}
    held: dict[int, list] = {}
    for batch in batches:
        rule, n = batch.column("rule").to_numpy(), batch.column("affected").to_numpy()
        first, named_ = batch.column("first_row").fill_null(0).to_numpy(), batch.column("first_row").is_valid().to_numpy(zero_copy_only=False)
        for r in np.unique(rule).tolist():
            sums[r] = sums.get(r, 0) + int(n[rule == r].sum())
            mine = np.flatnonzero((rule == r) & named_)
            low = mine[np.argsort(first[mine], kind="stable")[:SAMPLE_LIMIT]]
            groups = zip(first[low].tolist(), batch.column("key").take(pa.array(low)).to_pylist())
            held[r] = sorted([*held.get(r, []), *groups])[:SAMPLE_LIMIT]
    made = [(r, s, None, None) for r, s in sums.items()] + [(r, 0, row, key) for r, rows in held.items() for row, key in rows]
    if made:
        columns = list(zip(*made))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                                          pa.array(columns[3], pa.string())], names=["rule", "affected", "first_row", "key"])
