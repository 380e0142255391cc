"""A whole contract on a stream.

Every micro-batch leaves what can be merged later: sums of all conditional counts, keys
folded to (key, count) with their smallest rows, unmatched references and example rows. Each goes to the batch's
own folder, replaced if the batch is retried, so the merged result is exact whatever
happened on the way. Merging reads those small tables, not the stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.contract import Contract
from tablepact.functions.coercion import named
from tablepact.functions.hashing import key_digest
from tablepact.operators import keys, pii, predicates, samples
from tablepact.operators.findings import SAMPLE_LIMIT, no_findings
from tablepact.operators.schema_checks import schema_findings
from tablepact.plans.scan import Scan
from tablepact.plans.validate import validate
from tablepact.streaming.checks import BATCH
from tablepact.streaming.columns import SourceColumns


class StreamValidation:
    """Runs a contract over a stream; ``findings`` merges whatever was processed so far."""

    def __init__(self, stream: DataFrame, contract: Contract | dict, folder: str, *,
                 references: dict[str, DataFrame] | None = None, row_key: str | None = None, as_of=None):
        self.contract = Contract.from_dict(contract) if isinstance(contract, dict) else contract
        self.stream, self.folder, self.row_key = stream, folder.rstrip("/"), row_key
        self.as_of, self.given = as_of, references
        self.checks = predicates.row_checks(stream.schema, self.contract, as_of)
        self.key_rules = keys.key_rules(stream, self.contract)
        self.references = [
            (name, rule, ref, keys.reference_is_small(ref, rule.reference_column))
            for name, rule in keys.reference_rules(stream, self.contract)
            for ref in [keys.reference_of(references or {}, rule)]
        ]
        self.columns = SourceColumns(stream, f"{self.folder}/checkpoint")

    def start(self, **trigger):
        """Start processing; by default everything available now, then stop."""
        return (self.stream.writeStream.foreachBatch(self._batch)
                .option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(**(trigger or {"availableNow": True})).start())

    def _scan(self, df: DataFrame) -> Scan:
        scan = Scan(df)
        scan.add_checks(self.checks, self.row_key)
        if self.contract.privacy.detect_pii:
            scan.add_pii()
        return scan

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        def write(df: DataFrame, table: str) -> None:
            df.write.mode("overwrite").parquet(f"{self.folder}/{table}/{BATCH}={batch_id}")

        self.columns.check(batch_id)
        batch.persist()  # several passes over one micro-batch, read from the source once
        try:
            scan = self._scan(batch)
            scan.run()
            for name, df in scan.results().items():
                write(df, name)
            folded = [_digested(_key_id(rule_id, column), keys.key_counts(batch, columns), "n")
                      for rule_id, column, columns, _ in self.key_rules]
            if folded:
                write(reduce(DataFrame.unionByName, folded), "keys")
            missing = [
                (name, rule, ref, keys.missing_references(batch, rule.column, ref, rule.reference_column, self.row_key, small=small))
                for name, rule, ref, small in self.references
            ]
            absent = [found.agg(F.lit(name).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
                      for name, _, _, found in missing]
            if absent:
                write(reduce(DataFrame.unionByName, absent), "absent")
            if self.row_key is not None:
                if self.key_rules:
                    rows = [self._key_rows(batch, rule_id, column, columns) for rule_id, column, columns, _ in self.key_rules]
                    write(reduce(DataFrame.unionByName, rows), "key_rows")
                parts = samples.check_samples(batch, scan.broken(), self.row_key) + [
                    keys.reference_samples(batch, rule.column, found, ref, rule.reference_column, self.row_key).select(
                        F.lit(f"dataset.reference_exists.{name}").alias("rule_id"), F.lit(rule.column).alias("column"), "sample_rows")
                    for name, rule, ref, found in missing]
                if parts:
                    write(reduce(DataFrame.unionByName, parts), "samples")
        finally:
            batch.unpersist()

    def _key_rows(self, batch: DataFrame, rule_id: str, column: str | None, columns: list[str]) -> DataFrame:
        """The smallest rows of every key: later rows may make any key a duplicate."""
        names = [f"k{i}" for i in range(len(columns))]
        rows = keys.with_keys(batch, columns, [self.row_key]).select(*names, named(self.row_key).cast("bigint").alias("_row"))
        few = samples.smallest_per_group(rows.where("_row IS NOT NULL"), names, "_row", SAMPLE_LIMIT)
        return _digested(_key_id(rule_id, column), few.select(*names, F.col("_row").alias("row")), "row")

    def _merged(self, table: str) -> DataFrame:
        return self.stream.sparkSession.read.parquet(f"{self.folder}/{table}")

    def _started(self) -> bool:
        """Whether a micro-batch has left its sums."""
        try:
            self._merged("totals_0")
        except AnalysisException as exc:
            if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return False
        return True

    def findings(self) -> DataFrame:
        """The same findings a batch validation of all rows so far would give."""
        spark = self.stream.sparkSession
        empty = spark.createDataFrame([], self.stream.schema)
        if not self._started():
            return validate(empty, self.contract, references=self.given, row_key=self.row_key, as_of=self.as_of).findings
        scan = self._scan(empty)
        summed = [_sums(self._merged(f"totals_{i}")) for i in range(scan.parts)]
        texts = _sums(self._merged("texts"), ["position", "column"]) if scan.has_texts else None
        scan.load(summed, texts)

        found = [schema_findings(empty, self.contract), scan.findings()]
        examples = []
        if self.row_key is not None and (scan.broken() or self.references):
            examples.append(self._merged("samples").select("rule_id", "column", F.explode("sample_rows").alias("row")))
        if self.key_rules:
            per_key = self._merged("keys").groupBy("rule_id", "key").agg(F.sum("n").alias("n")).where("n > 1")
            affected = per_key.groupBy("rule_id").agg(F.sum("n").alias("affected"))
            for rule_id, column, _, texts_of in self.key_rules:
                one = affected.where(F.col("rule_id") == _key_id(rule_id, column)).select("affected")
                found.append(keys.count_findings(one, rule_id=rule_id, column=column, **texts_of))
                if self.row_key is not None:
                    same = F.col("rule_id") == _key_id(rule_id, column)
                    rows = self._merged("key_rows").where(same).join(per_key.where(same).select("key"), "key", "left_semi")
                    examples.append(rows.select(F.lit(rule_id).alias("rule_id"), F.lit(column).cast("string").alias("column"), "row"))
        for name, rule, _, _ in self.references:
            one = self._merged("absent").where(F.col("rule") == name).agg(F.sum("n").alias("affected"))
            found.append(keys.count_findings(one, **keys.reference_texts(name, rule)))
        if self.contract.privacy.detect_pii:
            found.append(pii.privacy_findings(scan.signals(), self.contract))
        found = [f for f in found if f is not None]
        merged = reduce(DataFrame.unionByName, found) if found else no_findings(self.stream)
        if not examples:
            return merged
        rows = reduce(DataFrame.unionByName, examples)
        return samples.attach_samples(merged, samples.sample_rows(rows, "row", limit=SAMPLE_LIMIT))


def _key_id(rule_id: str, column: str | None) -> str:
    return f"{rule_id}:{column or ''}"


def _digested(key_id: str, keyed: DataFrame, value: str) -> DataFrame:
    """(rule_id, key, value), keys by their digest."""
    parts = [F.col(c).cast("string") for c in keyed.columns if c != value]
    return keyed.select(F.lit(key_id).alias("rule_id"), key_digest(*parts).alias("key"), value)


def _sums(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and first row keys over all batches."""
    counts = [c for c in df.columns if c not in (BATCH, *(by or []))]
    merge = {True: F.min, False: F.sum}  # first row keys take the smallest, counts add up
    return df.groupBy(*(by or [])).agg(*[
        merge[c.startswith("first")](F.col(f"`{c}`")).alias(c) for c in counts])
