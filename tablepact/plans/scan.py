"""One pass over a dataset for everything that needs no shuffle of rows.

Row rules, personal-data tests and column statistics are all aggregates. Those of typed
columns and all row rules share one row of totals; the cells of text columns go through
one common set of tests, grouped by column. Both results are as large as the contract,
never as the data: they come back to the driver once, and findings, signals and profile
are read off them without another scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.functions.local import taken
from tablepact.operators import pii, profile
from tablepact.operators.findings import finding_rows
from tablepact.operators.predicates import RowCheck, check_finding, check_total

AGGREGATES_PER_PASS = 200  # wider contracts are split; columnar sources are still read once


class Scan:
    """Aggregates to take and the rows to read off them."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._parts: list[tuple[list[Column], dict[str, list]]] = []
        self._totals: list[tuple[dict, DataFrame, dict[str, list]]] = []
        self._checks: list[RowCheck] = []
        self._texts: dict[int, str] = {}
        self._text_aggregates: list[Column] = []
        self._text_rows: DataFrame | None = None
        self._with_pii = self._with_statistics = False

    def _add(self, kind: str, aggregates: list[Column], row: Column | str) -> None:
        if not self._parts or len(self._parts[-1][0]) + len(aggregates) > AGGREGATES_PER_PASS:
            self._parts.append(([], {}))
        wanted, rows = self._parts[-1]
        wanted.extend(aggregates)
        rows.setdefault(kind, []).append(row)

    def add_checks(self, checks: list[RowCheck], row_key: str | None = None) -> None:
        self._checks = checks
        for i, check in enumerate(checks):
            self._add("finding", check_total(check, i, row_key), check_finding(check, i))

    def add_pii(self) -> None:
        self._with_pii = True
        texts = pii.text_like_columns(self.df)
        self._texts.update(texts)
        self._text_aggregates += pii.text_hit_aggregates()
        for i, f in enumerate(self.df.schema.fields):
            if i not in texts:
                self._add("pii", *pii.column_hits(i, f))

    def add_statistics(self, approx_distinct: bool) -> None:
        self._with_statistics = True
        texts = profile.text_columns(self.df)
        self._texts.update(texts)
        self._text_aggregates += profile.text_profile_aggregates(approx_distinct)
        for i, f in enumerate(self.df.schema.fields):
            if i not in texts:
                self._add("stat", *profile.column_summary(i, f, approx_distinct))

    def run(self, also: list[DataFrame] | None = None) -> list[DataFrame]:
        """One job for the totals, one for the text cells, run side by side.

        ``also`` are further contract-sized results to take at the same time.
        """
        return self.load(
            [self.df.agg(F.count(F.lit(1)).alias("total"), *aggregates) for aggregates, _ in self._parts],
            profile.text_totals(self.df, self._texts, self._text_aggregates) if self._texts else None, also)

    def load(self, totals: list[DataFrame], texts: DataFrame | None,
             also: list[DataFrame] | None = None) -> list[DataFrame]:
        """Take results computed elsewhere, such as the sums over many batches."""
        local = taken([*totals, *([texts] if texts is not None else []), *(also or [])])
        for found, (_, rows) in zip(local, self._parts):
            self._totals.append((found.first().asDict(), found, rows))
        rest = local[len(totals):]
        if texts is not None:
            self._text_rows = rest.pop(0)
        return rest

    def results(self) -> dict[str, DataFrame]:
        """The raw results by name. Counts of disjoint batches add up to those of their union."""
        named = {f"totals_{i}": local for i, (_, local, _) in enumerate(self._totals)}
        return named if self._text_rows is None else {**named, "texts": self._text_rows}

    @property
    def parts(self) -> int:
        return len(self._parts)

    @property
    def has_texts(self) -> bool:
        return bool(self._texts)

    def count(self, name: str) -> int:
        """An aggregate by its alias; 0 if it was not taken."""
        return next((row[name] for row, _, _ in self._totals if name in row), 0)

    def broken(self) -> list[RowCheck]:
        """The row checks that were violated."""
        return [c for i, c in enumerate(self._checks) if self.count(f"n{i}")]

    def _rows(self, kind: str) -> list[DataFrame]:
        return [
            local.select(F.explode(F.array_compact(F.array(*rows[kind]))).alias("r")).select("r.*")
            for _, local, rows in self._totals if kind in rows
        ]

    def findings(self) -> DataFrame | None:
        parts = [finding_rows(local, *rows["finding"]) for _, local, rows in self._totals if "finding" in rows]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def signals(self) -> DataFrame | None:
        parts = self._rows("pii")
        if self._with_pii and self._text_rows is not None:
            texts = list(pii.text_like_columns(self.df))
            parts.append(pii.text_counts(self._text_rows.where(F.col("position").isin(*texts))))
        return pii.signals_of_counts(reduce(DataFrame.unionByName, parts)) if parts else None

    def statistics(self) -> DataFrame | None:
        parts = self._rows("stat")
        if self._with_statistics and self._text_rows is not None:
            texts = list(profile.text_columns(self.df))
            parts.append(profile.text_statistics(self._text_rows.where(F.col("position").isin(*texts))))
        return reduce(DataFrame.unionByName, parts) if parts else None
