"""Row rules counted on the caller's own write.

``observe`` puts the conditional counts of a contract's row rules beside the rows as they pass, so
whatever the caller does with them anyway (a write, an append of a micro-batch) also counts: no scan and no
job of ours. Counts come from the tasks that finished; they are exact as long as nothing between the observed rows and the
action shuffles them (Spark may count a rerun map task twice), so observe last, right before the write.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tablepact.contract import Contract
from tablepact.operators import predicates
from tablepact.operators.findings import finding_rows, no_findings

PER_OBSERVATION = 200  # rules counted by one aggregate; wider contracts get several


class _Rules:
    """A contract's row rules as named aggregates, and findings of their values."""

    def __init__(self, df: DataFrame, contract: Contract | dict, row_key: str | None, as_of):
        contract = Contract.from_dict(contract) if isinstance(contract, dict) else contract
        self.df, checks = df, predicates.row_checks(df.schema, contract, as_of)
        self.groups = [checks[i:i + PER_OBSERVATION] for i in range(0, len(checks), PER_OBSERVATION)]
        self.aggregates = [
            [F.count(F.lit(1)).alias("total"), *(a for i, c in enumerate(group) for a in predicates.check_total(c, i, row_key))]
            for group in self.groups]

    def findings(self, totals: list[dict]) -> DataFrame:
        parts = []
        for group, aggregates, found in zip(self.groups, self.aggregates, totals):
            types = self.df.limit(0).agg(*aggregates).schema
            values = tuple(found.get(f.name, None if f.name.startswith("first") else 0) for f in types.fields)
            local = self.df.sparkSession.createDataFrame([values], types)
            parts.append(finding_rows(local, *[predicates.check_finding(c, i) for i, c in enumerate(group)]))
        return reduce(DataFrame.unionByName, parts) if parts else no_findings(self.df)


class ObservedValidation:
    """``rows`` are the rows of ``df``, to be written by the caller; ``findings()`` waits for the first action on them.

    ``first_rows()`` gives the smallest row key that breaks each rule, if a row key was named.
    """

    def __init__(self, df: DataFrame, contract: Contract | dict, *, row_key: str | None = None, as_of=None):
        self._rules = _Rules(df, contract, row_key, as_of)
        self._observations, self.rows = [], df
        for aggregates in self._rules.aggregates:
            self._observations.append(Observation(uuid.uuid4().hex))
            self.rows = self.rows.observe(self._observations[-1], *aggregates)

    def totals(self) -> list[dict]:
        return [dict(o.get) for o in self._observations]

    def findings(self) -> DataFrame:
        """Findings of all row rules over the rows that the first action has read."""
        return self._rules.findings(self.totals())

    def first_rows(self) -> dict[str, int]:
        return _first_rows(self._rules, self.totals())


def _first_rows(rules: _Rules, totals: list[dict]) -> dict[str, int]:
    """rule_id (with the column) -> smallest row key."""
    found = {}
    for group, values in zip(rules.groups, totals):
        for i, check in enumerate(group):
            if values.get(f"first{i}") is not None:
                found[f"{check.rule_id}:{check.column or ''}"] = values[f"first{i}"]
    return found


def merged_totals(parts: list[dict]) -> dict:
    """Counts of disjoint rows add up; first row keys take the smallest."""
    made: dict = {}
    for part in parts:
        for name, value in part.items():
            old = made.get(name)
            if value is not None:
                made[name] = value if old is None else (min(old, value) if name.startswith("first") else old + value)
            else:
                made.setdefault(name)
    return made


class ObservedStream:
    """Row rules counted on a stream's own write, read from the progress of its micro-batches.

    ``rows`` goes into the caller's writeStream. Each micro-batch reports its counts once it is done; here they are only
    added up, so what is kept is as large as the contract. A restarted query goes on from ``totals()`` given as ``before``.
    """

    def __init__(self, stream: DataFrame, contract: Contract | dict, *, row_key: str | None = None, as_of=None,
                 before: list[dict] | None = None):
        self._rules = _Rules(stream, contract, row_key, as_of)
        self._names = [f"rules-{uuid.uuid4().hex}" for _ in self._rules.groups]
        self.rows = stream
        for name, aggregates in zip(self._names, self._rules.aggregates):
            self.rows = self.rows.observe(name, *aggregates)
        self._totals = [dict(t) for t in before] if before else [{} for _ in self._names]
        self._last: dict[str, int] = {}  # per query the last micro-batch added
        self._listener = _Progress(self)
        stream.sparkSession.streams.addListener(self._listener)

    def add(self, query_id: str, batch_id: int, metrics: dict) -> None:
        if batch_id <= self._last.get(query_id, -1) or not set(self._names) <= set(metrics):
            return
        self._last[query_id] = batch_id
        self._totals = [merged_totals([held, metrics[name].asDict()]) for held, name in zip(self._totals, self._names)]

    def finish(self, query: StreamingQuery) -> ObservedStream:
        """Wait for the query's end, take what its progress has and the listener may not have seen yet, and stop listening."""
        query.awaitTermination()
        self._rules.df.sparkSession.streams.removeListener(self._listener)
        for progress in query.recentProgress:
            self.add(str(progress.id), progress.batchId, progress.observedMetrics)
        return self

    def totals(self) -> list[dict]:
        return self._totals

    def findings(self) -> DataFrame:
        """Findings over the micro-batches finished so far."""
        return self._rules.findings(self._totals)

    def first_rows(self) -> dict[str, int]:
        return _first_rows(self._rules, self._totals)


class _Progress(StreamingQueryListener):
    def __init__(self, observed: ObservedStream):
        self._observed = observed

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._observed.add(str(event.progress.id), event.progress.batchId, event.progress.observedMetrics)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
