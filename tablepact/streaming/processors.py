"""Custom keyed state for row-level duplicate reports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tablepact.functions.schemas import flat_schema

OUTPUT = flat_schema("key string, row bigint")
_STATE = flat_schema("seen bigint, first_row bigint")


class FirstRowState(StatefulProcessor):
    """Emits a key's rows from its second row on, and its first row at that moment."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("rows", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen, first = self._state.get() if self._state.exists() else (0, None)
        for row in rows:
            seen += 1
            if seen == 1:
                first = row["row"]
                continue
            if seen == 2:
                yield Row(key=key[0], row=first)
            yield Row(key=key[0], row=row["row"])
        self._state.update((seen, first))

    def close(self) -> None:
        pass
