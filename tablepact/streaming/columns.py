"""Columns of a stream's source files, held against the declared ones.

Spark reads a file that lacks a declared column as nulls and passes over columns that are not
declared. So every micro-batch looks up which files it reads (in the query's checkpoint) and
reads the column names of each before anything is published. JSON and text files have no
columns of their own and are not looked at, nor are sources without files.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame

from tablepact.contract import ContractError

WITH_COLUMNS = ("parquet", "orc", "csv")


def literal_path(path: str) -> str:
    """A path whose own glob characters stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


class SourceColumns:
    """The declared columns of a stream's file sources; ``check`` compares those of a micro-batch's files."""

    def __init__(self, stream: DataFrame, checkpoint: str):
        self.spark, self.checkpoint = stream.sparkSession, checkpoint
        leaves, found = stream._jdf.queryExecution().analyzed().collectLeaves(), []
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            if leaf.isStreaming() and not any(leaf.equals(x) for x in found):
                found.append(leaf)  # the query numbers its sources in this order
        self.sources = [self._declared(leaf) for leaf in found]

    @staticmethod
    def _declared(leaf) -> tuple[str, dict, list[str]] | None:
        """Format, options and column names of a source of files with columns."""
        if leaf.getClass().getSimpleName() != "StreamingRelation":
            return None
        kind, options, given = leaf.dataSource().className().lower(), {}, leaf.dataSource().options().iterator()
        while given.hasNext():
            pair = given.next()
            options[pair._1()] = pair._2()
        lowered = {k.lower(): v.lower() for k, v in options.items()}
        if kind not in WITH_COLUMNS or kind == "csv" and lowered.get("header") != "true":
            return None
        options = {k: v for k, v in options.items() if k.lower() not in ("path", "maxfilespertrigger")}
        return kind, options, [f["name"] for f in json.loads(leaf.schema().json())["fields"]]

    def check(self, batch_id: int) -> None:
        """Stop with an error where a file of this micro-batch has other columns than declared."""
        if not any(self.sources):
            return
        ends, starts = self._offsets(batch_id), self._offsets(batch_id - 1) if batch_id else []
        for i, source in enumerate(self.sources):
            end, start = ends[i], starts[i] if i < len(starts) else -1
            for path in self._files(i, start, end) if source else ():
                self._compare(path, *source)

    def _offsets(self, batch_id: int) -> list[int]:
        rows = self.spark.read.text(literal_path(f"{self.checkpoint}/offsets/{batch_id}")).collect()
        return [json.loads(r[0])["logOffset"] if "logOffset" in r[0] else -1 for r in rows[2:]]

    def _files(self, source: int, start: int, end: int) -> list[str]:
        """Files that the source listed after one offset and up to another."""
        if end <= start:
            return []
        log = literal_path(f"{self.checkpoint}/sources/{source}")
        names = ",".join(f"{n},{n}.compact" for n in range(start + 1, end + 1))
        rows = self.spark.read.text(f"{log}/{{{names}}}").where("value LIKE '{%'").distinct().collect()
        entries = [json.loads(r[0]) for r in rows]
        return sorted(unquote(e["path"]) for e in entries if start < e["batchId"] <= end)

    def _compare(self, path: str, kind: str, options: dict, declared: list[str]) -> None:
        plain = str if self.spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower
        in_path = {plain(part.split("=")[0]) for part in path.split("/")[:-1] if "=" in part}  # partition columns
        has = {plain(c) for c in self.spark.read.format(kind).options(**options).load(literal_path(path)).columns}
        wanted = {plain(c) for c in declared}
        lacks, more = sorted(wanted - has - in_path), sorted(has - wanted)
        if lacks or more:
            raise ContractError(f"Columns changed between files of the stream: {path} lacks {lacks} and has {more} besides the declared ones")
