"""Windowed quality with the rows a watermark refuses kept beside the windows.

The watermark is the largest event time of all micro-batches before, minus the delay. A row whose window ended at or before
it is late: its window has been reported as final, so the row goes to a side table instead of changing it. Each micro-batch
leaves its rule counts per window, its late rows and its largest event time in folders of its own, replaced if it is retried; what it
decides depends on earlier micro-batches only, so a retry decides alike. Final windows, open windows and late
rows together are all rows with an event time; rows without one are late, too.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions.coercion import named
from tablepact.functions.schemas import flat_schema
from tablepact.operators.predicates import RowCheck
from tablepact.streaming.checks import BATCH, batch_results

SEEN = flat_schema("newest timestamp, rows bigint")


class LateAwareWindows:
    """Rule counts per event-time window over several micro-batches."""

    def __init__(self, stream: DataFrame, checks: list[RowCheck], event_time: str, window: str, delay: str, folder: str):
        self.stream, self.checks, self.folder = stream, [c for c in checks if c.violated is not None], folder.rstrip("/")
        self.at, self.window, self.delay = named(event_time).cast("timestamp"), window, delay
        self.spark = stream.sparkSession

    def start(self, **trigger):
        return (self.stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(**(trigger or {"availableNow": True})).start())

    def _minus_delay(self, newest: Column) -> Column:
        return newest - F.expr(f"INTERVAL {self.delay}")

    def watermark(self, before: int | None = None) -> DataFrame:
        """One row: watermark after all micro-batches, or after those before one."""
        try:
            seen = batch_results(self.spark, f"{self.folder}/seen", SEEN)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            seen = self.spark.createDataFrame([], T.StructType([*SEEN.fields, T.StructField(BATCH, T.LongType())]))
        seen = seen if before is None else seen.where(F.col(BATCH) < before)
        return seen.agg(self._minus_delay(F.max("newest")).alias("watermark"))

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        mark = self.watermark(batch_id).first()["watermark"]
        rows = batch.where(self.at.isNotNull()).withColumn("_window", F.window(self.at, self.window))
        late = F.lit(False) if mark is None else F.col("_window.end") <= F.lit(mark)
        counts = [F.count_if(c.violated).alias(f"n{i}") for i, c in enumerate(self.checks)]
        write = lambda df, table: df.write.mode("overwrite").parquet(f"{self.folder}/{table}/{BATCH}={batch_id}")
        write(rows.where(~late).groupBy("_window").agg(F.count(F.lit(1)).alias("total"), *counts).select(
            F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "total", *[f"n{i}" for i in range(len(counts))]),
            "windows")
        write(rows.where(late).drop("_window").unionByName(batch.where(self.at.isNull())), "late")
        # written last: a micro-batch counts for the watermark once its tables are complete
        write(batch.agg(F.max(self.at).alias("newest"), F.count(F.lit(1)).alias("rows")), "seen")

    def _windows(self) -> DataFrame:
        counts = [f"n{i}" for i in range(len(self.checks))]
        schema = T.StructType([T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType()),
                               *[T.StructField(c, T.LongType()) for c in ("total", *counts)]])
        parts = batch_results(self.spark, f"{self.folder}/windows", schema)
        summed = parts.groupBy("window_start", "window_end").agg(*[F.sum(c).alias(c) for c in ("total", *counts)])
        return summed.withColumn("final", F.coalesce(F.col("window_end") <= self.watermark().scalar(), F.lit(False)))

    def windows(self, final: bool | None = True) -> DataFrame:
        """window_start, window_end, final, rows, rule_id, column, affected_rows; by default of the windows the watermark has passed."""
        rows = [F.struct(F.lit(c.rule_id).alias("rule_id"), F.lit(c.column).cast("string").alias("column"),
                         F.col(f"n{i}").alias("affected_rows")) for i, c in enumerate(self.checks)]
        found = self._windows() if final is None else self._windows().where(F.col("final") == final)
        return found.select("window_start", "window_end", "final", F.col("total").alias("rows"), F.explode(F.array(*rows)).alias("r")).select(
            "window_start", "window_end", "final", "rows", "r.*")

    def late(self) -> DataFrame:
        """The refused rows, with the micro-batch that brought them."""
        return batch_results(self.spark, f"{self.folder}/late", self.stream.schema)
