"""Small results taken to the driver side by side."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

JOBS_AT_ONCE = 4


def taken(results: list[DataFrame]) -> list[DataFrame]:
    """Results whose size a contract or a limit bounds, computed at the same time, then local."""
    if not results:
        return []
    spark = results[0].sparkSession
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        # job group and local properties of the caller go along
        tables = [pool.submit(inheritable_thread_target(spark)(df.toArrow)) for df in results]
        return [spark.createDataFrame(t.result()) for t in tables]
