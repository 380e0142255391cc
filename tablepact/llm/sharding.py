"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal text form a group that stays together. A partial partition is a vector of
``shards`` sums; differencing takes the two partial partitions with the largest spread and
adds them in opposite order, so large sums meet small ones. Every group starts as a vector
with one entry.

The work is a tree: groups are dealt into buckets by hash, each bucket is differenced in its
own task to one vector, and the vectors of up to ``FAN`` buckets are differenced again until
one is left. Only vectors travel between levels; a task holds at most ``BUCKET_GROUPS`` group
sizes, however many rows the groups have (sizes are summed before they meet).

Defined results: a null text has no bytes and stands with the empty texts; sizes are UTF-8
bytes plus ``ROW_BYTES``; repeated rows are rows of one group; ties are broken by text digest;
an empty table gives an empty result; other columns are ignored. A group larger than a shard's
share stays whole, alone in its shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.common import ids_and_texts, partitions, stored

SHARDS = 40
ROW_BYTES = 16
BUCKET_GROUPS = 150_000
FAN = 1000


def differenced(vectors: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions.

    ``vectors``: one row per partial partition, ``w`` sums each (w = 1: indivisible sizes).
    Returns the label of every entry (0 to shards - 1, shape of ``vectors``) and the sums.
    """
    count, width = vectors.shape
    leader = np.arange(count * width, dtype=np.int64)  # entries that share a shard point to one of them
    sums = np.zeros(shards, dtype=np.int64)
    owner = np.full(shards, -1, dtype=np.int64)

    def opened(k: int) -> tuple[np.ndarray, np.ndarray]:
        s, o = sums.copy(), owner.copy()
        s[:width], o[:width] = vectors[k], np.arange(k * width, (k + 1) * width)
        order = np.argsort(-s, kind="stable")
        return s[order], o[order]

    spread = vectors.max(axis=1) - (vectors.min(axis=1) if width == shards else 0)
    # unopened partitions stay numbers: a queue by spread; only combined ones are vectors
    queue = np.argsort(-spread, kind="stable")
    at, made, serial = 0, [], 0

    def largest() -> tuple[np.ndarray, np.ndarray]:
        nonlocal at
        if at < count and (not made or spread[queue[at]] >= -made[0][0]):
            at += 1
            return opened(queue[at - 1])
        return heapq.heappop(made)[2]

    left = count
    while left > 1:
        (s, o), (t, p) = largest(), largest()
        t, p = t[::-1], p[::-1]
        both = (o >= 0) & (p >= 0)
        leader[p[both]] = o[both]
        s, o = s + t, np.where(o >= 0, o, p)
        order = np.argsort(-s, kind="stable")
        s, o = s[order], o[order]
        heapq.heappush(made, (-int(s[0] - s[-1]), serial, (s, o)))
        serial += 1
        left -= 1
    s, o = largest()
    while (leader[leader] != leader).any():
        leader = leader[leader]
    label_of = np.zeros(count * width, dtype=np.int64)
    label_of[o[o >= 0]] = np.flatnonzero(o >= 0)
    return label_of[leader].reshape(count, width), s


def _group_labels(shards: int):
    def label(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        labels, _ = differenced(frame["bytes"].to_numpy(dtype=np.int64)[:, None], shards)
        return pd.DataFrame({"key": frame["key"], "bytes": frame["bytes"], "node": frame["node"], "label": labels[:, 0]})
    return label


def _node_labels(shards: int):
    def label(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["node", "label"])
        labels, _ = differenced(frame["bytes"].to_numpy(dtype=np.int64).reshape(-1, shards), shards)
        return pd.DataFrame({"node": frame["node"], "label": frame["label"], "bytes": frame["bytes"],
                             "parent": frame["parent"], "parent_label": labels.reshape(-1)})
    return label


def _sums(labels: DataFrame, node: str, label: str, shards: int) -> DataFrame:
    """One row per node and label, labels without members included."""
    every = labels.select(F.col(node).alias("node")).distinct().select(
        "node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("label"))
    found = labels.groupBy(F.col(node).alias("node"), F.col(label).alias("label")).agg(F.sum("bytes").alias("bytes"))
    return every.join(found, ["node", "label"], "left").fillna(0, "bytes")


def shards_of_groups(groups: DataFrame, shards: int = SHARDS, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(key, bytes), one row per group -> (key, shard)."""
    buckets = max(1, -(-groups.count() // bucket_groups))
    dealt = groups.select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("long").alias("node"))
    low = stored(dealt.groupBy("node").applyInPandas(_group_labels(shards), "key binary, bytes long, node long, label long"),
                 "shard-groups")
    if buckets == 1:
        return low.select("key", F.col("label").cast("int").alias("shard"))
    chain = low.select("node", "label").distinct().select("node", "label", F.col("node").alias("up"), F.col("label").alias("up_label"))
    level, nodes = low.select("node", "label", "bytes"), buckets
    node, label = "node", "label"
    while nodes > 1:
        sums = _sums(level, node, label, shards).withColumn("parent", F.floor(F.col("node") / FAN))
        level = stored(sums.groupBy("parent").applyInPandas(
            _node_labels(shards), "node long, label long, bytes long, parent long, parent_label long"), "shard-level")
        step = level.select(F.col("node").alias("up"), F.col("label").alias("up_label"), "parent", "parent_label")
        chain = chain.join(step, ["up", "up_label"]).select(
            "node", "label", F.col("parent").alias("up"), F.col("parent_label").alias("up_label"))
        node, label, nodes = "parent", "parent_label", -(-nodes // FAN)
    # rows: buckets x shards, a few thousandths of the groups
    final = chain.select("node", "label", F.col("up_label").cast("int").alias("shard"))
    return low.join(final, ["node", "label"]).select("key", "shard")


def with_slots(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Number the rows of each shard from 0 without a gap, in salted parts that add up."""
    salts = partitions(rows.sparkSession)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # shards x salts rows
    bases = salted.groupBy("shard", "salt").count().select(
        "shard", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "salt").orderBy("doc_id", "size", "text_crc32")
    return (salted.withColumn("n", F.row_number().over(within) - 1).join(bases, ["shard", "salt"])
            .withColumn("slot", (F.col("base") + F.col("n")).cast("long")).drop("salt", "n", "base"))


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                    row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of ``df``."""
    docs = ids_and_texts(df, id_col, text_col)
    narrow = stored(docs.select(
        "doc_id", (F.octet_length("text") + row_bytes).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(F.col("text"), 256)).alias("key")), "shard-rows")
    groups = narrow.groupBy("key").agg(F.sum("size").alias("bytes"))
    placed = narrow.join(shards_of_groups(groups, shards), "key").drop("key")
    return with_slots(stored(placed, "shard-placed"), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
