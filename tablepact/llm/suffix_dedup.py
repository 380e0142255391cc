"""Exact removal of repeated byte strings by suffix arrays of content-routed shards.

A byte goes when a string of ``length`` bytes covers it that starts anywhere else, too.

Equal strings must meet, but no row per byte may travel. So every window of ``length`` bytes
names an anchor: the position of its smallest ``GRAM``-byte hash. Equal windows have equal
anchors, and consecutive windows mostly share one, so a block of documents sends one row per
run of windows: the anchor's hash and a digest of the run's context (all bytes its windows
cover), equal ones of a block already combined. Then

* contexts found twice are repeated as a whole: all their windows go;
* an anchor with one context only, found once, repeats nowhere: nothing travels any more;
* what is left are the edges of repeated passages, anchors with several contexts. Their bytes
  are fetched once and routed by anchor to shards. A shard sorts its suffixes by
  Larsson-Sadakane refinement (ranks of 8 bytes, doubled, groups still tied only), and takes
  common prefixes by Kasai's rule side by side over all contexts; neighbours with a common
  prefix of ``length`` bytes are repeated windows;
* an anchor with more contexts than a shard holds is dealt over several; each shard sends the BLAKE2 digests (128 bits) of
  its distinct windows, which are sorted and looked up in one another by binary search. So the bytes decide there, too,
  and how many contexts a shard holds does not change the result.

The block keeps its rows compressed, so texts move twice in all, once to hand out contexts and
once to be cut. Contexts that repeat as a whole are told by 128 bits (the hash of the anchor and that of the context).

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing;
texts of any length are read whole; repeated rows of at least ``length`` bytes lose everything;
an empty table gives an empty result; other columns stay as they are in ``remove_repeats`` and
are ignored by ``repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.common import arrow_rows, packed_rows, small_batches, stored, text_of, unpacked_rows

LENGTH = 200
GRAM = 40
BLOCK_BYTES = 1 << 20
PIECE_BYTES = 1 << 18
BATCH_ROWS = 1 << 10
SHARD_CONTEXTS = 5_000
BASE, SECOND_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64; kept for the task's next block."""
    held = _POWERS.get(base)
    if held is None or len(held) <= n:
        factors = np.full(n + 1, base, dtype=np.uint64)
        factors[0] = 1
        held = np.cumprod(factors, dtype=np.uint64)
        if n <= 2 * PIECE_BYTES:
            _POWERS[base] = held
    return held


class Rolling:
    """Hashes of any slices of one byte array, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, base: np.uint64) -> None:
        n, odd = len(data), int(base) | 1
        values = _mixed(np.arange(256, dtype=np.uint64) + base)
        self.back = _powers(pow(odd, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[data] * _powers(odd, n)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive keys, by running minima of blocks from both sides."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


class Runs:
    """Runs of windows that share an anchor in the texts of a block: first, last, anchor and hashes.

    Hashing holds some hundred bytes per byte of text, so a block is hashed piece by piece. A run that
    is cut between two pieces is two contexts of its anchor, so its bytes are compared.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int, piece_bytes: int = PIECE_BYTES) -> None:
        found: list[list[np.ndarray]] = [[np.empty(0, dtype=np.int64)] * 2 + [np.empty(0, dtype=np.uint64)] * 2]
        for low, high in _pieces(ends, length, piece_bytes):
            inner = ends[np.searchsorted(ends, low, side="right"):np.searchsorted(ends, high)]
            piece = PieceRuns(data[low:high], np.append(inner, high) - low, length)
            found.append([piece.first + low, piece.last + low, piece.anchor, piece.context])
        self.first, self.last, self.anchor, self.context = (np.concatenate(x) for x in zip(*found))


def _pieces(ends: np.ndarray, length: int, piece_bytes: int) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of whole texts; of a longer text, pieces that share all but one byte of a window."""
    low, stop = 0, int(ends[-1]) if len(ends) else 0
    while low < stop:
        fit = int(np.searchsorted(ends, low + piece_bytes, side="right"))
        high = int(ends[fit - 1]) if fit else 0
        if high > low:
            yield low, high
            low = high
            continue
        yield low, min(low + piece_bytes + length - 1, int(ends[fit]))
        low += piece_bytes


class PieceRuns:
    """The runs of one piece."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int) -> None:
        gram = min(GRAM, length)
        width = length - gram + 1
        empty = np.empty(0, dtype=np.int64)
        self.first = self.last = empty
        self.anchor = self.context = empty.astype(np.uint64)
        if len(data) < length:
            return
        rolling = Rolling(data, BASE)
        at = np.arange(len(data) - gram + 1)
        grams = _mixed(rolling.of(at, at + gram))
        # the hash decides, then the leftmost: a function of the window's bytes alone
        order = grams >> np.uint64(24) << np.uint64(24)
        position = np.uint64((1 << 24) - 1)
        parts = []
        for low in range(0, len(grams) - width + 1, 1 << 23):  # positions fit into 24 bits per part
            part = order[low:low + (1 << 23) + width - 1] | np.arange(min(len(order) - low, (1 << 23) + width - 1), dtype=np.uint64)
            parts.append((window_minima(part, width) & position).astype(np.int64) + low)
        chosen = np.concatenate(parts)
        starts = np.concatenate([[0], ends[:-1]])
        whole = np.zeros(len(chosen) + 1, dtype=np.int8)  # windows inside one text
        long = ends - starts >= length
        np.add.at(whole, starts[long], 1)
        np.add.at(whole, ends[long] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
        if not len(at):
            return
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(chosen[at]) != 0)) + 1
        self.first = at[np.concatenate([[0], cut])]
        self.last = at[np.concatenate([cut - 1, [len(at) - 1]])]
        anchor = chosen[self.first]
        self.anchor = grams[anchor]
        second = Rolling(data, SECOND_BASE).of(self.first, self.last + length)
        shape = (anchor - self.first).astype(np.uint64) << np.uint64(32) | (self.last - self.first).astype(np.uint64)
        self.context = _mixed(second + _mixed(shape) + self.anchor)


def texts_of(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts of a batch, and where each ends."""
    texts = batch.column(column).cast(pa.large_binary()).to_pylist()
    ends = np.cumsum([len(t or b"") for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8), ends


BLOCKS = "block long, rows binary, runs binary, anchors array<long>, contexts array<long>, counts array<int>"


def _coded(runs: Runs, back: np.ndarray) -> bytes:
    """First window, width and context number of every run, small numbers first."""
    numbers = np.concatenate([np.diff(runs.first, prepend=0), runs.last - runs.first, back])
    return len(back).to_bytes(8, "little") + pa.compress(numbers.astype("<i4").tobytes(), "zstd", asbytes=True)


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window and context number of every run."""
    n = int.from_bytes(data[:8], "little")
    numbers = np.frombuffer(pa.decompress(data[8:], 12 * n, "zstd", asbytes=True), dtype="<i4").astype(np.int64)
    first = np.cumsum(numbers[:n])
    return first, first + numbers[n:2 * n], numbers[2 * n:]


def blocks(df: DataFrame, text_col: str, length: int, block_bytes: int) -> DataFrame:
    """Rows packed into blocks, each with its distinct (anchor, context) pairs and how often they occur."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for batch in small_batches(batches, text_col, block_bytes):
            runs = Runs(*texts_of(batch, text_col), length)
            pair, back, counts = _distinct(runs)
            one = lambda x, t: pa.array([x], t)
            yield pa.RecordBatch.from_arrays(
                [one(serial, pa.int64()), one(packed_rows(batch), pa.binary()), one(_coded(runs, back), pa.binary()),
                 one(runs.anchor[pair].view(np.int64), pa.list_(pa.int64())),
                 one(runs.context[pair].view(np.int64), pa.list_(pa.int64())), one(counts, pa.list_(pa.int32()))],
                names=["block", "rows", "runs", "anchors", "contexts", "counts"])
            serial += 1

    return df.mapInArrow(pack, BLOCKS)


def _distinct(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First run of each distinct pair of anchor and context, the distinct number of every run, and their counts."""
    order = np.lexsort((runs.anchor, runs.context))
    anchor, context = runs.anchor[order], runs.context[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (context[1:] != context[:-1]) | (anchor[1:] != anchor[:-1])
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], back, np.diff(np.append(first, len(order))).astype(np.int32)


def marked(packed: DataFrame) -> DataFrame:
    """Contexts that may repeat: block, k (number within the block), copies, rivals of their anchor."""
    runs = packed.select("block", F.posexplode(F.arrays_zip("anchors", "contexts", "counts")).alias("k", "run")).select(
        "block", "k", F.col("run.anchors").alias("anchor"), F.col("run.contexts").alias("context"),
        F.col("run.counts").alias("n"))
    # one exchange by anchor serves both windows; a block has sent each context once
    by_anchor, by_context = Window.partitionBy("anchor"), Window.partitionBy("anchor", "context")
    counted = (runs.withColumn("total", F.sum("n").over(by_anchor)).filter("total > 1")
               .withColumn("copies", F.sum("n").over(by_context))
               .withColumn("nth", F.row_number().over(by_context.orderBy("block", "k"))))
    rivals = F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(by_anchor)
    return counted.withColumn("rivals", rivals).filter("copies > 1 OR rivals > 1").select(
        "block", "k", "anchor", "context", "copies", "nth", "rivals")


def _contexts(text_col: str, length: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, _ = texts_of(unpacked_rows(row["rows"]), text_col)
                first, last, number = _decoded(row["runs"])
                _, pair = np.unique(number, return_index=True)
                raw, wanted = data.tobytes(), row["wanted"]
                chosen = pair[[w["k"] for w in wanted]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(wanted), pa.int64()), pa.array([w["k"] for w in wanted], pa.int32()),
                     pa.array([w["shard"] for w in wanted], pa.int64()), pa.array([w["dealt"] for w in wanted], pa.bool_()),
                     pa.array([raw[a:b + length] for a, b in zip(first[chosen], last[chosen])], pa.binary())],
                    names=["block", "k", "shard", "dealt", "bytes"])
    return take


def suffix_array(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared over at least ``depth`` bytes.

    ``ends``: for every position the end of its string; a suffix ends there, and ended
    suffixes are all different. Larsson-Sadakane: ranks by ``h`` bytes are refined to ``2 h``
    through the rank ``h`` further on, in groups that are not yet singletons.
    """
    n = len(data)
    kind = _positions(n)
    if not n:
        return np.empty(0, dtype=kind)
    key = np.zeros(n, dtype=np.uint64)
    left = np.minimum(ends - np.arange(n, dtype=kind), 8).astype(np.uint8)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    for k in range(8):
        key <<= np.uint64(8)
        key |= np.where(left > k, padded[k:k + n], np.uint8(0))
    order = np.lexsort((left, key)).astype(kind)  # an ended suffix stands before one that goes on with a zero byte
    key, left = key[order], left[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (left[1:] != left[:-1])])
    del key, left
    rank = np.empty(n, dtype=kind)
    rank[order] = _first_places(new, np.arange(n, dtype=kind))  # a group's rank: its first place
    h = 8
    while h < 2 * depth:
        placed = rank[order]
        same = placed[1:] == placed[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same)).astype(kind)  # places in the order
        del placed, same
        if not len(tied):
            break
        at = order[tied]
        follow = np.minimum(at, n - 1 - min(h, n - 1)) + min(h, n - 1)
        second = np.where(h < ends[at] - at, rank[follow] + 1, -1 - at)
        first = rank[at]
        resort = np.lexsort((second, first))
        at, second, first = at[resort], second[resort], first[resort]
        del follow, resort
        order[tied] = at
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[at] = _first_places(fresh, tied)
        h *= 2
    return order


def _positions(n: int) -> type:
    """The narrow type of positions in ``n`` bytes: a shard holds a dozen arrays of them."""
    return np.int32 if n < 1 << 30 else np.int64


def _first_places(new: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The place where each one's group begins."""
    return np.maximum.accumulate(np.where(new, places, places.dtype.type(0)))


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                    windows: np.ndarray, limit: int) -> np.ndarray:
    """Kasai's rule over all strings side by side: common prefix of each position with its
    predecessor in the suffix order, up to ``limit``, for the first ``windows`` positions of each string.

    Moving one position on, at least all but one of the common bytes remain.
    """
    n = len(data)
    kind = _positions(n)
    stop = np.repeat(ends.astype(kind), ends - starts)
    before = np.full(n, -1, dtype=kind)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, dtype=kind)
    held = np.zeros(len(starts), dtype=np.int64)
    alive = np.arange(len(starts))
    for step in range(int(windows.max(initial=0))):
        alive = alive[windows[alive] > step]
        p = starts[alive] + step
        q = before[p]
        h = np.maximum(held[alive] - 1, 0)
        h[q < 0] = 0
        open_ = np.flatnonzero(q >= 0)
        while len(open_):
            a, b = p[open_] + h[open_], q[open_] + h[open_]
            # both inside their strings, under the limit, and equal
            ok = (h[open_] < limit) & (a < stop[p[open_]]) & (b < stop[q[open_]])
            ok[ok] = data[a[ok]] == data[b[ok]]
            open_ = open_[ok]
            h[open_] += 1
        shared[p] = h
        held[alive] = h
    return shared


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Per string, which of its windows equal another window of any string."""
    sizes = np.asarray([len(s) for s in strings], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    order = suffix_array(data, np.repeat(ends.astype(_positions(len(data))), sizes), length)
    windows = np.maximum(sizes - length + 1, 0)
    shared = common_prefixes(data, order, starts, ends, windows, length)
    hit = (shared >= length)[order]
    found = np.zeros(len(data), dtype=bool)
    found[order] = hit | np.concatenate([hit[1:], [False]])
    return [found[s:s + w] for s, w in zip(starts, windows)]


def _runs_of(flags: np.ndarray) -> list[int]:
    """Bounds of the runs of true values: first, last, first, last ..."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1]).reshape(-1).tolist()


FOUND = "block long, k int, hits array<int>, digests array<binary>, firsts array<int>, single array<boolean>"


def _shard(length: int):
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        strings = frame["bytes"].tolist()
        flags = repeated_windows(strings, length)
        digests, firsts, single, seen = [], [], [], set()
        for text, flag, dealt in zip(strings, flags, frame["dealt"]):
            # another shard may hold the only equal of a dealt anchor's window; equal ones are sent once
            sent, at, alone = [], [], []
            for i in range(len(flag)) if dealt else ():
                digest = hashlib.blake2b(text[i:i + length], digest_size=16).digest()
                if flag[i]:
                    if digest in seen:
                        continue
                    seen.add(digest)
                sent.append(digest)
                at.append(i)
                alone.append(not flag[i])
            digests.append(sent)
            firsts.append(np.asarray(at, dtype=np.int32))
            single.append(np.asarray(alone, dtype=bool))
        return pd.DataFrame({"block": frame["block"], "k": frame["k"], "hits": [_runs_of(f) for f in flags],
                             "digests": digests, "firsts": firsts, "single": single})
    return search


def _found_twice(rows: pa.Table) -> pa.Table:
    """Of windows sorted by digest, those that stand once in their shard and have an equal: looked up by binary search."""
    halves = np.frombuffer(b"".join(rows.column("digest").to_pylist()), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    high, low = halves.T
    near = np.flatnonzero(np.searchsorted(high, high, side="right") - np.searchsorted(high, high, side="left") > 1)
    twice = np.zeros(len(high), dtype=bool)
    same = (high[near[1:]] == high[near[:-1]]) & (low[near[1:]] == low[near[:-1]])
    twice[near[1:][same]] = twice[near[:-1][same]] = True
    return rows.filter(pa.array(twice & np.asarray(rows.column("single")))).select(["block", "k", "at"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted windows of all shards, batch by batch; the last digest so far waits for its equals."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        digests = batch.column("digest").to_pylist()
        at = next((i for i in range(len(digests) - 1, -1, -1) if digests[i] != digests[-1]), -1) + 1
        if held and at == 0 and held[-1].column("digest")[0].as_py() == digests[0]:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, at)]
        if sum(b.num_rows for b in done):
            yield from _found_twice(pa.Table.from_batches(done).combine_chunks()).to_batches()
        held = [batch.slice(at)]
    if held:
        yield from _found_twice(pa.Table.from_batches(held).combine_chunks()).to_batches()


def shard_hits(packed: DataFrame, may: DataFrame, text_col: str, length: int, shard_contexts: int) -> DataFrame:
    """block, k, hits: repeated windows of contexts that occur once, beside rivals of the same anchor."""
    wanted = may.filter("rivals > 1 AND nth = 1")
    dealt, large = F.col("rivals") > shard_contexts, F.col("rivals") * 4 > shard_contexts
    shards = max(1, -(-wanted.filter(~large).count() // shard_contexts))
    # large anchors share no shard, a hot one is dealt over as many as it needs: chance fills no shard several times over
    part = F.when(dealt, F.pmod("context", F.ceil(F.col("rivals") * 4 / shard_contexts))).otherwise(F.lit(0))
    shard = F.when(large, F.xxhash64("anchor", part)).otherwise(F.pmod("anchor", F.lit(shards)))
    requests = wanted.select("block", F.struct("k", shard.cast("long").alias("shard"), dealt.alias("dealt")).alias("w")) \
        .groupBy("block").agg(F.collect_list("w").alias("wanted"))  # no more than a block has runs
    contexts = packed.select("block", "rows", "runs").join(requests, "block").mapInArrow(
        _contexts(text_col, length), "block long, k int, shard long, dealt boolean, bytes binary")
    found = stored(contexts.groupBy("shard").applyInPandas(_shard(length), FOUND), "suffix-hits")
    own = found.filter(F.size("hits") > 0).select("block", "k", "hits")
    # what a shard has found repeated needs no other; what stands there once does. A digest has a row per shard at most
    windows = found.filter(F.size("digests") > 0).select("block", "k", F.explode(F.arrays_zip(
        F.col("firsts").alias("at"), F.col("digests").alias("digest"), F.col("single").alias("single"))).alias("w"))
    across = windows.select("block", "k", "w.*").repartition("digest").sortWithinPartitions("digest").mapInArrow(
        _merged, "block long, k int, at int")
    across = across.groupBy("block", "k").agg(F.collect_list("at").alias("at")).select(
        "block", "k", F.flatten(F.transform("at", lambda x: F.array(x, x))).alias("hits"))
    return own.unionByName(across)


def _cut(text_col: str, length: int, as_rows: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = unpacked_rows(batch.column("rows")[k].as_py())
                data, ends = texts_of(rows, text_col)
                gone = np.zeros(len(data) + 1, dtype=np.int32)
                whole, parts = batch.column("whole")[k].as_py(), batch.column("parts")[k].as_py()
                if whole or parts:
                    first, last, number = _decoded(batch.column("runs")[k].as_py())
                    _, pair = np.unique(number, return_index=True)
                    every = np.zeros(len(pair), dtype=bool)
                    every[whole or []] = True
                    hit = every[number]
                    gone[first[hit]] += 1  # runs start, and end, at different windows
                    np.add.at(gone, last[hit] + length, -1)
                    for part in parts or []:
                        start, bounds = int(first[pair[part["k"]]]), part["hits"]
                        for a, b in zip(bounds[::2], bounds[1::2]):
                            gone[start + a] += 1
                            gone[start + b + length] -= 1
                removed = np.cumsum(gone[:-1]) > 0
                yield _texts(rows, text_col, data, ends, removed) if as_rows else _digests(rows, data, ends, removed)
    return cut


def _kept(data: np.ndarray, ends: np.ndarray, removed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    start = 0
    for end in ends.tolist():
        yield data[start:end], removed[start:end]
        start = end


def _digests(rows: pa.RecordBatch, data: np.ndarray, ends: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
    size, lost, spans, kept = [], [], [], []
    for text, gone in _kept(data, ends, removed):
        size.append(len(text))
        lost.append(int(gone.sum()))
        spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
        kept.append(hashlib.sha256(text[~gone].tobytes() if lost[-1] else text.tobytes()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, lost, spans)), pa.array(kept, pa.string())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(rows: pa.RecordBatch, text_col: str, data: np.ndarray, ends: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
    texts = [t[~g].tobytes().decode("utf-8", "ignore") for t, g in _kept(data, ends, removed)]
    at = rows.schema.get_field_index(text_col)
    null = rows.column(at).is_null().to_pylist()
    made = pa.array([None if n else t for t, n in zip(texts, null)], pa.string())
    return pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(rows.columns)], names=rows.schema.names)


def _searched(df: DataFrame, text_col: str, length: int, block_bytes: int, shard_contexts: int,
              schema, as_rows: bool) -> DataFrame:
    with arrow_rows(df.sparkSession, BATCH_ROWS):
        packed = stored(blocks(df, text_col, length, block_bytes), "suffix-blocks", compression="uncompressed")
    may = stored(marked(packed), "suffix-marked", compression="zstd")
    whole = may.filter("copies > 1").groupBy("block").agg(F.collect_list("k").alias("whole"))
    parts = shard_hits(packed, may.filter("rivals > 1"), text_col, length, shard_contexts) \
        .groupBy("block").agg(F.collect_list(F.struct("k", "hits")).alias("parts"))
    return (packed.select("block", "rows", "runs").join(whole.join(parts, "block", "full"), "block", "left")
            .mapInArrow(_cut(text_col, length, as_rows), schema))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            block_bytes: int = BLOCK_BYTES, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``df``."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _searched(docs, "text", length, block_bytes, shard_contexts,
                     f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", False)


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH,
                   block_bytes: int = BLOCK_BYTES, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """``df`` with repeated bytes cut out of its texts; a character cut in two goes as well."""
    return _searched(df, text_col, length, block_bytes, shard_contexts, df.schema, True)
