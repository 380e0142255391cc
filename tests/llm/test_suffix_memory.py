"""What a task of the suffix-array search holds at once, and that the bounds leave its results as they are."""

from __future__ import annotations

import random
import tracemalloc

import brute
import numpy as np
import pytest

from tablepact.llm import suffix_dedup


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_block_is_hashed_in_pieces():
    data = np.random.default_rng(1).integers(97, 123, suffix_dedup.BLOCK_BYTES, dtype=np.uint8)
    for ends in (np.arange(1 << 13, len(data) + 1, 1 << 13), np.array([len(data)])):  # many texts, and a long one
        assert peak_mb(lambda: suffix_dedup.Runs(data, ends, 200)) < 60


def test_a_full_shard_is_sorted_with_narrow_positions():
    rng = np.random.default_rng(2)
    shared = bytes(rng.integers(97, 123, 300, dtype=np.uint8))
    strings = [shared[:200 + i % 100] + bytes(rng.integers(97, 123, 60, dtype=np.uint8)) for i in range(suffix_dedup.SHARD_CONTEXTS)]
    assert peak_mb(lambda: suffix_dedup.repeated_windows(strings, 200)) < 75 * sum(map(len, strings)) / 1e6


@pytest.mark.parametrize("piece", [16, 64, 100, 1 << 18])
def test_pieces_hold_every_window_once(piece):
    rng = random.Random(piece)
    for _ in range(60):
        length = rng.choice([8, 9, 20])
        sizes = [rng.choice([0, 3, length - 1, length, 50, 200, 400]) for _ in range(rng.randint(0, 8))]
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        data = np.frombuffer(bytes(rng.randrange(3) for _ in range(sum(sizes))), dtype=np.uint8)
        runs = suffix_dedup.Runs(data, ends, length, piece)
        found = [i for a, b in zip(runs.first.tolist(), runs.last.tolist()) for i in range(a, b + 1)]
        assert found == [end - size + i for end, size in zip(ends.tolist(), sizes) for i in range(size - length + 1)]


def test_chance_fills_no_shard_several_times_over(spark, monkeypatch):
    """Passages of 15 documents each, and one of 200, between words that no other document has."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    times = [15] * 40 + [200]
    texts = [noise(rng.randint(250, 300)) + passage + noise(rng.randint(250, 300)) for n in times for passage in [noise(300)] for _ in range(n)]
    limit, search = 20, suffix_dedup._shard

    def bounded(length):
        inner = search(length)

        def each(frame):
            if len(frame) > 2 * limit:
                raise ValueError(f"{len(frame)} contexts in one shard")
            return inner(frame)
        return each

    monkeypatch.setattr(suffix_dedup, "_shard", bounded)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.repeats(df, shard_contexts=limit).collect()
    want = dict(enumerate(brute.digests(texts)))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
