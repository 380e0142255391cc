"""Near copies of texts that repeat a passage: similarity is that of the shingles as they stand."""

from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pytest

from tablepact.llm import near_dedup


def plain_shingles(text: str) -> list[tuple]:
    return [s for s, _ in brute.labelled(text)]


def common(a: list, b: list) -> int:
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        above = row
    return above[-1]


def plain_similarity(a: list, b: list) -> float:
    k = common(a, b)
    return k / (len(a) + len(b) - k)


def templates(seed: int) -> list[tuple[str, str]]:
    """Texts of a repeated passage with some words of early copies changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    made = []
    for words, times, edits in [(40, 10, 1), (20, 10, 1), (100, 5, 3), (1, 200, 2), (3, 80, 3), (7, 30, 3), (50, 2, 1)]:
        text = [word() for _ in range(words)] * times
        changed = list(text)
        for _ in range(edits):
            changed[rng.randrange(max(words, len(text) // 3))] = word()
        made.append((" ".join(text), " ".join(changed)))
    return made


def coded(spark, texts: list[str]) -> list[np.ndarray]:
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    rows = df.select("i", near_dedup.word_codes(df.text).alias("codes")).collect()
    return [np.asarray(r["codes"], dtype=np.int64) for r in sorted(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages_are_linked(spark, seed):
    pairs = templates(seed)
    texts = [t for pair in pairs for t in pair]
    want = [plain_similarity(plain_shingles(a), plain_shingles(b)) for a, b in pairs]
    assert min(want[:3]) > 0.9 and min(want) >= 0.8
    codes = coded(spark, texts)
    sequences = [near_dedup.shingles(c) for c in codes]
    assert [near_dedup.aligned(sequences[2 * k], sequences[2 * k + 1]) for k in range(len(pairs))] == want
    keys = [set(near_dedup.order_sketches(near_dedup.labelled(s)).tolist()) for s in sequences]
    assert all(keys[2 * k] & keys[2 * k + 1] for k in range(len(pairs)))  # candidates of each other
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    assert found == {i: i // 2 * 2 for i in range(len(texts))}


def test_candidate_recall_of_repeated_passages():
    rng = random.Random(3)
    met = tested = 0
    while tested < 300:
        words, times = rng.choice([(6, 40), (20, 10), (40, 5), (100, 2)])
        text = [rng.randrange(1 << 40) for _ in range(words)] * times
        changed = list(text)
        for _ in range(rng.randint(1, 5)):
            changed[rng.randrange(len(text))] = rng.randrange(1 << 40)
        a, b = (near_dedup.shingles(np.asarray(t, dtype=np.int64)) for t in (text, changed))
        if near_dedup.aligned(a, b) >= 0.8:
            tested += 1
            x, y = (set(near_dedup.order_sketches(near_dedup.labelled(s)).tolist()) for s in (a, b))
            met += bool(x & y)
    assert met == tested


@pytest.mark.parametrize("wide", [8, 64, 1 << 13])
def test_alignment_of_repeats_is_exact_from_the_threshold_on(monkeypatch, wide):
    monkeypatch.setattr(near_dedup, "WIDE", wide)
    rng = random.Random(wide)
    above = 0
    for k in range(600):
        monkeypatch.setattr(near_dedup, "MEETINGS", [0, 4, 10**9][k % 3])
        kinds = rng.choice([1, 2, 5, 30])
        a = [rng.randrange(kinds) for _ in range(rng.randint(1, 90))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randint(0, 1)] = [rng.randrange(kinds + 1) for _ in range(rng.randint(0, 2))]
        b = b or [0]
        want, found = plain_similarity(a, b), near_dedup.aligned(np.asarray(a), np.asarray(b))
        above += want >= 0.8
        assert found == want if want >= 0.8 else found < 0.8
        if found >= 0.8:
            both = sum((Counter(a) & Counter(b)).values())
            assert found <= both / (len(a) + len(b) - both)
    assert above > 200
