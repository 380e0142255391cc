"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib
from bisect import bisect_left

import numpy as np

from tablepact.llm import near_dedup, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signals(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {k for i, w in enumerate(windows) if w in twice for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_stop_words": sum(w.lower() in quality.STOP_WORDS for w in words), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_ellipsis_lines": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines),
        "n_bullet_lines": sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines)}


def kept(text: str | None) -> bool:
    s = signals(text)
    if s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]:
        return False
    for rule in quality.THRESHOLDS:
        share, base = 100 * s[rule.numerator], s[rule.denominator]
        if rule.low is not None and share < rule.low * base or rule.high is not None and share > rule.high * base:
            return False
    return True


def labelled(text: str | None) -> list:
    words = (text or "").lower().translate(str.maketrans("", "", near_dedup.MARKS))
    words = WORD.findall(words)
    seen: collections.Counter = collections.Counter()
    made = []
    for i in range(max(1, len(words) - 4)):
        shingle = tuple(words[i:i + 5])
        made.append((shingle, seen[shingle]))
        seen[shingle] += 1
    return made


def similarity(a: list, b: list) -> float:
    place, tails = {x: j for j, x in enumerate(b)}, []
    for x in a:
        j = place.get(x, -1)
        if j >= 0:
            k = bisect_left(tails, j)
            tails[k:k + 1] = [j]
    return len(tails) / (len(a) + len(b) - len(tails))


def classes(ids: list, texts: list) -> dict:
    """doc_id -> smallest doc_id of its near-duplicate class."""
    shingles = [labelled(t) for t in texts]
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            n, m = len(shingles[i]), len(shingles[j])
            if min(n, m) >= 0.8 * max(n, m) and find(i) != find(j) and similarity(shingles[i], shingles[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, d in enumerate(ids):
        groups[find(i)].append(d)
    return {d: min(g) for g in groups.values() for d in g}


def removed(texts: list, length: int = 200) -> list[tuple[bytes, np.ndarray]]:
    """Per text its bytes and which of them a repeated string covers."""
    raw = [(t or "").encode() for t in texts]
    count: collections.Counter = collections.Counter()
    for b in raw:
        count.update(b[i:i + length] for i in range(len(b) - length + 1))
    found = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        found.append((b, gone))
    return found


def digests(texts: list, length: int = 200) -> list[tuple]:
    made = []
    for b, gone in removed(texts, length):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        keep = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        made.append((len(b), int(gone.sum()), spans, hashlib.sha256(keep).hexdigest()))
    return made


def pieces(doc_id: object, ids: list[int], end: int, capacity: int) -> list[tuple]:
    coded = np.asarray([*ids, end], dtype="<u4")
    return [(doc_id, a // capacity, a, len(coded[a:a + capacity]), zlib.crc32(coded[a:a + capacity].tobytes()))
            for a in range(0, len(coded), capacity)]


def check_packing(rows: list, capacity: int) -> int:
    """Every sequence is gapless and within the capacity; returns how many there are."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)
