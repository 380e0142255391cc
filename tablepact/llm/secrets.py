"""Secrets in texts: fixed patterns, and strings of high entropy found by a sliding window.

Base spans come from three patterns (an assignment to a secret's name, an access key, a long
hexadecimal run). Beside them, every run of token characters that is long enough is a candidate; a
window slides over it and keeps, per character class, the counts of its characters and their
sum of n * log2(n), updated by the character that enters and the one that leaves. Where all of the window is of the
class and its Shannon entropy reaches the class's bound, its characters are suspicious; windows that
overlap or touch are one span. Candidates on the allow list (UUIDs, addresses, placeholders, alphabets) are suppressed;
base spans never are. A span of the method inside a base span says nothing new and is left out.

Positions are code points, ends exclusive. Defined results: null and empty texts have no spans;
texts of any length are read whole, candidates too; repeated rows each get their row; null ids stay null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from tablepact.llm.common import ids_and_texts, small_batches

# The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs of 24 or more
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "entropy")
UNIT = 1 << 20  # entropies are compared as whole numbers


@dataclass(frozen=True)
class CharacterClass:
    """A window of this class has only these characters, some of each of ``wanted``, and at least ``bits`` per character."""

    name: str
    characters: str
    window: int
    bits: float
    wanted: tuple[str, ...] = ()


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("hexadecimal", DIGITS + "abcdef", 20, 3.0, (DIGITS, "abcdef")),
    CharacterClass("upper hexadecimal", DIGITS + "ABCDEF", 20, 3.0, (DIGITS, "ABCDEF")),
    CharacterClass("lower case and digits", DIGITS + LOWER, 20, 3.6, (DIGITS, LOWER)),
    CharacterClass("upper case and digits", DIGITS + UPPER, 20, 3.6, (DIGITS, UPPER)),
    CharacterClass("base64", DIGITS + LOWER + UPPER + "+/=_-", 20, 3.8, (DIGITS, LOWER, UPPER)),
)
#: What is not a secret however random it looks: a candidate that one of these matches is left alone.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID, whole
    r"(?:.*(?:^|[/.]))?(?:www|https?|ftp)[./:].*",  # address
    r".*\.(?:com|org|net|io|de|fr|es|html?|php|png|jpe?g|gif|pdf|css|js)(?:[/=].*)?",  # host or file name
    r"(?i:.*(?:example|placeholder|changeme|your[_-]?(?:key|token|secret)|dummy|redacted).*)",
    r"(?i:.*(?:abcdefghij|0123456789|1234567890|qwertyuiop).*)",
)


def _entropy_terms(most: int) -> list[int]:
    """n * log2(n) for every count, in whole numbers."""
    return [0, *(round(n * log2(n) * UNIT) for n in range(1, most + 1))]


def windows_over(candidate: str, kind: CharacterClass) -> list[tuple[int, int]]:
    """Maximal ranges of the candidate covered by windows of the class whose entropy reaches the bound.

    With counts n of the characters of a window of w, the entropy is log2(w) - sum(n * log2(n)) / w.
    """
    w, terms = kind.window, _entropy_terms(kind.window + 1)
    most = round(w * (log2(w) - kind.bits) * UNIT) + w  # of the sum, whose terms are rounded
    groups = [set(g) for g in kind.wanted]
    inside, found = set(kind.characters), []
    counts: dict[str, int] = {}
    total, start, present = 0, 0, [0] * len(groups)
    for i, c in enumerate(candidate):
        if c not in inside:
            counts, total, start, present = {}, 0, i + 1, [0] * len(groups)
            continue
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += terms[n + 1] - terms[n]
        for k, g in enumerate(groups):
            present[k] += c in g
        if i - start >= w:  # one leaves
            out = candidate[i - w]
            n = counts[out]
            counts[out] = n - 1
            total -= terms[n] - terms[n - 1]
            for k, g in enumerate(groups):
                present[k] -= out in g
        if i - start >= w - 1 and total <= most and all(present):
            low = i - w + 1
            if found and low <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((low, i + 1))
    return found


class SecretScan:
    """The spans of a text. ``classes`` and ``allowed`` are the method's settings; base spans do not depend on them."""

    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> None:
        self.classes, self.least = classes, min((c.window for c in classes), default=1)
        self.candidate = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % self.least)
        self.allowed = [re.compile(a, re.DOTALL) for a in allowed]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end), in order."""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
        found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
        return sorted(found)

    def suspicious(self, text: str) -> tuple[list[tuple[int, int, int]], int]:
        """Spans of high entropy, and how many were suppressed by the allow list."""
        found, suppressed = [], 0
        for m in self.candidate.finditer(text):
            ranges = sorted(r for c in self.classes for r in windows_over(m[0], c))
            joined: list[tuple[int, int]] = []
            for low, high in ranges:
                if joined and low <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(high, joined[-1][1]))
                else:
                    joined.append((low, high))
            if joined and any(a.fullmatch(m[0]) for a in self.allowed):
                suppressed += len(joined)
            else:
                found += [(m.start() + low, 3, m.start() + high) for low, high in joined]
        return found, suppressed

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
        """Base spans, all spans, suppressed ones."""
        base = self.base(text)
        more, suppressed = self.suspicious(text)
        # base spans by start, with the furthest end so far: one pass finds the spans that lie in one
        kept, k, end = [], 0, -1
        for span in more:
            while k < len(base) and base[k][0] <= span[0]:
                end = max(end, base[k][2])
                k += 1
            if span[2] > end:
                kept.append(span)
        return base, sorted(base + kept), suppressed


def printed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: SecretScan | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy, n_suppressed per row of ``df``."""
    scan = scan or SecretScan()
    docs = ids_and_texts(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            made: list[tuple] = []
            for text in batch.column("text"):
                base, spans, suppressed = scan.scan(text.as_py())
                numbers = [sum(s[1] == k for s in base) for k in range(3)]
                made.append((*numbers, hashlib.sha256(printed(base).encode()).hexdigest(), printed(spans), len(spans) - len(base), suppressed))
            columns = list(zip(*made))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:5]),
                 *(pa.array(c, pa.int64()) for c in columns[5:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy", "n_suppressed"])

    return docs.mapInArrow(rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                                 "n_entropy long, n_suppressed long")
