"""Byte-level BPE whose pre-tokenising is array work: no regular expression runs.

Texts of a batch are joined to one array of code points, each mapped to a symbol of a small
automaton (letter, number, other, kinds of white space, apostrophes with their contraction
already looked up). Reading a symbol is a function from state to state; composing functions
is associative, so a text of any length is cut into blocks whose functions are composed side
by side, block results are scanned by doubling, and a second sweep gives the state before
every character and with it the token boundaries. The slices between boundaries are looked
up in a cache of merged pairs; ids keep their byte offsets, and decoding joins the bytes.

Defined results: null and empty texts have no tokens; texts of any length are read whole;
repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from tablepact.llm.common import ids_and_texts, small_batches

# White space, and the endings split off after an apostrophe.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, LAST_WHITE, WHITE_RUN, RESET = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_BLANK, TWO_LEFT, ONE_LEFT = range(8)
STATES = 8
CACHED = 600_000
SHORT_PIECE = 48
UNKNOWN = 1 << 62


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a token starts, by symbol and state."""
    to = np.zeros((9, STATES), dtype=np.uint8)
    starts = np.ones((9, STATES), dtype=bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (SHORT, ONE_LEFT),
                          (LONG, TWO_LEFT), (BLANK, AFTER_BLANK), (LAST_WHITE, FRESH), (WHITE_RUN, IN_WHITE)):
        to[symbol] = state
    # a run goes on, and a blank belongs to the run it precedes
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        starts[symbol, [run, AFTER_BLANK]] = False
    # an apostrophe inside a run of others, or after a blank, is an ordinary character
    for symbol in (SHORT, LONG):
        to[symbol, [IN_OTHER, AFTER_BLANK]] = IN_OTHER
        starts[symbol, [IN_OTHER, AFTER_BLANK]] = False
    # the letters of a contraction
    to[LETTER, TWO_LEFT], to[LETTER, ONE_LEFT] = ONE_LEFT, FRESH
    starts[LETTER, [TWO_LEFT, ONE_LEFT]] = False
    starts[WHITE_RUN, IN_WHITE] = False
    to[RESET] = FRESH
    return to, starts


def _of_category(category: str, characters: str) -> np.ndarray:
    """The code points of a Unicode category in the library's edition: with a pattern of one character and a token for
    every byte, encoding all characters gives the bytes of those that match."""
    probe = tiktoken.Encoding("category", pat_str=category, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
    found = bytes(probe.encode_ordinary(characters)).decode()
    return np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Symbol of every code point, before its neighbours are looked at; what is a letter or a number differs between
    editions of Unicode, and Python's own may be older than the library's."""
    kinds = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    characters = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    for category, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        kinds[_of_category(category, characters)] = kind
    kinds[list(WHITE)] = WHITE_RUN
    return kinds


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The automaton's symbols; ``ends`` marks the separator after each text."""
    kinds = classes()[codes]
    kinds[ends] = RESET
    after = np.append(kinds[1:], RESET)
    # the last white character before something else stands alone or joins it; at a text's end the run is whole
    last = (kinds == WHITE_RUN) & (after != WHITE_RUN) & (after != RESET)
    kinds[last] = np.where(codes[last] == 0x20, BLANK, LAST_WHITE)
    mark = np.flatnonzero((codes == 0x27) & ~ends)
    if len(mark):
        padded = np.concatenate([codes, [0, 0]])
        held = np.concatenate([ends, [True, True]])
        one, two = padded[mark + 1], padded[mark + 2]
        free = ~held[mark + 1]
        short = free & np.isin(one, [ord(e) for e in ENDINGS if len(e) == 1])
        long = np.zeros(len(mark), dtype=bool)
        for e in ENDINGS:
            if len(e) == 2:
                long |= free & ~held[mark + 2] & (one == ord(e[0])) & (two == ord(e[1]))
        kinds[mark[long]] = LONG
        kinds[mark[short]] = SHORT
    return kinds


def states_before(kinds: np.ndarray, block: int = 512) -> np.ndarray:
    """The state before each symbol, by a scan over composed transition functions."""
    to, _ = transitions()
    n = len(kinds)
    blocks = -(-n // block)
    padded = np.full(blocks * block, RESET, dtype=np.uint8)
    padded[:n] = kinds
    rows = np.ascontiguousarray(padded.reshape(blocks, block).T)
    # each block as one function: where every state leads
    led = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (blocks, STATES)).copy()
    for column in rows:
        led = to[column[:, None], led]
    # prefix composition of the blocks' functions by doubling
    step = 1
    while step < blocks:
        led[step:] = np.take_along_axis(led[step:], led[:-step], axis=1)
        step *= 2
    state = np.concatenate([[FRESH], led[:-1, FRESH]]).astype(np.uint8)
    found = np.empty((block, blocks), dtype=np.uint8)
    for k, column in enumerate(rows):
        found[k] = state
        state = to[column, state]
    return found.T.reshape(-1)[:n]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by separators, where tokens start, and which starts are separators."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.zeros(len(codes), dtype=bool)
    ends[np.cumsum([len(t) + 1 for t in texts]) - 1] = True
    kinds = symbols(codes, ends)
    _, starts = transitions()
    at = np.flatnonzero(starts[kinds, states_before(kinds)])
    return joined, at, ends[at]


class BytePairs:
    """Ranks of byte sequences, with a cache of merged slices."""

    def __init__(self, ranks: dict[bytes, int], cached: int = CACHED) -> None:
        self.ranks, self.cached = ranks, cached
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, cached: int = CACHED) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, cached)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is known; n log n by a heap."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self._merge_short(piece) if len(piece) <= SHORT_PIECE else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        rank = self.ranks.get
        cut = list(range(len(piece) + 1))  # bounds of the parts
        pair = [rank(piece[k:k + 2], UNKNOWN) for k in range(len(piece) - 1)]
        while pair and (best := min(pair)) != UNKNOWN:
            k = pair.index(best)
            del cut[k + 1], pair[k]
            if k < len(pair):
                pair[k] = rank(piece[cut[k]:cut[k + 2]], UNKNOWN)
            if k:
                pair[k - 1] = rank(piece[cut[k - 1]:cut[k + 1]], UNKNOWN)
        return [self.ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        start, end = list(range(n)), list(range(1, n + 1))  # by first byte of a part
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(a: int) -> None:
            b = after[a]
            if b >= 0 and (rank := self.ranks.get(piece[a:end[b]])) is not None:
                heap.append((rank, a, end[b])) if not ready else heapq.heappush(heap, (rank, a, end[b]))

        ready = False
        for a in start:
            offer(a)
        heapq.heapify(heap)
        ready = True
        alive = [True] * n
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = after[a] if alive[a] else -1
            if b < 0 or end[b] != stop:
                continue  # one of the two has been merged meanwhile
            alive[b] = False
            end[a], after[a] = stop, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a >= 0:
            out.append(self.ranks[piece[a:end[a]]])
            a = after[a]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        joined, at, ends = boundaries(texts)
        stops = np.append(at[1:], len(joined)).tolist()
        slices = [joined[a:b] for a, b in zip(at.tolist(), stops)]
        fresh = set(slices) - self.known.keys()
        if len(self.known) + len(fresh) > self.cached:
            self.known.clear()
            fresh = set(slices)
        for s in fresh:
            self.known[s] = np.asarray(self.merge(s.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
        known = self.known
        out, a = [], 0
        for b in np.flatnonzero(ends).tolist():
            out.append(b"".join([known[s] for s in slices[a:b]]))
            a = b + 1
        return out

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of every id, and the length of the text last."""
        lengths = [len(self.bytes_of[i]) for i in np.frombuffer(ids, dtype="<u4").tolist()]
        return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def encode_documents(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and byte offsets."""
    docs = ids_and_texts(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
              + ", ids array<int>, offsets array<long>" * with_ids)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = BytePairs.load(ranks_path)
        for batch in small_batches(batches):
            coded = pairs.encode(batch.column("text").to_pylist())
            out = [batch.column("doc_id"), pa.array([len(c) // 4 for c in coded], pa.int64()),
                   pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                   pa.array([hashlib.sha256(pairs.decode(c)).hexdigest() for c in coded], pa.string())]
            if with_ids:
                out += [pa.array([np.frombuffer(c, dtype="<i4") for c in coded], pa.list_(pa.int32())),
                        pa.array([pairs.offsets(c) for c in coded], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=schema_names)

    schema_names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "offsets"] * with_ids
    return docs.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text from the ids of ``encode_documents``."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = BytePairs.load(ranks_path)
        for batch in batches:
            texts = [pairs.decode(np.asarray(ids, dtype="<u4").tobytes()).decode("utf-8", "replace")
                     for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")
