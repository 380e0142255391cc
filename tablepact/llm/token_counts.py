"""Exact token counts of texts of any length, by chunks that resynchronise.

A long text is encoded in overlapping chunks. Greedy pair merging is local: a token sequence
is the encoding of a text exactly when each two neighbouring tokens are the encoding of their
concatenation. So where two chunks hold the same tokens at the same offsets, the first chunk
up to there and the second from there on are the encoding of the whole: every neighbouring
pair of the splice stands in one of the two encodings. Here a run of common tokens longer
than twice the longest piece is asked for; where a seam has none, the overlap is widened,
at worst until the chunks are one.

Defined results: null and empty texts have no bytes and no tokens; repeated rows and rows
without an id each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tablepact.llm.common import ids_and_texts, small_batches

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 512
TOKEN_LIMIT = 4096


class ChunkedEncoder:
    """A sentencepiece model with the offsets of its tokens."""

    def __init__(self, model_path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # characters a token stands for; of the bytes of a character, its first one stands for it
        self.chars = np.array([self._chars(i, p) for i, p in enumerate(pieces)], dtype=np.int64)
        self.longest = int(self.chars.max())
        self.widened = 0

    def _chars(self, i: int, piece: str) -> int:
        if self.model.is_byte(i):
            return int(int(piece[3:5], 16) & 0xC0 != 0x80)
        return 0 if self.model.is_control(i) else len(piece)

    def encode_chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and start offsets (in the whole text) of one chunk; None where offsets don't add up."""
        ids = np.asarray(self.model.encode(text[start:end]), dtype=np.int64)
        ends = np.cumsum(self.chars[ids])
        # the model sets one blank before every text: offsets start one character early
        if end > start and (not len(ids) or ends[-1] != end - start + 1):
            return None
        return ids, start - 1 + ends - self.chars[ids]

    def encode(self, text: str) -> np.ndarray:
        """The ids of the whole text."""
        n = len(text)
        if n <= self.chunk:
            return np.asarray(self.model.encode(text), dtype=np.int64)
        done: list[np.ndarray] = []
        end = self.chunk
        first = self.encode_chunk(text, 0, end)
        if first is None:
            return np.asarray(self.model.encode(text), dtype=np.int64)
        ids, at = first
        floor = -1  # the tail is spliced after this offset
        while end < n:
            overlap = self.overlap
            while True:
                start = max(0, end - overlap)
                stop = min(n, start + max(self.chunk, 2 * overlap))
                following = self.encode_chunk(text, start, stop)
                seam = None if following is None else self.common(ids, at, *following, start, floor)
                if seam is not None:
                    i, j = seam
                    done.append(ids[:i])
                    ids, at = following[0][j:], following[1][j:]
                    floor, end = int(at[0]), stop
                    break
                self.widened += 1
                if start <= max(floor, 0):  # nothing proven in all of the tail: take it whole, and longer
                    stop = min(n, end + max(self.chunk, overlap))
                    whole = self.encode_chunk(text, 0, stop)
                    if stop >= n or whole is None:
                        return np.asarray(self.model.encode(text), dtype=np.int64)
                    done, (ids, at), floor, end = [], whole, -1, stop
                    break
                overlap *= 4
        return np.concatenate([*done, ids])

    def common(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray,
               start: int, floor: int) -> tuple[int, int] | None:
        """Where in both sequences the longest run of equal tokens at equal offsets has its middle."""
        lo = int(np.searchsorted(a_at, max(start, floor), side="right"))
        # bytes of one character share an offset; only the last token at an offset is matched
        at_a, at_b = a_at[lo:], b_at
        both, i, j = np.intersect1d(at_a, at_b, return_indices=True)
        keep = both > max(start, floor)
        i, j = i[keep] + lo, j[keep]
        if not len(i):
            return None
        same = a[i] == b[j]
        # a run breaks where tokens differ or one sequence has a boundary the other lacks
        joined = np.r_[False, (np.diff(i) == 1) & (np.diff(j) == 1)]
        run = np.cumsum(~(same & joined & np.r_[False, same[:-1]]))
        best = None
        for k in np.unique(run[same]):
            at = np.flatnonzero((run == k) & same)
            width = int(a_at[i[at[-1]]] - a_at[i[at[0]]])
            if width > 2 * self.longest and (best is None or width > best[0]):
                best = width, at[len(at) // 2]
        return None if best is None else (int(i[best[1]]), int(j[best[1]]))


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = TOKEN_LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row; tasks hold one chunk's offsets at a time."""
    docs = ids_and_texts(df, id_col, text_col)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkedEncoder(model_path, chunk, overlap)
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            n = np.zeros(len(texts), dtype=np.int64)
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            for k, ids in zip(short, encoder.model.encode([texts[k] for k in short], num_threads=1)):
                n[k] = len(ids)
            for k in set(range(len(texts))) - set(short):
                n[k] = len(encoder.encode(texts[k]))
            size = pc.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(counts, schema)
