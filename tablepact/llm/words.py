"""Ids of whole texts from the tokenizers library, asked once per distinct word.

Where a tokenizer drops white space and never joins across it, the ids of a text are the ids
of its words one after another. Words stay whole between blanks and line feeds, so anything
else (other white space, special strings) is the library's own affair. Words of Latin letters
skip the library's normalisers, which only lower them, and are asked of its model by stem.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct stems a task remembers; beyond that it starts anew. Results do not depend on it.
REMEMBERED = 600_000
#: Marks that may end a word; none of them is white space, a letter, a number or an apostrophe.
MARKS = ".,;:!?*%&$#|()\""


def byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: itself if it shows, else one past 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordTokenizer:
    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit = remembered
        self.others: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.by_word = self._blanks_divide(model)
        self.by_stem = self.by_word and self._only_lowers(model)
        self.letters = byte_letters()
        self.marks = {"": b""}

    @staticmethod
    def _steps(model: dict, part: str) -> list[dict]:
        step = model.get(part) or {}
        return step.get("pretokenizers") or step.get("normalizers") or [step]

    @classmethod
    def _blanks_divide(cls, model: dict) -> bool:
        """Whether pre-tokenising keeps only matches of a pattern that has no white space."""
        first = cls._steps(model, "pre_tokenizer")[0]
        pattern = (first.get("pattern") or {}).get("Regex", " ")
        stripped = pattern.replace("[^\\s\\p{L}\\p{N}]", "")
        return (first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
                and "\\s" not in stripped and " " not in stripped and "." not in stripped)

    @classmethod
    def _only_lowers(cls, model: dict) -> bool:
        """Whether a word of composed letters meets nothing but lower-casing and byte letters."""
        normal = [s.get("type") for s in cls._steps(model, "normalizer")]
        split, *rest = cls._steps(model, "pre_tokenizer")
        return (normal == ["NFC", "Replace", "Lowercase"] and "[\\p{L}]+" in split["pattern"]["Regex"].split("|")
                and [s.get("type") for s in rest] == ["ByteLevel"] and not rest[0].get("add_prefix_space"))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _stem(self, low: str) -> bytes:
        seen = low if low.isascii() else "".join([self.letters[b] for b in low.encode()])
        ids = self.stems[low] = array("I", [t.id for t in self.library.model.tokenize(seen)]).tobytes()
        return ids

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._ids([mark])[0]
        return self.marks[mark]

    def _distinct(self, words: pa.Array) -> list[bytes]:
        """Ids of words, each stem and each other word asked of the library at most once while it is remembered."""
        if len(self.stems) + len(self.others) > self.limit:
            self.stems.clear()
            self.others.clear()
        found: list[bytes | None] = [None] * len(words)
        left = range(len(words))
        if self.by_stem:
            # words of plain letters, and marks after them, all at once; the pattern splits marks off, so ids stand side by side
            body = pc.utf8_rtrim(words, characters=MARKS)
            plain = pc.and_(pc.string_is_ascii(body), pc.utf8_is_alpha(body)).to_numpy(zero_copy_only=False)
            at, left = np.flatnonzero(plain), np.flatnonzero(~plain).tolist()
            low = pc.utf8_lower(body.take(pa.array(at))).dictionary_encode()
            ids = [self.stems.get(s) or self._stem(s) for s in low.dictionary.to_pylist()]
            for k, stem in zip(at.tolist(), low.indices.to_pylist()):
                found[k] = ids[stem]
            size = pc.binary_length(body).to_numpy(zero_copy_only=False)
            marked = np.flatnonzero(plain & (pc.binary_length(words).to_numpy(zero_copy_only=False) > size))
            for k, w, n in zip(marked.tolist(), words.take(pa.array(marked)).to_pylist(), size[marked].tolist()):
                found[k] += self._mark(w[n:])
        rest = []
        for k, w in zip(left, words.take(pa.array(left, pa.int64())).to_pylist()):
            body = w.rstrip(MARKS)
            if self.by_stem and body.isalpha() and max(body) < "\u0250" and "\u0130" not in body and unicodedata.is_normalized("NFC", body):
                low = body.lower()
                found[k] = (self.stems.get(low) or self._stem(low)) + self._mark(w[len(body):])
            else:
                found[k] = self.others.get(w)
                if found[k] is None:
                    rest.append((k, w))
        for (k, w), ids in zip(rest, self._ids([w for _, w in rest])):
            found[k] = self.others[w] = ids
        return found

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and where those of each text end."""
        if not self.by_word:
            coded = self._ids(texts.to_pylist())
            return np.frombuffer(b"".join(coded), dtype="<u4"), np.cumsum([len(c) // 4 for c in coded], dtype=np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.values.dictionary_encode()
        which = words.indices.to_numpy()
        distinct = self._distinct(words.dictionary)
        size = np.asarray([len(ids) // 4 for ids in distinct], dtype=np.int64)
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(distinct), dtype="<u4")
        sizes = size[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        kind = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
        at = np.arange(ends[-1], dtype=kind) + np.repeat((first[which] - ends[:-1]).astype(kind), sizes)
        return flat[at], ends[split.offsets.to_numpy()[1:]]

    def encode(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """Per text its ids and ``end_id`` as little-endian unsigned 32-bit integers."""
        flat, ends = self.encode_column(texts)
        raw, end, last = flat.tobytes(), int(end_id).to_bytes(4, "little"), 0
        out = []
        for stop in (4 * ends).tolist():
            out.append(raw[last:stop] + end)
            last = stop
        return out
