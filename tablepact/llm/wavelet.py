"""Token ids as wavelet matrices: one succinct file per shard of consecutive documents.

A shard's ids are stored as bit planes, highest bit first; each level keeps its zeros before
its ones. Beside each plane stand the ones before each of its blocks, so one file answers access (the id at a
position), rank (how often an id occurs before a position), select (where its k-th occurrence
is) and whole decoding, without counting bits first.

The file format is Parquet, so it can be written and read wherever Spark can, with Spark's
commit protocol; a row is one matrix of up to ``MATRIX_TOKENS`` ids (or one longer document)
and the bounds of its documents. Every plane and every directory is a column of its own: counting the ids of a range of
vocabulary (a prefix of their bits) reads the upper planes only. Shards are ranges of doc_id, ascending.

Defined results: null and empty texts hold the end id only; null doc_ids come first, rows with
equal doc_id are ordered by text; an empty table gives no files' rows and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.common import ids_and_texts, partitions, shared_dir, small_batches
from tablepact.llm.words import WordTokenizer

END_ID = 2
MATRIX_TOKENS = 1 << 22
BLOCK_BITS = 512


class WaveletMatrix:
    """A sequence of unsigned integers below ``2 ** bits``; of its planes the first ``len(planes)`` are at hand."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: np.ndarray, ones: list[np.ndarray] | None = None) -> None:
        self.n, self.bits, self.planes, self.zeros = n, bits, planes, zeros
        self.ones = [self._directory(p) for p in planes] if ones is None else ones

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of the plane."""
        counts = np.bitwise_count(plane)
        per_block = np.add.reduceat(counts, np.arange(0, len(counts), BLOCK_BITS // 8), dtype=np.int64) if len(counts) else counts
        return np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint64)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        order, planes, zeros = ids.astype(kind), [], []
        for level in range(bits - 1, -1, -1):
            one = (order & kind(1 << level)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            zero = order[~one]
            zeros.append(len(zero))
            order = np.concatenate([zero, order[one]])
        return cls(len(ids), bits, planes, np.asarray(zeros, dtype=np.int64))

    def columns(self) -> dict[str, bytes]:
        """Each plane and each directory as a column of the file."""
        made = {f"plane_{k}": p.tobytes() for k, p in enumerate(self.planes)}
        return made | {f"ones_{k}": o.tobytes() for k, o in enumerate(self.ones)}

    @classmethod
    def of_columns(cls, row: dict) -> WaveletMatrix:
        """From a row of the file; levels whose columns were not read are left out."""
        at_hand = next((k for k in range(row["bits"]) if f"plane_{k}" not in row), row["bits"])
        planes = [np.frombuffer(row[f"plane_{k}"], dtype=np.uint8) for k in range(at_hand)]
        ones = [np.frombuffer(row[f"ones_{k}"], dtype=np.uint64) if f"ones_{k}" in row else np.zeros(0, np.uint64) for k in range(at_hand)]
        return cls(row["n"], row["bits"], planes, np.asarray(row["zeros"], dtype=np.int64), ones)

    def _rank1(self, level: int, at: int) -> int:
        block, rest = divmod(at, BLOCK_BITS)
        part = self.planes[level][block * BLOCK_BITS // 8:(at + 7) // 8]
        if not len(part):
            return int(self.ones[level][block])
        found = int(self.ones[level][block]) + int(np.bitwise_count(part).sum())
        return found - int(np.bitwise_count(part[-1] >> np.uint8(rest % 8))) if rest % 8 else found

    def _ranks1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each of many places: the block's entry, then at most ``BLOCK_BITS / 8`` bytes."""
        plane, block = self.planes[level], at // BLOCK_BITS
        found = self.ones[level][block].astype(np.int64)
        first, whole = block * (BLOCK_BITS // 8), at // 8
        for k in range(BLOCK_BITS // 8):
            byte = first + k
            more = byte < whole
            if not more.any():
                break
            found[more] += np.bitwise_count(plane[byte[more]])
        rest = np.flatnonzero(at % 8)
        found[rest] += np.bitwise_count(plane[whole[rest]] & ((1 << at[rest] % 8) - 1).astype(np.uint8))
        return found

    def ranks(self, value: int, ends: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Occurrences of ``value`` before each of many places; with ``levels``, of the ids that share its first bits."""
        at = np.asarray(ends, dtype=np.int64)
        if value >> self.bits:
            return np.zeros(len(at), dtype=np.int64)
        start = np.zeros(1, dtype=np.int64)
        for level in range(self.bits if levels is None else levels):
            s, e = self._ranks1(level, start), self._ranks1(level, at)
            if value >> (self.bits - 1 - level) & 1:
                start, at = int(self.zeros[level]) + s, int(self.zeros[level]) + e
            else:
                start, at = start - s, at - e
        return at - start

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at // 8] >> (at % 8) & 1)

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self._rank1(level, at)
            value = value << 1 | bit
            at = int(self.zeros[level]) + ones if bit else at - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        start = 0
        for level in range(self.bits):
            s, e = self._rank1(level, start), self._rank1(level, end)
            if value >> (self.bits - 1 - level) & 1:
                start, end = int(self.zeros[level]) + s, int(self.zeros[level]) + e
            else:
                start, end = start - s, end - e
        return start, end

    def rank(self, value: int, end: int | None = None) -> int:
        """Occurrences of ``value`` before ``end``."""
        if value >> self.bits:
            return 0
        start, stop = self._range(value, self.n if end is None else end)
        return stop - start

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence, counted from 0; -1 if there are fewer."""
        if value >> self.bits or not 0 <= k < self.rank(value):
            return -1
        at = self._range(value, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            zeros = int(self.zeros[level])
            at = self._nth(level, at - zeros, True) if value >> (self.bits - 1 - level) & 1 else self._nth(level, at, False)
        return at

    def _nth(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th one (or zero) of a plane: by block, then within it."""
        ones = self.ones[level]
        before = ones.astype(np.int64)
        before = before if one else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = self.planes[level][block * BLOCK_BITS // 8:(block + 1) * BLOCK_BITS // 8]
        bits = np.unpackbits(part, bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All values, from the lowest level up: each level's zeros and ones go back to where they stood."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros, below = int(self.zeros[level]), out
            out = np.empty(self.n, dtype=kind)
            out[~one] = below[:zeros]
            out[one] = below[zeros:] | kind(1 << (self.bits - 1 - level))
        return out


def write_matrices(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = END_ID, matrix_tokens: int = MATRIX_TOKENS) -> None:
    """Tokenise ``df`` and write its shards, one file each, below ``path``."""
    docs = ids_and_texts(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    bits = max(1, int(WordTokenizer(tokenizer_path).library.get_vocab_size(with_added_tokens=True) - 1).bit_length())
    levels = ", ".join(f"{part}_{k} binary" for part in ("plane", "ones") for k in range(bits))
    schema = f"shard int, block int, n long, bits int, zeros array<long>, doc_ids array<{kind}>, lengths array<long>, {levels}"

    def matrix(shard: int, block: int, owners: list, of: pa.DataType, coded: list[bytes]) -> pa.RecordBatch:
        lengths = [len(c) // 4 for c in coded]
        made = WaveletMatrix.build(np.frombuffer(b"".join(coded), dtype="<u4"), bits)
        one = lambda x, t: pa.array([x], t)
        owner, columns = pa.array(owners, of), made.columns()
        return pa.RecordBatch.from_arrays(
            [one(shard, pa.int32()), one(block, pa.int32()), one(made.n, pa.int64()), one(bits, pa.int32()),
             one(made.zeros.tolist(), pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(owner)], pa.int32()), owner),
             one(lengths, pa.list_(pa.int64())), *(one(c, pa.binary()) for c in columns.values())],
            names=["shard", "block", "n", "bits", "zeros", "doc_ids", "lengths", *columns])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer_path)
        shard, block, held, owners, coded = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in small_batches(batches, limit=16 << 20):
            of = batch.schema.field("doc_id").type
            for owner, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text"), end_id)):
                if held and held + len(ids) // 4 > matrix_tokens:
                    yield matrix(shard, block, owners, of, coded)
                    block, held, owners, coded = block + 1, 0, [], []
                owners.append(owner)
                coded.append(ids)
                held += len(ids) // 4
        if held:
            yield matrix(shard, block, owners, of, coded)

    ranges = docs.repartitionByRange(partitions(df.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ranges.mapInArrow(build, schema).write.option("compression", "snappy").parquet(path)


def read_matrices(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def matrix_of(row) -> WaveletMatrix:
    return WaveletMatrix.of_columns(row)


def _levels(matrices: DataFrame, *parts: str, levels: int | None = None) -> list[str]:
    """The columns of the first ``levels`` planes and (or) directories."""
    return [c for c in matrices.columns if c.partition("_")[0] in parts and (levels is None or int(c.partition("_")[2]) < levels)]


def occurrences(matrices: DataFrame, token_ids: list[int], levels: int | None = None) -> DataFrame:
    """shard, block, token_id, n: counted by rank, without decoding. With ``levels``, ids that share the token's first
    so many bits are counted together, and only so many planes are read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = matrix_of(row)
                yield pa.RecordBatch.from_pylist(
                    [{"shard": row["shard"], "block": row["block"], "token_id": t, "n": int(made.ranks(t, [made.n], levels)[0])} for t in token_ids],
                    schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("token_id", pa.int64()), ("n", pa.int64())]))

    read = _levels(matrices, "plane", "ones", levels=levels)
    return matrices.select("shard", "block", "n", "bits", "zeros", *read).mapInArrow(count, "shard int, block int, token_id long, n long")


def ids_of(matrices: DataFrame, doc_ids: list) -> DataFrame:
    """doc_id, place, id of the stated documents, by access: their matrices are read, nothing is decoded."""
    kind = matrices.schema["doc_ids"].dataType.elementType.simpleString()

    def access(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.schema.field("doc_ids").type.value_type
            for row in batch.to_pylist():
                made, end = matrix_of(row), 0
                for owner, length in zip(row["doc_ids"], row["lengths"]):
                    if owner in doc_ids:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([owner] * length, of), pa.array(range(length), pa.int64()),
                             pa.array([made.access(end + k) for k in range(length)], pa.int64())], names=["doc_id", "place", "id"])
                    end += length

    asked = matrices.filter(F.arrays_overlap("doc_ids", F.array(*(F.lit(d).cast(kind) for d in doc_ids))))
    return asked.select("n", "bits", "zeros", "doc_ids", "lengths", *_levels(matrices, "plane", "ones")).mapInArrow(
        access, f"doc_id {kind}, place long, id long")


def documents_of(matrices: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32 (of the decoded ids) and n_end_ids (how often it holds
    the end id, by rank)."""
    kind = matrices.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"shard int, block int, doc_id {kind}, local long, n_tokens long, ids_crc32 long, n_end_ids long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c not in ("doc_ids", "lengths")}
                made = matrix_of(row)
                ids = made.decode().astype("<u4").tobytes()
                owners = batch.column("doc_ids")[k].values
                lengths = np.asarray(batch.column("lengths")[k].values)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(owners), row[c], dtype=np.int32)) for c in ("shard", "block")]
                    + [owners, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()),
                       pa.array(np.diff(made.ranks(end_id, ends), prepend=0))],
                    names=["shard", "block", "doc_id", "local", "n_tokens", "ids_crc32", "n_end_ids"])

    # one number per shard, then one per matrix: the files' bounds, not the documents
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    of_shard = matrices.groupBy("shard").agg(F.sum("n").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of_block = matrices.select("shard", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("block_start"))
    starts = of_block.join(of_shard, "shard").select(
        "shard", "block", (F.col("shard_start") + F.col("block_start")).alias("first"))
    return matrices.mapInArrow(decode, schema).join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "n_end_ids")


def round_trip(df: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the files below the shared folder and read the documents back from them."""
    path = shared_dir(df.sparkSession, "wavelet")
    write_matrices(df, path, tokenizer_path, **options)
    return documents_of(read_matrices(df.sparkSession, path))
