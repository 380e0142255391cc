"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles. For sampling, each is labelled with its occurrence
number, so a text holds every labelled shingle once. A sketch samples the ``PICKED`` smallest of them under
one hash function and keeps them in text order: two sketches agree when the same shingles are
smallest *and* stand in the same order, which follows edit similarity. ``SKETCHES`` sketches
are the bands; at a similarity of 0.8 all of them differ with a probability below 1e-6 where no
passage repeats (an edit moves the later labels of a repeated one, which can change their order).

Candidates are verified by aligning the two shingle sequences, without labels, within the band that
a similarity of ``threshold`` allows: the longest common subsequence against all shingles of both
(in order, so a reordered text is not the same). One minus this similarity is a metric. Labelled
shingles that two texts share are their shingles in common, repeats counted: no alignment has more
of them, so counts of labelled shingles bound the similarity.

No bucket is expanded into its pairs. Equal texts are one node. Every bucket links its members
to one head; the members that stay apart from it meet in cells of bounded size by what tells them
from the head (see ``_members_of_cells``), where lengths and parities of the shingles leave few pairs to align. The number of
steps does not depend on the data. Classes are connected components by alternating stars, so a
class of any size is a matter of rounds, not of one task.

Words are lower case without sentence marks. Defined results: null texts, empty ones and others
without a word are equal texts, one class; texts of fewer than
five words are one shingle; texts of any length are read whole; repeated rows are one class
(the smallest doc_id names it; a class without any doc_id has none);
an empty table gives an empty result; other columns stay as they are in ``keep_one``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablepact.llm.common import arrow_rows, ids_and_texts, lists_of, packed_rows, small_batches, stored, text_of, unpacked_rows

SHINGLE_WORDS = 5
PICKED = 3
SKETCHES = 20
THRESHOLD = 0.8
BLOCK_WORDS = 1 << 18
MEETINGS = 4  # equal shingles of two texts to each of their shingles, above which they are aligned by bits
WIDE = 1 << 13
CELL_ROWS = 1 << 12  # members of a head that a task compares at once by their parities; it decides the plan only
BITS = 1 << 11
SKETCHED = 1 << 18  # hashes computed at once
BATCH_TEXTS = 1 << 10
PARTNERS = 1 << 11
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
MARKS = ".,;:!?\"()"
SEED = 0x5EED


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_codes(text):
    """Hashes of a text's words, as a native expression."""
    words = F.array_remove(F.split(F.translate(F.lower(text), MARKS, ""), BLANK_RUN), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(codes: np.ndarray) -> np.ndarray:
    """One hash per shingle, in text order."""
    codes = codes.view(np.uint64)
    n = len(codes) - SHINGLE_WORDS + 1
    if n <= 0:
        codes, n = np.concatenate([codes, np.zeros(SHINGLE_WORDS - len(codes), dtype=np.uint64)]), 1
    shingle = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE_WORDS):
        shingle = _mixed(shingle * np.uint64(31) + codes[k:k + n] + np.uint64(k))
    return shingle


def labelled(shingle: np.ndarray) -> np.ndarray:
    """One distinct hash per shingle occurrence, in text order."""
    n = len(shingle)
    order = np.argsort(shingle, kind="stable")
    ordered = shingle[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if new.all():
        return shingle
    place = np.arange(n)
    number = np.empty(n, dtype=np.uint64)
    number[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return _mixed(shingle + number * np.uint64(0x9E3779B97F4A7C15))


def order_sketches(labels: np.ndarray) -> np.ndarray:
    """One key per sketch: its smallest labelled shingles in text order."""
    factors = _mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) + np.uint64(SEED)) | np.uint64(1)
    picked = min(PICKED, len(labels))
    keys = np.empty(SKETCHES, dtype=np.uint64)
    step = max(1, SKETCHED // len(labels))  # bounded memory for very long texts
    for low in range(0, SKETCHES, step):
        some = factors[low:low + step, None]
        hashed = _mixed(labels[None, :] * some)
        at = np.argpartition(hashed, picked - 1, axis=1)[:, :picked] if picked < len(labels) else \
            np.broadcast_to(np.arange(picked), (len(some), picked)).copy()
        at.sort(axis=1)  # text order
        key = np.zeros(len(some), dtype=np.uint64)
        for k in range(picked):
            key = _mixed(key * np.uint64(31) + labels[at[:, k]])
        keys[low:low + step] = _mixed(key + np.arange(low, low + len(some), dtype=np.uint64))
    return keys


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two shingle sequences, exact from ``threshold`` on; otherwise some number below it."""
    n, m = len(a), len(b)
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        places.setdefault(x, []).append(j)
    counts = Counter(x for x in a.tolist() if x in places)
    both = sum(min(k, len(places[x])) for x, k in counts.items())
    bound = both / (n + m - both)
    if bound < threshold:
        return bound
    # to reach the threshold, at most so many shingles stand alone: wider shifts cannot take part
    band = int((n + m) * (1 - threshold) / (1 + threshold)) + 1
    if sum(k * len(places[x]) for x, k in counts.items()) > MEETINGS * (n + m):
        common = _common_by_bits(a.tolist(), b.tolist(), band)
        return common / (n + m - common)
    tails: list[int] = []  # longest increasing run of places; those of one shingle from the last to the first
    for i, x in enumerate(a.tolist()):
        for j in reversed(places.get(x, ())):
            if -band <= i - j <= band:
                k = bisect_left(tails, j)
                tails[k:k + 1] = [j]
    return len(tails) / (n + m - len(tails))


def _common_by_bits(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence within the band, for sequences of often repeated values.

    Bits of one number stand for ``WIDE`` places of ``b``: 0 where the length grows by one there. A
    block of places takes the rows of ``a`` within the band, and hands the carries to its right neighbour.
    """
    carries, first, left = [], 0, 0  # carries of the block to the left from its row ``first`` on; the length at its right edge there
    for low in range(0, len(b), WIDE):
        some = b[low:low + WIDE]
        width, masks = len(some), {}
        for j, x in enumerate(some):
            masks[x] = masks.get(x, 0) | 1 << j
        full, start = (1 << width) - 1, max(0, low - band)
        left += sum(carries[:max(0, start - first)])
        carries = carries[max(0, start - first):]
        rows, made, bits = a[start:low + width + band], [], full
        for i, x in enumerate(rows):
            mask = masks.get(x, 0)
            carry = carries[i] if i < len(carries) else 0
            if mask or carry:
                total = bits + (bits & mask) + carry
                bits, carry = (total | (bits & ~mask)) & full, total >> width
            made.append(carry)
        length = left + sum(carries) + width - bits.bit_count()
        carries, first = made, start
    return length


BLOCKS = "block long, rows binary, doc_ids array<{kind}>, marks array<long>, digests array<binary>, keys array<array<long>>"
ROW_BITS = 16  # a node is a block's number and a row in it


def blocks(docs: DataFrame) -> DataFrame:
    """Word hashes packed by block, with the digest and the sketches of each text (none without words)."""
    coded = docs.select("doc_id", F.xxhash64("text").alias("mark"), word_codes(F.col("text")).alias("codes"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for batch in small_batches(batches, "codes", BLOCK_WORDS, 1 << ROW_BITS):
            digests, keys = [], []
            for own in lists_of(batch.column("codes")):
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                keys.append(order_sketches(labelled(shingles(own))).view(np.int64).tolist() if len(own) else [])
            one = lambda x, t: pa.array([x], t)
            ids, ends = batch.column("doc_id"), pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [one(block, pa.int64()), one(packed_rows(batch.select(["codes"])), pa.binary()),
                 pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, batch.column("mark")),
                 one(digests, pa.list_(pa.binary())), one(keys, pa.list_(pa.list_(pa.int64())))],
                names=["block", "rows", "doc_ids", "marks", "digests", "keys"])
            block += 1

    return coded.mapInArrow(sketch, BLOCKS.format(kind=kind))


def fetched(packed: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, codes of the given nodes: requests go to their blocks, only what is asked for comes back."""
    requests = nodes.select(F.shiftright("node", ROW_BITS).alias("block"), "node").groupBy("block").agg(
        F.collect_list("node").alias("nodes"))  # no more than a block has rows

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                nodes = batch.column("nodes")[k].values
                at = pc.bit_wise_and(nodes, (1 << ROW_BITS) - 1)
                codes = unpacked_rows(batch.column("rows")[k].as_py()).column("codes").take(at)
                yield pa.RecordBatch.from_arrays([nodes, codes], names=["node", "codes"])

    texts = packed.select("block", "rows").join(requests, "block").select("rows", "nodes")
    return stored(texts.mapInArrow(take, "node long, codes array<long>"), "near-texts", compression="zstd")


def _pairs_with_texts(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b and others) with of_a and of_b, the codes of both.

    Texts are never grouped by node: a text with many partners is sent to as many parts of them as
    it takes for none to hold more than ``PARTNERS``.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    # dealt to its parts while it is narrow: no task gets all texts that one text is compared with
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.hash("b"), "parts")).drop("parts")
    of_b = dealt.join(texts.select(F.col("node").alias("b"), F.col("codes").alias("of_b")), "b")
    of_a = texts.select(F.col("node").alias("a"), F.col("codes").alias("of_a")).join(parts, "a").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return of_b.join(of_a.drop("parts"), ["a", "part"])


def parity(labels: np.ndarray) -> bytes:
    """``BITS`` parities of the labelled shingles by their hashes: what two of them differ in, their shingles do, too."""
    counts = np.bincount((_mixed(labels) % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def against_heads(texts: DataFrame, tested: DataFrame, threshold: float) -> DataFrame:
    """Every member b with its head a: similarity, shingles of both, the parities of b's labelled shingles, how many of
    them only one of both has, and (where ``crowded``) which."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, bits, differ, differing, held, head, labels = [], [], [], [], [], None, None, None
            wanted = batch.column("crowded").to_pylist()
            for x, y, listed in zip(lists_of(batch.column("of_a")), lists_of(batch.column("of_b")), wanted):
                if held is None or not np.array_equal(held, x):
                    held, head = x, shingles(x)
                    labels = labelled(head)
                own = shingles(y)
                marks = labelled(own)
                apart = np.setxor1d(marks, labels, assume_unique=True)
                found.append(aligned(head, own, threshold))
                sizes.append((len(head), len(own)))
                bits.append(parity(marks))
                differ.append(len(apart))
                differing.append(apart.view(np.int64) if listed else None)
            n, m = zip(*sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(found, pa.float64()), pa.array(n, pa.int64()),
                 pa.array(m, pa.int64()), pa.array(bits, pa.binary()), pa.array(differ, pa.int64()),
                 pa.array(differing, pa.list_(pa.int64()))],
                names=["a", "b", "similarity", "n_a", "n_b", "bits", "n_apart", "apart"])

    schema = "a long, b long, similarity double, n_a long, n_b long, bits binary, n_apart long, apart array<long>"
    both = _pairs_with_texts(texts, tested).select("a", "b", "crowded", "of_a", "of_b")
    return stored(both.mapInArrow(align, schema), "near-scores", compression="zstd")


def similar(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose alignment reaches the threshold."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, head, good = None, None, []
            for x, y in zip(lists_of(batch.column("of_a")), lists_of(batch.column("of_b"))):
                if held is None or not np.array_equal(held, x):
                    held, head = x, shingles(x)
                good.append(aligned(head, shingles(y), threshold) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = _pairs_with_texts(texts, pairs).select("a", "b", "of_a", "of_b")
    return stored(both.mapInArrow(align, "a long, b long"), "near-links")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root), root being the smallest node of the component; nodes with an edge only.

    Alternating stars: every node's larger neighbours go to its smallest neighbour, then every
    node's smaller neighbours do; stops when nothing changes.
    """
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(),
                   "near-edges")
    before = _sameness(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))) \
            .filter("u <> v").distinct()
        made = stored(small, "near-edges")
        after = _sameness(made)
        if after == before:
            return made.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges, before = made, after


def _sameness(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_roots(rows: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias(name)), node, "left") \
        .withColumn(name, F.coalesce(name, node))


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The roots after further links: only roots are joined anew, members follow theirs."""
    met = _with_roots(_with_roots(more, roots, "a", "root_a"), roots, "b", "root_b")
    made = components(met.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    moved = roots.join(made.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
    moved = moved.select("node", F.coalesce("above", "root").alias("root"))
    return stored(moved.unionByName(made), "near-roots")


def _members_of_cells(scored: DataFrame, threshold: float, cell_rows: int) -> DataFrame:
    """cell, node, n, class, of_class, bits, left, right: every pair of members of one head that may still be similar has a
    cell in which one of both is left and the other right, and no cell has more than a few times ``cell_rows`` rows.

    Similar texts are in the same class of lengths or in neighbouring ones, so a member is in the
    groups of its own class and of the next. Small groups are one cell. In larger ones, let a member be
    ``apart`` from the head by the labelled shingles that only one of both has. Two members differ by what only one
    of them is apart by. Of ``n`` shingles at most ``n * (1 - threshold) / threshold`` may differ, so (prefix filtering)
    similar members share one of so many and one of those they are apart by, rarest first: a cell for each of these.
    That fails only where nothing need be shared, for members that have nearly all of the head's
    shingles in another order: these few meet all members close to the head.
    """
    share = (1 - threshold) / (1 + threshold)
    base = -float(np.log(threshold)) * (1 + 1e-9)
    scored = scored.withColumn("class", F.floor(F.log("n") / base)).withColumn("of_class", F.explode(F.array("class", F.col("class") + 1)))
    groups = scored.groupBy("head", "of_class").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high"))
    groups = stored(groups.filter("low <> high").select("head", "of_class", "rows"), "near-groups")
    columns = ["cell", "node", "n", "class", "of_class", "bits", "left", "right"]
    both = (F.lit(True).alias("left"), F.lit(True).alias("right"))
    small = scored.join(groups.filter(F.col("rows") <= cell_rows), ["head", "of_class"]).select(
        F.xxhash64("head", "of_class").alias("cell"), *columns[1:6], *both)
    if groups.filter(F.col("rows") > cell_rows).isEmpty():
        return small

    large = stored(scored.join(groups.filter(F.col("rows") > cell_rows), ["head", "of_class"]), "near-large", compression="zstd")
    most = F.col("n") * ((1 - threshold) / threshold) + 1e-6  # what a similar text may differ by
    own = ["head", "of_class", "node"]
    single = large.select(*own, F.explode("apart").alias("label")).withColumn("cell", F.xxhash64("head", "of_class", "label"))
    often = single.groupBy("cell").agg(F.count("*").alias("times")).filter("times > 1")
    common = single.join(often, "cell").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("times", "cell"))).alias("common"))
    taken = F.floor(most) + 1 - (F.col("n_apart") - F.size("common"))  # those that no other member has come first
    prefix = large.join(common, own).withColumn("at", F.explode(F.slice("common", 1, F.greatest(taken, F.lit(0)).cast("int"))))
    parts = F.ceil(F.col("at.times") / cell_rows).cast("int")
    dealt = prefix.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.select(F.xxhash64("at.cell", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), *columns[1:6],
                         (F.col("part") <= F.col("other")).alias("left"), (F.col("part") >= F.col("other")).alias("right"))

    is_open = (F.col("similarity") < threshold) & (F.col("root") != F.col("head_root"))
    moved = large.filter(is_open & (F.col("n_apart") <= share * (F.col("n_head") + F.col("n")) + 1e-6))
    close = large.filter(F.col("n_apart") <= most)
    blocks_of = lambda rows, name: rows.groupBy("head", "of_class").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias(name))
    of_both = blocks_of(moved, "x").join(blocks_of(close, "y"), ["head", "of_class"])
    sides = []
    for rows, mine, other in ((moved, "x", "y"), (close, "y", "x")):
        side = rows.join(of_both, ["head", "of_class"]).withColumn(mine, F.pmod(F.xxhash64("node"), mine).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        sides.append(side.select(F.xxhash64("head", "of_class", F.lit("moved"), "x", "y").alias("cell"), *columns[1:6],
                                 F.lit(mine == "x").alias("left"), F.lit(mine == "y").alias("right")))
    return small.unionByName(cells).unionByName(sides[0]).unionByName(sides[1])


def _of_a_cell(rows: pa.Table, threshold: float, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a cell that lengths and parities allow and that have different roots; or one for each right row."""
    node, root, n, cls = (rows.column(c).to_numpy() for c in ("node", "root", "n", "class"))
    left, right = (np.asarray(rows.column(c)) for c in ("left", "right"))
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
    of_class, share = rows.column("of_class")[0].as_py(), (1 - threshold) / (1 + threshold)
    x, y = np.flatnonzero(left), np.flatnonzero(right)
    may = np.zeros((len(x), len(y)), dtype=bool)
    step = max(1, (1 << 20) // max(1, len(y)))
    for low in range(0, len(x), step):
        u = x[low:low + step, None]
        fits = (root[u] != root[y]) & (np.maximum(cls[u], cls[y]) == of_class)
        fits &= np.minimum(n[u], n[y]) >= threshold * np.maximum(n[u], n[y]) - 1e-6
        i, j = np.nonzero(fits)
        for k in range(0, len(i), 1 << 16):
            p, q = x[low + i[k:k + (1 << 16)]], y[j[k:k + (1 << 16)]]
            good = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64) <= share * (n[p] + n[q]) + 1e-6
            may[low + i[k:k + (1 << 16)][good], j[k:k + (1 << 16)][good]] = True
    if nearest and len(x):  # the left row that most right rows may be similar to
        many = may.sum(axis=1)
        best = np.where(may, many[:, None], 0).argmax(axis=0)
        j = np.flatnonzero(may[best, np.arange(len(y))])
        i = best[j]
    else:
        i, j = np.nonzero(may)
    a, b = node[x[i]], node[y[j]]
    return np.minimum(a, b), np.maximum(a, b)


def _pairs_of_cells(cells: DataFrame, roots: DataFrame, threshold: float, nearest: bool) -> DataFrame:
    """Distinct (a, b) found in the cells; rows come sorted by cell, one cell is held at a time."""
    rows = _with_roots(cells, roots, "node", "root").repartition("cell").sortWithinPartitions("cell")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(cell: pa.Table) -> Iterator[pa.RecordBatch]:
            if cell.num_rows > 1:
                a, b = _of_a_cell(cell.combine_chunks(), threshold, nearest)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[pa.RecordBatch] = []  # the last cell so far
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for low, high in zip(cuts, cuts[1:]):
                if held and held[0].column("cell")[0].as_py() != ids[low]:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(low, high - low))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return stored(rows.mapInArrow(find, "a long, b long").filter("a <> b").distinct(), "near-pairs")


def roots_of(packed: DataFrame, keyed: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(node, root) of the components of all similar pairs that share a bucket; nodes with a link only.

    ``keyed``: node, keys, one row per distinct text with words. First every member of a bucket is
    aligned with the bucket's head, the member that shares most buckets with others. Members of
    one head that are still apart then meet in cells (see ``_members_of_cells``), twice: each with the one that
    most may be similar to, which joins dense groups by few links, and then all that are left.
    """
    bands = keyed.select(F.explode("keys").alias("bucket"), "node")
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")  # buckets with one node have no pair
    crowded = stored(bands.join(sizes, "bucket"), "near-crowded")
    popular = crowded.groupBy("node").agg(F.sum("n").alias("company"))
    members = stored(crowded.join(popular, "node").select("bucket", "node", F.struct("company", -F.col("node")).alias("rank")), "near-members")
    heads = members.groupBy("bucket").agg((-F.max("rank")["col2"]).alias("head"))
    tested = stored(members.join(heads, "bucket").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(),
                    "near-tested")
    followers = tested.groupBy("a").agg((F.count("*") > cell_rows).alias("crowded"))
    texts = fetched(packed, members.select("node").distinct())
    scores = against_heads(texts, tested.join(followers, "a"), threshold)
    roots = components(scores.filter(F.col("similarity") >= threshold).select("a", "b"))

    scored = scores.select(F.col("a").alias("head"), F.col("b").alias("node"), "similarity", F.col("n_a").alias("n_head"),
                           F.col("n_b").alias("n"), "bits", "n_apart", "apart")
    scored = stored(_with_roots(_with_roots(scored, roots, "node", "root"), roots, "head", "head_root"), "near-scored", compression="zstd")
    # not similar to the head, and not joined to it by other links either
    failed = scored.filter((F.col("similarity") < threshold) & (F.col("root") != F.col("head_root")))
    rest = scored.join(failed.select("head").distinct(), "head", "left_semi")
    cells = stored(_members_of_cells(rest, threshold, cell_rows), "near-cells", compression="zstd")
    for nearest in (True, False):
        pairs = _pairs_of_cells(cells, roots, threshold, nearest)
        roots = _joined(roots, similar(texts, pairs, threshold))
    return roots


def _classed(docs: DataFrame, threshold: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, mark (hash of the text as it is), node, root of every row."""
    with arrow_rows(docs.sparkSession, BATCH_TEXTS):
        return _rooted(docs, threshold, cell_rows)


def _rooted(docs: DataFrame, threshold: float, cell_rows: int) -> DataFrame:
    packed = stored(blocks(docs), "near-blocks", compression="uncompressed")
    narrow = packed.select("block", F.posexplode(F.arrays_zip("doc_ids", "marks", "digests")).alias("i", "row")).select(
        F.col("row.doc_ids").alias("doc_id"), F.col("row.marks").alias("mark"), F.col("row.digests").alias("digest"), _node("block", "i").alias("own"))
    firsts = narrow.groupBy("digest").agg(F.min("own").alias("node"))
    rows = stored(narrow.join(firsts, "digest").select("doc_id", "mark", "own", "node"), "near-rows")
    keyed = packed.select("block", F.posexplode("keys").alias("i", "keys")).select(_node("block", "i").alias("node"), "keys")
    keyed = stored(keyed.join(rows.filter("own = node").select("node"), "node", "left_semi"), "near-keys", compression="zstd")
    roots = roots_of(packed, keyed, threshold, cell_rows)
    return _with_roots(rows, roots, "node", "root")


def _node(block: str, i: str):
    return F.shiftleft(F.col(block), ROW_BITS) + F.col(i)


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
            cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_rows per row of ``df``. ``cell_rows`` bounds what a task
    compares at once, it does not change the result."""
    rows = stored(_classed(ids_and_texts(df, id_col, text_col), threshold, cell_rows), "near-classed")
    named = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    return rows.join(named, "root").select("doc_id", "class_id", "class_rows")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of ``df`` with all its columns: the one with the smallest doc_id, rows without one last."""
    rows = stored(_classed(ids_and_texts(df, id_col, text_col), threshold), "near-classed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("first")
    kept = rows.groupBy("root").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.mark").alias("kept_mark"))
    copies = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("copies"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    kept = kept.join(copies, same).select("kept_id", "kept_mark", "copies")
    row = df.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(text_of(text_col)).alias("own_mark"))
    found = row.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_mark") == F.col("kept_mark")))
    # rows equal in id and text are rare; only they are numbered, and one of each stays
    nth = F.row_number().over(Window.partitionBy("own_id", "own_mark").orderBy(F.lit(0)))
    several = found.filter("copies > 1").withColumn("nth", nth).filter("nth = 1").select("row.*")
    return found.filter("copies = 1").select("row.*").unionAll(several)
