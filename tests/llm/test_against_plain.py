"""Every operator against a plain version, its library, or an exact round trip."""

from __future__ import annotations

import base64
import collections
import hashlib
import json
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablepact.llm import byte_bpe, merkle, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, tool_calls, wavelet
from tablepact.llm.words import WordTokenizer

PIECES, RANKS, WORDS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
LETTERS = ["a", "b", "'s", "'ll", "'", " ", "  ", "\n", "1", "²", "!", "é", "日", "🙂", "́", "　", "\x85", "ſ", "İ", "Σ", "<|endoftext|>", "th", "the ", "."]
mixed = st.lists(st.sampled_from(LETTERS), max_size=60).map("".join)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


# ---- 1

@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab ", "a", "   a", "the of ", "é", "日本", "\n\t", "🙂", "▁"]), max_size=400).map("".join))
def test_chunks_resynchronise(text):
    encoder = token_counts.ChunkedEncoder(PIECES, chunk=120, overlap=30)
    assert encoder.encode(text).tolist() == encoder.model.encode(text)


def test_token_counts(documents, texts):
    model = token_counts.ChunkedEncoder(PIECES).model
    rows = token_counts.token_counts(documents, PIECES, chunk=700, overlap=64).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == {
        d: (len(t.encode()), n := len(model.encode(t)), n > 4096) for d, t in texts.items()}


# ---- 2

def test_differencing_is_balanced():
    rng = np.random.default_rng(4)
    sizes = rng.lognormal(6, 1, 3000).astype(np.int64)
    labels, sums = sharding.differenced(sizes[:, None], 40)
    assert (np.bincount(labels[:, 0], sizes, 40) == sums).all()
    assert sums.max() - sums.min() <= 40
    again, more = sharding.differenced(np.sort(rng.integers(0, 10**6, (25, 8)), axis=1), 8)
    assert more.max() - more.min() < 10**5 and {tuple(sorted(x)) for x in again} == {tuple(range(8))}


def plain_differencing(sizes: list[int], shards: int) -> list[int]:
    """Karmarkar-Karp with a heap of partial partitions, each a list of shard sums."""
    import heapq

    heap = [(-size, i, [0] * (shards - 1) + [size]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        made = sorted(x + y for x, y in zip(sorted(a), sorted(b, reverse=True)))
        heapq.heappush(heap, (made[0] - made[-1], serial, made))
        serial += 1
    return heap[0][2]


def test_spread_of_the_registered_shards(documents, texts):
    """Equal texts stay together; the spread is no wider than plain differencing leaves it, but for the largest group."""
    group = collections.Counter()
    for t in texts.values():
        group[t] += len(t.encode()) + 16
    plain = plain_differencing(list(group.values()), 40)
    total = collections.Counter()
    for r in sharding.shard_documents(documents).collect():
        total[r["shard"]] += r["size"]
    assert set(total) == set(range(40)) and sum(total.values()) == sum(plain)
    assert max(total.values()) - min(total.values()) <= max(40, 2 * (max(plain) - min(plain)))


def test_shards(documents, texts):
    for buckets in (10**6, 60):
        groups = documents.selectExpr("unhex(sha2(text, 256)) AS key", "octet_length(text) + 16L AS bytes").groupBy("key").agg({"bytes": "sum"}) \
            .withColumnRenamed("sum(bytes)", "bytes")
        placed = sharding.shards_of_groups(groups, 5, buckets).collect()
        assert len(placed) == len(set(texts.values())) and {r["shard"] for r in placed} == set(range(5))
    rows = sharding.shard_documents(documents).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()}
    slots, of_text = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        of_text[texts[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_text.values())


# ---- 3

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=1500))
def test_wavelet_matrix(values):
    ids = np.asarray(values, dtype=np.uint32)
    made = wavelet.WaveletMatrix.build(ids, 10)
    row = {"n": made.n, "bits": 10, "zeros": made.zeros.tolist()} | made.columns()
    made = wavelet.WaveletMatrix.of_columns(row)
    assert made.decode().tolist() == values
    ends = list(range(0, len(values) + 1, 13))
    for v in [*values[:3], 0, 700]:
        assert made.ranks(v, ends).tolist() == [values[:e].count(v) for e in ends]
    upper = wavelet.WaveletMatrix.of_columns({k: x for k, x in row.items() if k.partition("_")[2] in ("", "0", "1", "2")})
    assert upper.ranks(640, ends, 3).tolist() == [sum(640 <= v < 768 for v in values[:e]) for e in ends]
    for i in range(0, len(values), 97):
        v = values[i]
        assert made.access(i) == v and made.rank(v, i) == values[:i].count(v)
        assert made.select(v, made.rank(v, i)) == i
    assert made.rank(701) == values.count(701) == 0 and made.select(701, 0) == -1


def test_files_read_back(spark, documents, texts, library, tmp_path):
    path = str(tmp_path / "ids")
    wavelet.write_matrices(documents, path, WORDS, matrix_tokens=5000)
    made = wavelet.read_matrices(spark, path)
    rows = sorted(wavelet.documents_of(made).collect(), key=lambda r: r["doc_id"])
    at, total = 0, collections.Counter()
    for r, (d, t) in zip(rows, sorted(texts.items()), strict=True):
        ids = np.asarray([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        total.update(ids.tolist())
    found = wavelet.occurrences(made, [2, 267, 49407]).groupBy("token_id").sum("n").collect()
    assert {r[0]: r[1] for r in found} == {t: total[t] for t in (2, 267, 49407)}
    # ids of a range of the vocabulary: 4 of 16 planes are read
    upper = wavelet.occurrences(made, [267], levels=4)
    assert sum(r["n"] for r in upper.collect()) == sum(n for t, n in total.items() if t < 4096)
    scans = upper._jdf.queryExecution().executedPlan().toString()
    assert "plane_3" in scans and "plane_4" not in scans and "ones_4" not in scans
    some = sorted(texts)[3:60:11]
    got = collections.defaultdict(list)
    for r in wavelet.ids_of(made, some).orderBy("doc_id", "place").collect():
        got[r["doc_id"]].append(r["id"])
    assert got == {d: [*library.encode(texts[d], add_special_tokens=False).ids, 2] for d in some}
    assert all(r["n_end_ids"] == [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2].count(2) for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(mixed, min_size=1, max_size=5))
def test_words_as_the_library(library, made):
    if not hasattr(test_words_as_the_library, "words"):
        test_words_as_the_library.words = WordTokenizer(WORDS, remembered=40)
    coded = test_words_as_the_library.words.encode(pa.array(made), 9)
    assert [np.frombuffer(c, dtype="<u4").tolist() for c in coded] == [
        [*e.ids, 9] for e in library.encode_batch(made, add_special_tokens=False)]


def test_every_code_point_in_a_word_as_the_library(library):
    """Each code point alone, inside and after a word, with marks; every 7th beyond the common planes' first part."""
    words = WordTokenizer(WORDS)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x2000 or c % 7 == 0)]
    for low in range(0, len(codes), 20_000):
        made = [f"{c} Ab{c} {c}cd, x{c}y.) {c}." for c in map(chr, codes[low:low + 20_000])]
        coded = words.encode(pa.array(made), 9)
        want = [np.asarray([*e.ids, 9], dtype="<u4").tobytes() for e in library.encode_batch(made, add_special_tokens=False)]
        assert [m for m, x, y in zip(made, coded, want) if x != y] == []


# ---- 4

def test_quality(documents, texts):
    for r in quality.quality(documents).collect():
        plain = brute.signals(texts[r["doc_id"]])
        assert {k: r[k] for k in plain} == plain and r["kept"] == brute.kept(texts[r["doc_id"]])
    assert {r["doc_id"] for r in quality.keep_good(documents).collect()} == {d for d, t in texts.items() if brute.kept(t)}


# ---- 5

@settings(max_examples=200, deadline=None)
@given(st.lists(mixed, min_size=1, max_size=4))
def test_byte_bpe_as_the_library(made):
    import tiktoken

    own = test_byte_bpe_as_the_library
    if not hasattr(own, "pairs"):
        own.pairs = byte_bpe.BytePairs.load(RANKS)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        own.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = own.pairs.encode(made)
    assert [np.frombuffer(c, dtype="<u4").tolist() for c in coded] == [own.library.encode_ordinary(t) for t in made]
    assert [own.pairs.decode(c).decode() for c in coded] == made
    assert all(own.pairs.offsets(c)[-1] == len(t.encode()) for c, t in zip(coded, made))


def test_every_code_point_as_the_library():
    """Each code point beside a letter, a digit and a blank, and doubled; the blocks that editions of Unicode disagree on, and every 5th of the rest."""
    import sys
    import unicodedata

    import tiktoken

    pairs = byte_bpe.BytePairs.load(RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kinds, python = byte_bpe.classes(), {"L": byte_bpe.LETTER, "N": byte_bpe.NUMBER}
    differs = lambda c: kinds[c] != byte_bpe.WHITE_RUN and kinds[c] != python.get(unicodedata.category(chr(c))[0], byte_bpe.OTHER)
    codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (
        c % 5 == 0 or c < 0x3000 or differs(c))]
    assert any(map(differs, codes)) or unicodedata.unidata_version >= "16"
    for low in range(0, len(codes), 20_000):
        made = [f"a{c}1{c}{c} {c}b {c}{c}" for c in map(chr, codes[low:low + 20_000])]
        coded = pairs.encode(made)
        assert [c for t, c in zip(made, coded) if np.frombuffer(c, dtype="<u4").tolist() != library.encode_ordinary(t)] == []


def test_ids_of_documents(documents, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.encode_documents(documents, RANKS).collect()
    want = {d: np.asarray(library.encode_ordinary(t), dtype="<u4").tobytes() for d, t in texts.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in rows} == {
        d: (len(ids) // 4, hashlib.sha256(ids).hexdigest()) for d, ids in want.items()}


def test_long_pieces_merge_alike():
    pairs = byte_bpe.BytePairs.load(RANKS)
    rng = random.Random(2)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcthe ing") for _ in range(rng.randint(2, 60)))
        assert pairs._merge_short(piece) == pairs._merge_long(piece)


def test_decoding_documents(documents, texts):
    encoded = byte_bpe.encode_documents(documents, RANKS)
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decode_documents(encoded, RANKS).collect()} == texts
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in encoded.collect())


# ---- 6

def near_copies(seed: int) -> list[str]:
    """Chains of edited copies whose ends are not similar, exact copies, and texts around one shared passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    made, passage = [], [word() for _ in range(40)]
    for _ in range(6):
        text = [word() for _ in range(120)]
        for _ in range(8):
            text = list(text)
            text[rng.randrange(len(text))] = word()
            made.append(" ".join(text))
        made.append(made[-1])
    # one text with many independently edited copies, some cut short, around the threshold
    base = [word() for _ in range(100)]
    for k in range(30):
        text = list(base)
        for _ in range(k % 4):
            text[rng.randrange(len(text))] = word()
        made.append(" ".join(text[:100 - 3 * (k % 7)]))
    for _ in range(25):
        made.append(" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]))
    # one text with its halves, and its thirds, the other way round: apart from it, similar to one another
    for cut in (50, 33):
        for k in range(6):
            text = base[cut:] + base[:cut]
            text[rng.randrange(len(text))] = word()
            made.append(" ".join(text))
    return made


@pytest.mark.parametrize("seed,cell_rows", [(5, near_dedup.CELL_ROWS), (6, near_dedup.CELL_ROWS), (5, 3), (6, 3), (7, 2)])
def test_classes_of_chains(spark, seed, cell_rows):
    rows = list(enumerate(near_copies(seed)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.classes(df, cell_rows=cell_rows).collect()
    want = brute.classes([d for d, _ in rows], [t for _, t in rows])
    assert {r["doc_id"]: r["class_id"] for r in found} == want
    assert all(r["class_rows"] == list(want.values()).count(r["class_id"]) for r in found)


def test_alignment_is_exact_from_the_threshold_on():
    rng = random.Random(8)
    for _ in range(300):
        a = rng.sample(range(60), 40)
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            b[rng.randrange(len(b))] = rng.randint(100, 10**6)
        if rng.random() < 0.3:
            b = b[20:] + b[:20]
        plain, found = brute.similarity(a, b), near_dedup.aligned(np.asarray(a), np.asarray(b))
        assert found == plain if plain >= 0.8 else found < 0.8 or found >= plain


# ---- 7

def test_links_order_and_records(spark):
    schema = {"sum": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}}}}
    rows = [(1, 1, "call", "x", "sum", '{"b":1, "a":2}', None, ["y"]), (1, 2, "result", "x", None, None, "two", None),
            (1, 3, "call", "y", "sum", '{"a":-1}', None, None), (1, 4, "result", "y", None, None, "no", None),
            (2, 1, "call", "p", "sum", "{", None, ["q"]), (2, 2, "call", "q", "sum", '{"a":1}', None, ["p"]),
            (2, 3, "result", "p", None, None, "r", None), (2, 4, "result", "q", None, None, "r", None),
            (3, 1, "result", "late", None, None, "orphan", None), (3, 2, "call", "x", "none", '{"a":1}', None, None),
            (3, 3, "call", "x", "sum", '{"a":1}', None, None), (3, 4, "note", None, None, None, "hi", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, kind string, call_id string, name string, arguments string, "
                                     "content string, uses array<string>")
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.link_tool_calls(df, schema).collect()}
    assert len(got) == len(rows)
    assert [got[1, t]["status"] for t in (1, 2, 3, 4)] == ["linked"] * 4
    places = {(r["kind"], r["call_id"]): r["place"] for (c, _), r in got.items() if c == 1}
    assert places["call", "y"] < places["result", "y"] < places["call", "x"] < places["result", "x"]
    assert all(got[2, t]["place"] is None for t in (1, 2, 3, 4))  # a cycle, and what waits for it
    assert [got[3, t]["status"] for t in (1, 2, 3, 4)] == ["orphan", "open", "repeated", "message"]
    assert [got[k]["valid"] for k in ((1, 1), (1, 3), (2, 1), (3, 2))] == [True, False, False, False]
    assert got[1, 1]["record"] == ('{"arguments":{"a":2,"b":1},"content":null,"id":"x","name":"sum","result":"two",'
                                   '"status":"linked","valid":true}')
    assert json.loads(got[2, 1]["record"])["arguments"] == "{"


def test_schemas():
    deep = {"type": "array", "items": {"type": ["string", "null"], "maxLength": 3}}
    assert tool_calls.conforms(["abc", None], deep) and not tool_calls.conforms(["abcd"], deep)
    assert not tool_calls.conforms(True, {"type": "integer"}) and tool_calls.conforms(2.0, {"type": "integer"})
    assert not tool_calls.conforms({"x": 1}, {"properties": {}, "additionalProperties": False})
    assert not tool_calls.checked("t", '{"a": NaN}', {"t": {}})[0]


# ---- 8

@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=70).map(lambda b: bytes(x % 3 for x in b)), max_size=9), st.sampled_from([8, 9, 20]))
def test_repeated_windows(strings, length):
    count = collections.Counter(s[i:i + length] for s in strings for i in range(len(s) - length + 1))
    want = [[count[s[i:i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
    assert [f.tolist() for f in suffix_dedup.repeated_windows(strings, length)] == want


def test_equal_rolling_hashes_of_different_bytes():
    """A Thue-Morse word and its complement have one rolling hash modulo 2**64; the windows of dealt anchors are told apart."""
    import pandas as pd

    word = b"a"
    while len(word) < 2048:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    hashes = [suffix_dedup.Rolling(np.frombuffer(w, dtype=np.uint8), suffix_dedup.SECOND_BASE).of(np.array([0]), np.array([2048]))[0] for w in (word, other)]
    assert hashes[0] == hashes[1] and word != other
    frame = pd.DataFrame({"block": [1, 2, 3], "k": [0, 0, 0], "dealt": True, "bytes": [word, other, word]})
    made = suffix_dedup._shard(2048)(frame)
    assert [len(d) for d in made["digests"]] == [1, 1, 0] and made["digests"][0][0] != made["digests"][1][0]
    assert [x.tolist() for x in made["single"]] == [[False], [True], []]


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_merging_of_sorted_windows(size):
    rng = random.Random(size)
    rows = sorted((bytes([rng.choice([0, 7])]) * 8 + bytes(7) + bytes([rng.randrange(9)]), rng.random() < 0.7, i) for i in range(40))
    batch = pa.table({"block": [i for _, _, i in rows], "k": pa.array([0] * 40, pa.int32()), "at": pa.array([1] * 40, pa.int32()),
                      "digest": [d for d, _, _ in rows], "single": [x for _, x, _ in rows]}).to_batches(size)
    found = [b for out in suffix_dedup._merged(iter(batch)) for b in out.column("block").to_pylist()]
    count = collections.Counter(d for d, _, _ in rows)
    assert found == [i for d, single, i in rows if single and count[d] > 1]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1 << 14, "shard_contexts": 20}, {"block_bytes": 1 << 13, "shard_contexts": 2}])
def test_repeats(documents, texts, options):
    order = sorted(texts)
    want = dict(zip(order, brute.digests([texts[d] for d in order])))
    rows = suffix_dedup.repeats(documents, **options).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want


# ---- 9

@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plans_use_every_piece_once(counts):
    made = packing.plan(counts, 64)
    used = collections.Counter()
    for pattern, times in made:
        assert sum(pattern) <= 64 and times > 0
        for length in pattern:
            used[length] += times
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(t for _, t in made) <= max(1, 2 * -(-total // 64))


def test_packing(documents, texts, library):
    placed = packing.pack_documents(documents, WORDS, capacity=300)
    rows = placed.collect()
    want = [p for d, t in texts.items() for p in brute.pieces(d, library.encode(t, add_special_tokens=False).ids, 0, 300)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    total = sum(r["length"] for r in rows)
    assert brute.check_packing(rows, 300) <= 1 + -(-total // 300) * 1.01
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    assert all(ids[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"] for r in rows)


# ---- 10

def test_fingerprints(spark):
    a = "One. Two! Three?\nfour\n\nfive. six"
    df = spark.createDataFrame([(1, a), (2, a), (3, a.replace("six", "6")), (4, "other")], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in merkle.fingerprints(df).collect()}
    assert prints[1] == prints[2] and len(set(prints.values())) == 3
    pairs = spark.createDataFrame([(prints[1], prints[2]), (prints[1], prints[3])], "a string, b string")
    same, edit = [[(x["section"], x["paragraph"]) for x in r[0]] for r in pairs.select(merkle.differing(pairs.a, pairs.b)).collect()]
    assert same == [] and edit == [(1, 0)]


def test_roots_and_control_characters(spark):
    texts = ["One. two", "One.\x01two", "One.\x02atwo", "One.\x02two", "One.", "One. "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [r["fingerprint"] for r in merkle.fingerprints(df).orderBy("doc_id").collect()]
    assert len(set(prints)) == len(texts)
    node = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaf = [node("One."), node("two")]
    paragraph = node("".join(leaf))
    section = node(paragraph)
    assert prints[0] == f"{node(section)}|{section[:12]}[{paragraph[:12]}({leaf[0][:12]}.{leaf[1][:12]})]"


@pytest.mark.parametrize("name", ["doc-%06d", "%d", "é%03d-tail"])
def test_next_documents_by_string_ids(documents, texts, name):
    from pyspark.sql import functions as F

    df = documents.select(F.format_string(name, "doc_id").alias("doc_id"), "text")
    ids = {name % d: t for d, t in texts.items()}
    order = sorted(ids, key=str.encode)
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(df).collect()}
    assert got == {d: ids[n] for d, n in zip(order, [*order[1:], order[0]])}


def test_next_documents_by_large_ids(documents, texts):
    large = lambda d: (d * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)
    rows = documents.sparkSession.createDataFrame([(large(d), t) for d, t in texts.items()], "doc_id long, text string")
    order = sorted(texts, key=large)
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(rows).collect()}
    assert got == {large(d): texts[n] for d, n in zip(order, [*order[1:], order[0]])}


def test_next_documents(documents, texts):
    order = sorted(texts)
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(documents.select("doc_id", "text")).collect()}
    assert got == {d: texts[n] for d, n in zip(order, [*order[1:], order[0]])}
