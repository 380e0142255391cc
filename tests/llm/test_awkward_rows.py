"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest

from tablepact.llm import byte_bpe, merkle, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, tool_calls, wavelet

PIECES, RANKS, WORDS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
OPERATORS = {
    "token_counts": lambda df: token_counts.token_counts(df, PIECES),
    "shards": sharding.shard_documents,
    "wavelet": lambda df: wavelet.round_trip(df, WORDS),
    "quality": quality.quality,
    "byte_bpe": lambda df: byte_bpe.encode_documents(df, RANKS),
    "classes": near_dedup.classes,
    "repeats": suffix_dedup.repeats,
    "merkle": merkle.against_edits,
}


def by_id(rows):
    return {r["doc_id"]: r for r in rows if r["doc_id"] is not None}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(awkward, name):
    rows = OPERATORS[name](awkward).collect()
    assert len(rows) == 10
    got = by_id(rows)
    if name == "token_counts":
        assert (got[1]["n_tokens"], got[2]["n_tokens"], got[4]["over_limit"]) == (0, 0, True)
    if name == "shards":
        assert got[1]["size"] == got[2]["size"] == 16 and got[1]["shard"] == got[2]["shard"]
    if name == "wavelet":
        assert got[1]["n_tokens"] == got[2]["n_tokens"] == got[3]["n_tokens"] == 1
    if name == "quality":
        assert not any(r["kept"] for r in rows) and got[1]["base_failed"]
    if name == "byte_bpe":
        assert got[1]["n_tokens"] == 0 and got[1]["ids_sha256"] == got[2]["ids_sha256"]
    if name == "classes":
        assert got[1]["class_id"] == got[3]["class_id"] == 1 and got[4]["class_rows"] == 2
    if name == "repeats":
        assert got[4]["n_removed"] == got[4]["n_bytes"] and got[5]["n_removed"] == 0
    if name == "merkle":
        assert got[1]["near_edited"] == 1.0 and got[1]["fingerprint"] == got[2]["fingerprint"]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(awkward, name):
    assert OPERATORS[name](awkward.limit(0)).collect() == []


def test_packing_of_awkward_rows(awkward):
    import brute

    rows = packing.pack_documents(awkward, WORDS).collect()
    brute.check_packing(rows, 2048)
    assert sorted(r["length"] for r in rows if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]
    assert packing.pack_documents(awkward.limit(0), WORDS).collect() == []


def test_tool_calls_of_awkward_rows(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", ""), (None, 0, "user", "x"), (None, 1, "assistant", "y"),
             (2, None, None, None), (2, 0, "user", "q" * 200_000), (2, 0, "user", "q" * 200_000), (3, 1, "assistant", "alone")]
    df = spark.createDataFrame([(*t, "c", "d") for t in turns], "conv_id long, turn long, role string, text string, status string, place string")
    rows = tool_calls.link_tool_calls(tool_calls.messages_of_turns(df), {"ask": tool_calls.ASK}).collect()
    assert sorted(r["status"] for r in rows) == ["linked", "linked", "message", "message", "message", "open", "orphan", "repeated"]
    assert tool_calls.link_tool_calls(tool_calls.messages_of_turns(df.limit(0)), {}).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, awkward, documents, name, stage):
    docs = awkward.selectExpr("doc_id", "text", "lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "row", "keys")
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == {"quality_rules": 0, "near_duplicates": 6, "repeated_strings": 10}[name]
    assert stage(spark, docs.limit(0), "").collect() == []


def test_pipeline_as_plain_steps(spark, texts):
    import os

    import brute
    import numpy as np
    from conftest import SF
    from tokenizers import Tokenizer

    left = {d: t for d, t in texts.items() if brute.kept(t)}
    of = brute.classes(list(left), list(left.values()))
    left = {d: t for d, t in left.items() if of[d] == d}
    cut = brute.removed(list(left.values()))
    left = {d: np.frombuffer(b, dtype=np.uint8)[~g].tobytes().decode("utf-8", "ignore") for d, (b, g) in zip(left, cut)}
    library = Tokenizer.from_file(WORDS)
    want = [p for d, t in left.items() for p in brute.pieces(d, library.encode(t, add_special_tokens=False).ids, 0, 2048)]
    rows = corpus_pipeline.run(spark, os.environ.get("SF_DIR", SF)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    brute.check_packing(rows, 2048)
