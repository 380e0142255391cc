import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like the operators' own."""
    long = "Ein Satz mit Wörtern. Another one, und noch\nmehr " * 3000
    rows = [(1, None, None), (2, "", "x"), (3, " \n\t ", ""), (4, long, "y"), (4, long, "y"), (None, "no id at all", None),
            (None, None, None), (5, "a", "z"), (6, "日本語 🙂 text", "z"), (7, "word " * 4, "q")]
    clash = ("row", "block", "keys", "t", "n_tokens", "shard", "slot", "node", "length", "sequence_id", "part", "tree", "kept", "nth")
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in clash)
    return spark.createDataFrame([(*r, *("c",) * len(clash)) for r in rows], schema).repartition(3)
