"""Texts in languages without a list of stop words."""

from __future__ import annotations

from tablepact.llm import quality


def test_other_languages_pass_the_stop_word_rule(spark):
    text = " ".join(f"sana{chr(97 + i % 26)}{chr(97 + i // 26)} kulkee" for i in range(40))
    langs = ["fi", "pt_BR", "en", "de-AT", " EN", "", None]
    df = spark.createDataFrame([(i, text, x) for i, x in enumerate(langs)], "doc_id long, text string, lang string")
    want = [0, 1]
    assert sorted(r["doc_id"] for r in quality.quality(df).collect() if r["kept"]) == want
    assert sorted(r["doc_id"] for r in quality.keep_good(df).collect()) == want
    assert quality.quality(df).columns == quality.quality(df.drop("lang")).columns
    assert quality.keep_good(df.drop("lang")).count() == 0
    few = df.selectExpr("doc_id", "substr(text, 1, 60) AS text", "lang")
    assert quality.keep_good(few).count() == 0
