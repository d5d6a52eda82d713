"""Mixing gives one result at any number of cells, and counts tokens as packing does."""

import pytest
from pyspark.sql import functions as F

from wordtide.llm import bpe, mixing

SCHEMA = "doc_id long, text string, lang string, source string"


def test_many_cells_are_raked_as_few_are(spark, monkeypatch):
    rows = [(i, "a b c " * (1 + i * i % 17) + "| x |" * (i % 3 == 0), "xy"[i % 7 % 2], "abc"[i * i % 5 % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    targets = {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.9, "y": 0.1}}
    weigh = lambda: {(r["source"], r["lang"], r["topic"]): (r["weight"], r["probability"]) for r in mixing.cell_weights(df, F.col("source"), F.col("lang"), F.col("text"), targets, 0.95).collect()}
    monkeypatch.setattr(mixing, "HALVINGS", 0)  # on both sides; every fit of a table takes minutes here
    few = weigh()
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    many = weigh()
    assert few.keys() == many.keys()
    for k, x in few.items():
        assert many[k] == pytest.approx(x, rel=1e-7, abs=1e-12)


def test_texts_without_blanks_have_tokens(spark):
    texts = ["日本語のテキスト" * 50, "plain words here", None]
    df = spark.createDataFrame([(i, t, "x", "a") for i, t in enumerate(texts)], SCHEMA)
    enc = bpe.Encoder(bpe.tokenizer_json())
    got = [r["n_tokens"] for r in mixing.mix(df, count="bpe").orderBy("doc_id").collect()]
    assert got == enc.encode([t or "" for t in texts])[0].tolist() and got[0] > 50
