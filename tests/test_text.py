"""Normalisation, tokens, patterns, windows, the lexicon."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordtide.functions.names import dollar_key, exact_key, haversine, infobox_field, plain_key, point, subdivision, year_of
from wordtide.functions.text import ascii_edges, is_account, normalise, tokens, windows, wrap_phrase
from wordtide.operators import context as K
from wordtide.operators import corpus as C
from wordtide.operators import lexicon as X


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "record int, text string")


def test_tokens(spark):
    df = texts(spark, "Don’t [Verse 1: X] stoppin' stoppin", "moët", None, "").select(tokens(normalise(F.col("text"))).alias("t"))
    assert [r["t"] for r in df.collect()] == [["don't", "stoppin", "stoppin"], ["mo", "t"], None, []]
    got = C.tokenise(texts(spark, "don't stoppin stoppin")).first()
    assert got["n_tokens"] == 3 and len(got["words"]) == 2


def test_accounts(spark):
    names = ["X Genius", "Geniuses", "Rap Genius Y", "x genius", "Genius", "Genius\n"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(is_account(F.col("n"))).collect()] == [True, False, True, False, True, True]


def test_edges_are_ascii(spark):
    rx = ascii_edges(r"\bgoat\b")
    assert spark.range(1).select(F.size(F.regexp_extract_all(F.lit("goaté the goat"), F.lit(rx), F.lit(0)))).first()[0] == 2
    assert ascii_edges(r"[\b]\\b") == r"[\b]\\b"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab_1 .-", max_size=20))
def test_edges_agree_with_ascii_mode(text):
    for p in (r"\ba\b", r"\b(?:a|b1)+\b", r"a\b", r"\b"):
        assert [m.span() for m in re.finditer(ascii_edges(p), text)] == [m.span() for m in re.finditer(p, text, re.ASCII)]


def test_phrases_keep_their_quirks(spark):
    lex = X.lexicon(spark, [{"id": "b", "phrases": ["bust ?down"]}, {"id": "c", "phrases": ["bust down", "hey!"]}, {"id": "t", "tokens": ["down"]}, {"id": "u", "tokens": ["down", "bust"]}])
    df = C.tokenise(texts(spark, "bustdown bust  down", "bustdown", "hey!you", "xhey!"))
    assert sorted(map(tuple, X.match_phrases(df, lex).collect())) == [(0, "b"), (0, "c"), (2, "c")]
    assert sorted(map(tuple, X.match_tokens(df, lex).collect())) == [(0, "t"), (0, "u")]
    assert sorted(map(tuple, X.match(df, lex).collect())) == [(0, "b"), (0, "c"), (0, "t"), (0, "u"), (2, "c")]
    assert wrap_phrase("a b!").endswith("b!)") and X.match_phrases(df, X.lexicon(spark, [{"id": "t", "tokens": ["x"]}])).count() == 0


def test_windows_are_clipped(spark):
    df = spark.createDataFrame([(list("abcdefg"), i) for i in (0, 3, 6)], "t array<string>, i int")
    assert ["".join(r[0]) for r in df.select(windows(F.col("t"), F.col("i"), 2)).collect()] == ["abc", "bcdef", "efg"]


def test_senses_and_contexts(spark):
    forms = spark.createDataFrame([("cap", "cap"), ("cap", "caps")], "target string, form string")
    df = texts(spark, "no cap no cap", "red cap caps 12 x red", "cap's capped").withColumn("year", F.lit(2000)).withColumn("genre", F.lit("g"))
    got = K.classify(K.kwic(df, forms, 2), [("cap", "lie", r"\bno cap\b"), ("cap", "colour", r"\bred\b")])
    assert sorted((r["record"], r["pos"], r["sense"]) for r in got.collect()) == [(0, 1, "lie"), (0, 3, "lie"), (1, 1, "colour"), (1, 2, "colour")]
    words = K.context_words(K.kwic(df, forms, 3), forms, spark.createDataFrame([("no",)], "word string"))
    assert sorted((r["record"], r["pos"], r["item"]) for r in words.collect()) == [(1, 1, "red"), (1, 2, "red")]


def test_prior_gates_after_totals(spark):
    rows = [("t", "a", "x", 14), ("t", "b", "x", 15), ("t", "a", "y", 30), ("t", "b", "y", 20)]
    got = K.log_odds(spark.createDataFrame(rows, "target string, era string, item string, y long"), 500.0, ["target"], "era", 15).collect()
    assert sorted((r["era"], r["item"]) for r in got) == [("a", "y"), ("b", "x"), ("b", "y")]
    import math

    z = {(r["era"], r["item"]): r["z"] for r in got}[("b", "x")]
    a, y1, y2, n1, n2 = 29 / 79 * 500, 15, 14, 35, 44
    want = (math.log((y1 + a) / (n1 + 500 - y1 - a)) - math.log((y2 + a) / (n2 + 500 - y2 - a))) / math.sqrt(1 / (y1 + a) + 1 / (y2 + a))
    assert z == pytest.approx(want)


def test_names_and_places(spark):
    assert exact_key("  A  B ") == "a b" and plain_key("Björk & Sön!") == "bjorkandson" and dollar_key("A$AP") == "asap"
    row = spark.createDataFrame([("Point(-73.9 40.7)", "1987-00-00", ["x", "US-NJ"], "{{Infobox\n| origin = [[Town|The Town]], [[State]]<ref>x</ref><br>B\n| x = 1}}")], "w string, d string, c array<string>, t string")
    got = row.select(point(F.col("w")).alias("p"), year_of(F.col("d")), subdivision(F.col("c")), infobox_field(F.col("t"), "origin"), haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()
    assert (got["p"]["lat"], got["p"]["lon"]) == (40.7, -73.9) and got[1:4] == (1987, "US-NJ", "The Town, State, B") and got[4] == pytest.approx(6371 * 3.141592653589793)
    assert spark.range(1).select(point(F.lit("<moon> Point(1 2)"))).first()[0] is None
