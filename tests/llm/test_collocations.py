"""Collocations against counting every phrase of every piece."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from wordtide.llm import collocations as C
from wordtide.llm.words import radix_order

SCHEMA = "doc_id long, text string, n int, lang string, block string"  # clashing extra columns


def brute(rows, least, k=2000, most=4):
    out = []
    langs = {lang if lang is not None else "und" for lang, _ in rows}
    for lang in langs:
        f = Counter()
        for x, t in rows:
            if (x if x is not None else "und") == lang:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
                for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
                    w = re.findall(r"[^ \t]+", piece)
                    f.update(tuple(w[i : i + m]) for m in range(1, most + 1) for i in range(len(w) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(a, longer[p[i : i + m]])
        rows_ = []
        for p, a in cand.items():
            if p not in longer or 100 * longer[p] < 80 * a:
                s, cut = min((2_000_000 * a // (f[p[:j]] + f[p[j:]]), j) for j in range(1, len(p)))
                rows_.append((-s, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, r, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y) in enumerate(sorted(rows_)[:k], 1)]
    return sorted(out)


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 1, lang, "b") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in C.collocations(df, **how).collect())


def corpus(seed, n=150):
    rnd = random.Random(seed)
    words = ["a", "B", "of", "the", "Éa", "日本", "x'y", " ", "new", "York", "city", "é"]
    fixed = ["new York city hall", "of the", "x'y a x'y a x'y"]
    def text():
        return "".join(rnd.choice([rnd.choice(words), rnd.choice(fixed), f"rare{rnd.randint(0, 500)}"]) + rnd.choice([" ", "  ", "\t", ", ", ".\n", " ", " "]) for _ in range(rnd.randint(0, 60)))
    return [(rnd.choice(["en", "de", None, "und", ""]), text()) for _ in range(n)] + [("en", None), ("fr", ""), ("fr", " ,. "), (None, "..")] + [("en", "the same line again")] * 40


@pytest.mark.parametrize("seed,least,block,tokens,keys,merge", [(1, 30, 4 << 20, 1 << 19, 1 << 21, 4096), (2, 5, 200, 7, 50, 3), (3, 3, 1000, 1 << 19, 200, 2)])
def test_phrases_are_those_of_counting_all(spark, monkeypatch, seed, least, block, tokens, keys, merge):
    for name, value in zip(("BLOCK", "TOKENS", "RANGE", "MERGE"), (block, tokens, keys, merge), strict=True):
        monkeypatch.setattr(C, name, value)
    rows = corpus(seed)
    want = brute(rows, least)
    assert len(want) > 10 and got(spark, rows, least=least) == want


@pytest.mark.parametrize("k,most", [(3, 4), (1, 3), (7, 2)])
def test_top_and_length(spark, k, most):
    rows = corpus(5)
    assert got(spark, rows, least=4, k=k, most=most) == brute(rows, 4, k, most)


def test_counts_beyond_64_bits_stay_exact(spark):
    """Scores of counts whose product with the scale passes 2**63."""
    big = 6_000_000_000_000
    counts = spark.createDataFrame([(bytearray(b"\0\0\0\1\0\0\0\2"), big)], "key binary, f long")
    words = spark.createDataFrame([(1, "en", "p", big), (2, "en", "q", big + 1)], "id long, lang string, word string, f long")
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    row = C._scored(counts, words, totals, (80, 100), 2_000_000, 10).first()
    assert row["score"] == 2_000_000 * big // (2 * big + 1) and row["phrase"] == "p q"


def test_empty_tables_and_limits(spark):
    assert got(spark, []) == [] and got(spark, [("en", None)]) == [] and got(spark, [("en", "one two")]) == []
    with pytest.raises(ValueError):
        C.collocations(spark.createDataFrame([], SCHEMA), most=5)


def test_radix_order():
    rnd = np.random.default_rng(0)
    for top in (3, 1 << 20, 1 << 63):
        a, b = (rnd.integers(0, top, 500, dtype=np.uint64) for _ in range(2))
        assert radix_order([a, b]).tolist() == np.lexsort((b, a)).tolist()
    assert radix_order([np.zeros(0, dtype=np.uint64)]).tolist() == []
