"""Lexical search against scoring every document, and the tree's order of descent."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wordtide.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "score int, text string, doc_id long, rank string, terms int", "text string, item_id long, term int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    had = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in had), sum(sum(c.values()) for _, c in had)
    df = Counter(t for _, c in had for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scores = []
        for d, c in had:
            m = 10 + 90 * sum(c.values()) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def got(spark, docs, items, **how):
    d = spark.createDataFrame([(1, t, i, "x", 2) for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(t, i, 3) for i, t in items], ITEMS)
    return sorted(tuple(r) for r in L.rank_documents(d, q, **how).collect())


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(300)] + ["Über", "日本", "A1b", "x'y", "é"]
    text = lambda m: " ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", "-z"]) for _ in range(rnd.randint(0, m)))
    docs = [(d, text(40)) for d in range(n)] + [(1000, None), (1001, ""), (1002, "?!"), (None, text(30)), (7, text(20)), (1003, "word " * 3000)]
    docs += [(2000 + d, docs[5][1]) for d in range(30)]  # ties
    items = [(i, text(25)) for i in range(12)] + [(50, docs[5][1]), (51, None), (52, "unheard of"), (None, "w1"), (3, "w1 w2")]
    return docs, items


@pytest.mark.parametrize("seed,size,fan,share", [(1, 4 << 20, 8, 1 << 18), (2, 300, 2, 5), (3, 2000, 3, 40)])
def test_ranks_are_those_of_scoring_all(spark, monkeypatch, seed, size, fan, share):
    monkeypatch.setattr(L, "RANGE", size)
    monkeypatch.setattr(L, "FAN", fan)
    monkeypatch.setattr(L, "ROUND", share)
    docs, items = corpus(seed)
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs[:40], items, k=3) == brute(docs[:40], items, 3)


def test_empty_tables(spark):
    docs, items = corpus(4)
    assert got(spark, [], items) == [] and got(spark, docs, []) == [] and got(spark, [(1, None)], items) == []


def test_tree_holds_maxima_and_prunes():
    rnd = np.random.default_rng(1)
    docs, n = 1000, 20
    doc, term = np.divmod(np.sort(rnd.choice(docs * n, 4000, replace=False)), n)
    value = rnd.integers(1, 1000, 4000)
    value[doc == 700] = 50_000  # one document far above all others
    levels = L._max_tree(doc, term, value, docs, n)
    for level, (first, t, v) in enumerate(levels):
        want = {}
        for d, x, y in zip((doc // L.FAN**level).tolist(), term.tolist(), value.tolist(), strict=True):
            want[d, x] = max(y, want.get((d, x), 0))
        node = np.repeat(np.arange(len(first) - 1), np.diff(first))
        assert dict(zip(zip(node.tolist(), t.tolist(), strict=True), v.tolist(), strict=True)) == want
    best = []
    opened = L._descend(levels, np.ones(n, dtype=np.int64), best, 1, list(range(docs)))
    assert best[0][1] == -700 and opened < len(levels)  # of 143 nodes


def test_equal_bounds_are_opened_for_ties():
    doc, term = np.arange(100), np.zeros(100, dtype=np.int64)
    levels = L._max_tree(doc, term, np.full(100, 7), 100, 1)
    best = []
    L._descend(levels, np.ones(1, dtype=np.int64), best, 3, list(range(100, 0, -1)))
    assert sorted(-d for _, d in best) == [1, 2, 3]
