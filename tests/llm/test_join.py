"""The n-gram Jaccard join against brute force over all pairs."""

import os
import random

import numpy as np
import pytest

from wordtide.llm import ngram_join
from wordtide.llm.common import connected_components
from wordtide.llm.ngram_join import keep_one_of_each, ngram_components, shingle_sets

SCHEMA = "doc_id long, text string, k1 int, component_id int, token string"  # clashing extra columns


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    """doc_id -> (set size, component, class) by all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        same = [rows[j][0] for j in range(len(rows)) if sets[j] == sets[i] and sets[i]] or [d]
        out[d] = (len(sets[i]), min(own), min(same))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß", "Ünï"]
    texts = ["", None, " \n\t ", "one", "one two", "One TWO", "one\x0btwo\x1cthree", "a a a a a a a a", "b c d e f"]
    passage = [r.choice(vocab) for _ in range(60)]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 10, 40, 150, 400]))]
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
                k = r.randrange(len(w))
                op = r.random()
                w[k : k + (op < 0.8)] = [r.choice(vocab)] if op < 0.6 or op > 0.8 else []
                w = w or ["x"]
            texts.append(" ".join(w + passage if r.random() < 0.15 else w))
    r.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,n,num,den,block", [(1, 3, 90, 100, 2048), (2, 5, 80, 100, 2048), (3, 3, 50, 100, 4), (4, 2, 70, 100, 3), (5, 1, 90, 100, 2048)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, n, num, den, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # also where lists are dealt in blocks
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["class_id"]) for r in ngram_components(df, n=n, num=num, den=den).collect()}
    assert got == brute(rows, n, num, den)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one base with one edit each link with the base and not always with each other."""
    monkeypatch.setattr(ngram_join, "BLOCK", 50)
    r = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    rows = [(0, " ".join(base))]
    for i in range(1, 200):
        w = list(base)
        w[r.randrange(90)] = f"x{i}"
        if i % 3 == 0:
            w[r.randrange(90)] = f"y{i}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=90, den=100).collect()}
    assert got == {d: c for d, (_, c, _) in brute(rows, 3, 90, 100).items()}


def test_null_and_repeated_ids_and_empty_tables(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text + " i"), (9, "z")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_components(df).collect())
    assert got == [(-1, 6, 5), (5, 6, 5), (5, 6, 5), (9, 1, 9), (9, 7, 9)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_components(empty).count() == 0
    assert ngram_components(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()[1]["component_id"] == 2


def test_keep_one_of_each_leaves_columns(spark):
    rows = corpus(7)
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA)
    kept = keep_one_of_each(df)
    want = {d for d, (_, c, _) in brute(rows, 5, 80, 100).items() if c == d}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == want


def test_shingles_of_a_very_long_text():
    text = " ".join(str(i % 5000) for i in range(300_000)).encode()
    h, first = shingle_sets(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), 3)
    assert first.tolist() == [0, len(shingles(text.decode(), 3))]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, None), (401, 400), (400, 401)]
    got = {}
    for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(61)), list(range(100, 160)), [400, 401]]
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_prefixes_are_shuffled_in_shares_and_sketches_go(spark, monkeypatch):
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(30)]
    rows = [(2 * i + j, " ".join(t[: 120 - j])) for i, t in enumerate(texts) for j in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []

    def spill(df, what, f=ngram_join._spill):
        out = f(df, what)
        kept.append((what, out, out.count() if what == "join-met" else 0))
        return out

    monkeypatch.setattr(ngram_join, "_spill", spill)
    got = sorted(map(tuple, ngram_join.ngram_link_counts(df).collect()))
    met = [n for what, _, n in kept if what == "join-met"]
    assert sum(met) > 100 and max(met) < sum(met) / 2
    sketches = [out._wordtide_path.removeprefix("file:") for _, out, _ in kept if "cells" in out.columns]
    assert sketches and not any(map(os.path.exists, sketches))
    assert got == sorted(map(tuple, ngram_join.ngram_link_counts(df, shares=1).collect()))
    assert [(r[0], r[2], r[4]) for r in got] == [(d, d // 2 * 2, 1) for d, _ in rows]
