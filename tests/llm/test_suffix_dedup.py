"""Suffix sorting against sorting, and removal of repeats against looking at every window."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordtide.llm import suffix_dedup as S
from wordtide.llm.suffix_sort import suffix_array

SCHEMA = "text string, doc_id long, n_bytes int, tie string, block int"  # clashing extra columns


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.integers(1, 3))
def test_suffix_array(xs, times):
    xs = xs * times
    assert suffix_array(np.array(xs, dtype=np.int64)).tolist() == sorted(range(len(xs)), key=lambda i: xs[i:])


@pytest.mark.parametrize("xs", [[5] * 3000, [5, 6] * 1500, list(range(1, 3000)), list(range(3000, 0, -1))])
def test_suffix_array_of_long_runs(xs):
    assert suffix_array(np.array(xs)).tolist() == sorted(range(len(xs)), key=lambda i: xs[i : i + 3001])


def brute(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha) of rows(doc_id, text); ids in order, null last."""
    data = [((t or "").encode(), d) for d, t in rows]
    seen, out = set(), []
    for b, d in sorted(data, key=lambda x: (x[1] is None, x[1] or 0)):
        off = [False] * len(b)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                off[i : i + length] = [True] * length
            seen.add(w)
        spans = sum(x and (not i or not off[i - 1]) for i, x in enumerate(off))
        out.append((d, len(b), sum(off), spans, hashlib.sha256(bytes(x for x, o in zip(b, off, strict=True) if not o)).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, parts=3, length=100):
    df = spark.createDataFrame([(t, d, 7, "x", 1) for d, t in rows], SCHEMA).repartition(parts)
    return sorted([tuple(r) for r in S.dedup_digest(df, length=length).collect()], key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß日") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.randint(20, 80))) for _ in range(6)]
    rows = []
    for d in rnd.sample(range(1000), n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(passages)
            parts.append(rnd.choice([p, p[rnd.randint(0, 40) :], p[: rnd.randint(20, 200)], " ".join(word() for _ in range(30)), p.replace(rnd.choice("abc"), "x", 1)]))
        rows.append((d, " ".join(parts)))
    return rows


ODD = [(5000, None), (5001, ""), (5002, "a" * 99), (5003, "a" * 100), (5004, "a" * 350), (5005, "ab" * 200), (5006, "q" * 30), (5007, "é" * 120), (None, "a" * 220), (5008, "b" * 99), (5009, "b" * 101)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_repeated_window_goes(spark, seed):
    rows = corpus(seed) + ODD
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("chunk,block,anchors,contexts,hot", [(64, 300, 50, 8, 1 << 11), (200, 1 << 21, 1 << 18, 1 << 11, 3), (1 << 17, 900, 1 << 18, 2, 2)])
def test_small_blocks_groups_and_strings_taken_apart(spark, monkeypatch, chunk, block, anchors, contexts, hot):
    for name, value in zip(("CHUNK", "BLOCK", "ANCHORS", "CONTEXTS", "HOT"), (chunk, block, anchors, contexts, hot), strict=True):
        monkeypatch.setattr(S, name, value)
    rows = corpus(7) + ODD
    assert got(spark, rows) == brute(rows)


def test_one_passage_in_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 4)
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(130))
    tail = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 60)))
    rows = [(d, tail() + passage[rnd.randint(0, 10) :] + tail()) for d in range(40)]
    assert got(spark, rows) == brute(rows)


def test_other_lengths(spark):
    rows = corpus(11, 30)
    assert got(spark, rows, length=60) == brute(rows, 60)
    with pytest.raises(ValueError):
        S.dedup_digest(spark.createDataFrame([], SCHEMA), length=50)


def test_repeated_rows_and_ids(spark):
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefghij ") for _ in range(150))
    rows = [(1, text), (1, text), (2, text), (2, "x" + text)]
    out = got(spark, rows)
    assert sorted(r[:4] for r in out) == [(1, 150, 0, 0), (1, 150, 150, 1), (2, 150, 150, 1), (2, 151, 150, 1)]


def test_empty_table(spark):
    assert S.dedup_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_text_comes_back_without_repeats(spark):
    rnd = random.Random(2)
    a, b = "".join(rnd.choice("abcdefgh") for _ in range(150)), "0123456789" * 9
    df = spark.createDataFrame([(b + a, 2), (a, 1)], "text string, doc_id long")
    assert {r["doc_id"]: r["kept"] for r in S.deduplicate(df).collect()} == {1: bytearray(a.encode()), 2: bytearray(b.encode())}
