"""Searches against brute force."""

import numpy as np
import pytest

from wordtide.llm import vectors
from wordtide.llm.exact_topk import exact_top
from wordtide.llm.permutation_index import Inverted, nearest

SCHEMA = "vec_id long, embedding array<float>, score double, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], 0.0, 1) for i, x in rows], SCHEMA)


ODD = [(1000, None), (1020, []), (1040, [1.0, None]), (1060, [float("nan")] * 8), (1080, [float("inf")] + [0.0] * 7), (1100, [1.0] * 5)]


def vectors_of(seed, n, d=8):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)).astype(np.float32)
    v[5:15] = v[4:5] if n > 4 else v[5:15]  # ties
    return [(i, x.tolist()) for i, x in enumerate(v)]


def brute(rows, k, score):
    rows = sorted((i, np.array(x, dtype=np.float32).astype(np.float64)) for i, x in rows)
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            found = sorted(((-score(x, y), i) for i, y in rows if i != q))[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("n,rows,queries,scale", [(130, 8192, 1024, 64.0), (130, 17, 3, 64.0), (130, 40, 5, 1e7), (130, 40, 5, 1e8), (7, 8192, 1024, 64.0), (1, 8192, 1024, 64.0)])
def test_exact_top_is_brute_force(spark, monkeypatch, n, rows, queries, scale):
    monkeypatch.setattr(vectors, "QUERIES", queries)
    data = vectors_of(n + rows, n) + [(2000, [0.0] * 8)]
    got = result(exact_top(table(spark, data + ODD), scale=scale, rows_a_block=rows))
    whole = lambda x: [int(np.floor(scale * y)) for y in x]
    assert got == brute(data, 20, lambda x, y: sum(a * b for a, b in zip(whole(x), whole(y), strict=True)))


@pytest.mark.parametrize("nodes", [1, 3, 8])
def test_any_number_of_nodes_gives_the_same(spark, nodes):
    data = vectors_of(5, 300)
    assert result(exact_top(table(spark, data), nodes=nodes, rows_a_block=60)) == result(exact_top(table(spark, data)))


def test_threshold_ships_few_entries_and_copies_none_beyond_k(spark):
    """A third of all rows are copies of one vector, and a query too; nodes ship some entries a query, not a third of the table."""
    r = np.random.default_rng(9)
    v = r.normal(size=(1500, 8)).astype(np.float32)
    v[::3] = v[0]
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    shipped = []
    got = result(exact_top(table(spark, data), shipped=shipped, rows_a_block=400))
    whole = lambda x: [int(np.floor(64.0 * y)) for y in x]
    assert got == brute(data, 20, lambda x, y: sum(a * b for a, b in zip(whole(x), whole(y), strict=True)))
    assert 0 < sum(shipped) < 0.3 * 75 * 1000


def test_lengths_do_not_spoil_recall(spark):
    """Vectors of very unequal length: the nearest by inner product are mostly long ones."""
    r = np.random.default_rng(4)
    v = (r.normal(size=(6000, 16)) * np.exp(r.normal(size=(6000, 1)))).astype(np.float32)
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    got = result(nearest(table(spark, data)))
    ids = [i for i in range(len(v)) if i % 20 == 0]
    s = v[ids].astype(np.float64) @ v.astype(np.float64).T
    s[np.arange(len(ids)), ids] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    recall = [len({i for _, i, _ in got[q]} & set(w.tolist())) / 20 for q, w in zip(ids, want, strict=True)]
    assert np.mean(recall) >= 0.9


def test_lengths_beyond_doubles(spark):
    rows = [(i, [m, 0.0]) for i, m in enumerate([1e300, 1e-300, 1.0, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {q: [i for _, i, _ in r] for q, r in result(nearest(df)).items()} == {0: [2, 1, 3]}


def test_nearest_finds_what_brute_force_finds(spark):
    data = vectors_of(3, 900, 16)
    got = result(nearest(table(spark, data + [(2000, [0.0] * 16)] + ODD), share=0.4, least=5, pivots=64, near=24))
    want = brute(data, 20, lambda x, y: float((x * y).sum()))
    assert got.keys() == want.keys()
    recall = np.mean([len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    by = dict(data)
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        for _, i, s in rows:
            assert s == pytest.approx(np.dot(np.array(by[q], np.float64), np.array(by[i], np.float64)), rel=1e-5)


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_few_vectors(spark, n):
    data = vectors_of(1, 20)[:n]
    want = brute(data, 20, lambda x, y: float((x * y).sum()))
    got = result(nearest(table(spark, data)))
    assert {q: [i for _, i, _ in r] for q, r in got.items()} == {q: [i for _, i, _ in r] for q, r in want.items() if r}


def test_repeated_ids_count_once(spark):
    data = vectors_of(2, 40)
    assert result(exact_top(table(spark, data + data))) == result(exact_top(table(spark, data)))


def test_closeness_falls_with_footrule_distance():
    r = np.random.default_rng(0)
    perm = np.array([r.permutation(30)[:8] for _ in range(50)])
    place = np.full((50, 30), 8)
    np.put_along_axis(place, perm, np.arange(8)[None, :].repeat(50, 0), axis=1)
    files = Inverted(perm, 30)
    for q in range(5):
        assert (np.abs(place - place[q]).sum(axis=1) == 8 * 9 - 2 * files.closeness(perm[q])).all()
