"""All links of the n-gram join against brute force over all pairs."""

import pytest

from wordtide.llm import ngram_join
from wordtide.llm.ngram_join import ngram_link_counts, ngram_links

from .test_join import SCHEMA, corpus, shingles


@pytest.mark.parametrize("seed,n,num,den,chunk", [(1, 3, 90, 100, 128), (3, 3, 50, 100, 3)])
def test_every_link_comes_out(spark, monkeypatch, seed, n, num, den, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", chunk)  # also where components are dealt in cells
    monkeypatch.setattr(ngram_join, "COLUMNS", 64)
    rows = corpus(seed)
    sets = [frozenset(shingles(t, n)) for _, t in rows]
    first, pairs, degree = {}, set(), {d: 0 for d, _ in rows}
    for (d, _), s in zip(rows, sets, strict=True):
        first[s] = min(d, first.get(s, d))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                degree[rows[i][0]] += 1
                degree[rows[j][0]] += 1
                if a != b:
                    (x, p), (y, q) = sorted([(first[a], a), (first[b], b)], key=lambda t: t[0])
                    pairs.add((x, y, len(p), len(q), len(a & b)))
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in ngram_links(df, n=n, num=num, den=den).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 20
    assert {r["doc_id"]: r["n_links"] for r in ngram_link_counts(df, n=n, num=num, den=den).collect()} == degree
