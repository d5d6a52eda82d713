"""Shares of many small sources in packed windows, by source."""

import numpy as np
import pytest

from wordtide.llm.packing import pack, phases

from .test_tokens import check_packing, table


@pytest.mark.parametrize("amounts", [[500] * 60, [20_000] + [13 + k % 7 for k in range(300)], [7, 1, 4000], [3] * 5000])
def test_every_source_keeps_its_share(amounts):
    [phase], _ = phases({f"s{k}": a for k, a in enumerate(amounts)}, None, 256)
    total, last = sum(amounts), np.zeros(len(amounts), dtype=np.int64)
    for w in range(1, phase.windows + 1):
        got = phase.served(w)[0]
        assert got.sum() == min(256 * w, total) and (got >= last).all()
        ideal = np.array(amounts) * got.sum() / total
        small = np.array(amounts) * 44 < total
        assert np.abs(got - ideal)[small].max(initial=0) < 2
        assert np.abs(got - ideal)[~small].max(initial=0) < 2 + len(amounts) ** 0.5 / 2
        last = got
    for q in (0, len(amounts) - 1):
        assert sum(n for n, _, _ in phase.pieces(q, 0, amounts[q])) == amounts[q]


def test_pieces_of_sources_below_a_token_a_window(spark):
    texts = ["alpha beta " * 300] * 40 + ["of the"] * 120
    sources = ["hot"] * 40 + [f"s{k}" for k in range(120)]
    got = pack(table(spark, texts, sources).repartition(4), window=256).collect()
    padding, _ = check_packing(texts, got, 256)
    assert padding == 0 and {r["queue"] for r in got} == set(sources)
