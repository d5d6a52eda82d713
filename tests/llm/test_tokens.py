"""Token counts, token files and packing against the tokenizers library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wordtide.llm import bpe
from wordtide.llm.packing import pack, phases
from wordtide.llm.token_counts import token_counts
from wordtide.llm.token_files import TokenFile, TokenFileWriter, pack_blocks, read_token_files, token_file_digest, unpack_blocks, write_token_files

JSON = bpe.tokenizer_json()
LIBRARY = Tokenizer.from_str(JSON)
ENCODER = bpe.Encoder(JSON)
SCHEMA = "doc_id long, text string, source string, n_tokens int, ids int"  # clashing extra columns
ODD = ["", None, " ", "\n\n  \n", "don't we'll I'M 'tis ''s x's\n", "<|endoftext|>", "a<|endoftext|> b", "日本語 テキスト 😀😀 𝒳 𠀀", "é" * 300, "a" * 5000, "1234 ٣٤ ½", "x  y \t z\r\n", "tail  "]


def want(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def table(spark, texts, sources=None):
    rows = [(i, t, (sources or ["s"])[i % len(sources or ["s"])], 7, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_encoder_is_the_library(texts):
    counts, ids = ENCODER.encode(texts)
    assert ids.tolist() == [x for t in texts for x in want(t)]
    assert counts.tolist() == [len(want(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 's'tmdrevl\n\t12!?é\xa0　", max_size=80))
def test_encoder_on_blanks_and_contractions(text):
    assert ENCODER.encode([text])[1].tolist() == want(text)


def test_encoder_small_cache_and_long_texts(monkeypatch):
    random.seed(3)
    texts = ["".join(random.choice("abcdefgh \n'") for _ in range(400)) for _ in range(40)]
    small = bpe.Encoder(JSON, ENCODER.classes, slots=1 << 8)
    assert small.encode(texts)[1].tolist() == [x for t in texts for x in want(t)]
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    assert ENCODER.encode(texts)[1].tolist() == [x for t in texts for x in want(t)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    got = token_counts(table(spark, ODD), name=name, limit=5).orderBy("doc_id").collect()
    if name.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        size = [len(m.encode(t or "")) for t in ODD]
    else:
        t_ = Tokenizer.from_file(public_tokenizers.path(name))
        size = [len(t_.encode(t or "", add_special_tokens=False).ids) for t in ODD]
    assert [tuple(r) for r in got] == [(i, len((t or "").encode()), n, n > 5) for i, (t, n) in enumerate(zip(ODD, size, strict=True))]
    assert token_counts(table(spark, []), name=name).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=3000))
def test_blocks_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    blocks = pack_blocks(ids)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[:-1].astype(np.int64)
    assert (unpack_blocks(b"".join(blocks), starts) == ids).all() if len(ids) else not blocks


def test_outliers_go_to_exceptions():
    ids = np.arange(1024, dtype=np.uint32) % 16
    ids[[3, 700]] = 50_000
    assert len(pack_blocks(ids)[0]) < 1024 * 4 // 8 + 40


def test_file_random_access(tmp_path):
    w = TokenFileWriter(str(tmp_path / "a.pfor"))
    docs = [np.arange(n, dtype=np.uint32) * 7 % 50_000 for n in (0, 5, 3000, 1, 0, 1024, 0)]
    w.add(list(range(6)) + [None], np.array([len(d) for d in docs]), np.concatenate(docs))
    w.close()
    f = TokenFile(str(tmp_path / "a.pfor"))
    assert f.doc_ids == [0, 1, 2, 3, 4, 5, None]
    assert [f.ids(k).tolist() for k in range(7)] == [d.tolist() for d in docs]
    got = {}
    for k, part, _ in f.documents():
        got[k] = got.get(k, []) + part.tolist()
    assert [got[k] for k in range(7)] == [d.tolist() for d in docs]


def test_token_files_are_an_exact_round_trip(spark):
    docs = table(spark, ODD * 3).repartition(3)
    got = token_file_digest(docs).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, ODD * 3, strict=True):
        ids = want(t) + [0]
        assert tuple(r)[1:] == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert token_file_digest(table(spark, [])).count() == 0


def test_token_files_with_null_and_repeated_ids(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a"), (2, "a"), (2, "b")], "doc_id long, text string")
    rows = read_token_files(write_token_files(docs, str(tmp_path))).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2, 2]


def check_packing(texts, got, window):
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert sorted(pieces) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids, at = want(t) + [1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sequences


@pytest.mark.parametrize("sources", [["a"], ["a", "a", "b", None], [f"s{i}" for i in range(60)]])
def test_packing_places_every_id_once(spark, sources):
    random.seed(5)
    texts = ODD + [" ".join(random.choice(["alpha", "beta", "of", "the"]) for _ in range(random.randint(0, 300))) for _ in range(200)]
    got = pack(table(spark, texts, sources).repartition(5), window=256).collect()
    padding, sequences = check_packing(texts, got, 256)
    assert padding == 0
    total, share = sum(r["length"] for r in got), {}
    for r in got:
        share[r["queue"]] = share.get(r["queue"], 0) + r["length"]
    for rows in sequences.values():
        if sum(r["length"] for r in rows) == 256:
            for q in share:
                # the largest queue also takes what the others' rounding leaves
                assert abs(sum(r["length"] for r in rows if r["queue"] == q) - 256 * share[q] / total) < 1 + (len(share) if share[q] == max(share.values()) else 1)
    assert pack(table(spark, [])).count() == 0


def test_packing_to_targets(spark):
    texts = ["alpha beta " * 200] * 20
    got = pack(table(spark, texts, ["a", "b", "b", "b"]), window=128, targets={"a": 1.0, "b": 1.0}).collect()
    padding, sequences = check_packing(texts, got, 128)
    assert padding == 0
    early = [rows for s, rows in sequences.items() if s < 5]
    assert all(abs(sum(r["length"] for r in rows if r["queue"] == "a") - 64) <= 1 for rows in early)


def test_phases_cover_every_token():
    streams, begins = phases({"a": 1000, "b": 10, "c": 0, "d": 333}, {"a": 1, "b": 1, "d": 2}, 64)
    assert [sum(p.amounts[k] for p in streams) for k in range(4)] == [1000, 10, 0, 333]
    assert begins[0] == {"a": 0, "b": 0, "c": 0, "d": 0}


def test_frequent_table_is_of_the_whole_corpus(spark):
    from wordtide.llm import token_counts as C

    r = random.Random(2)
    texts = ["".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(1500)] + [("common words here " * 3).strip()] * 500
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").coalesce(2)
    json, classes, _ = bpe.parts_to_ship("byte_bpe_50k.json", None)
    enc = bpe.Encoder(json)

    def hash_of(piece):
        cp = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32)
        return int(bpe.span_hashes(lambda a, b: enc.values[cp[a:b]], len(cp), np.array([0]), np.array([len(cp)]))[0])

    got = C.frequent_lengths(docs, json, classes, entries=4, kept=50)
    want = {hash_of(p): len(enc.tok.encode(p, add_special_tokens=False).ids) for p in (" words", " here", " common", "common")}
    assert {int(k): int(v) for k, v in zip(got["keys"], got["sizes"], strict=True)} == want
