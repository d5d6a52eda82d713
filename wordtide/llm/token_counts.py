"""Token counts by a map-side two-tier lookup: no pre-token is ever shuffled.

Tier one is a compact hash table of frequent pre-tokens' lengths, broadcast to every worker; tier two is the worker's own cache,
which encodes what it misses. Counts are those of the tokenizers library without added special tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import text_table

#: Entries of the broadcast table at most (12 bytes each), and heavy hitters that a task keeps. Both bound memory and change no count:
#: what isn't in the table is encoded by the worker.
FREQUENT, KEPT = 1 << 16, 1 << 15


def frequent_lengths(docs: DataFrame, json: str, classes: bytes, entries: int = FREQUENT, kept: int = KEPT) -> dict[str, np.ndarray]:
    """The hash table of tier one: hashes and lengths of the pre-tokens that are frequent in all of docs(text).

    Each task counts every pre-token of its texts and keeps the most frequent ones, lossily: when more than 2 x kept are held, the counts
    of the (kept + 1)-th is taken off all, as in a Misra-Gries summary. Only summaries, of a fixed size, leave a task."""
    sent = docs.sparkSession.sparkContext.broadcast((json, classes, None))

    def pieces(batches):
        enc = bpe.worker_encoder(sent)
        keys, counts, names = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)
        for b in batches if enc.fast else ():
            texts = [p for t in bpe.texts_of(b.column(0)) if t for p in bpe.parts_of(t)]
            for i, j in bpe.chunks(texts):
                whole = "".join(texts[i:j])
                cp = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
                if (enc.classes[cp] == bpe.UNKNOWN).any():  # those go to the library in any case
                    continue
                lens = np.fromiter(map(len, texts[i:j]), dtype=np.int64)
                s = bpe.piece_starts(cp, np.cumsum(lens) - lens, enc.classes)
                e = np.append(s[1:], len(cp))
                h = bpe.span_hashes(lambda a, b, cp=cp: enc.values[cp[a:b]], len(cp), s, e)
                ok = np.flatnonzero((e - s <= bpe.LONGEST) & (h != 0))
                u, at, n = np.unique(h[ok], return_index=True, return_counts=True)
                at = ok[at]
                place = np.searchsorted(keys, u)
                old = keys[np.minimum(place, len(keys) - 1)] == u if len(keys) else np.zeros(len(u), dtype=bool)
                counts[place[old]] += n[old]
                new = np.flatnonzero(~old)
                own = np.array([whole[x:y] for x, y in zip(s[at[new]].tolist(), e[at[new]].tolist(), strict=True)] + [None], dtype=object)[:-1]
                keys, counts, names = (np.insert(x, place[new], y) for x, y in ((keys, u[new]), (counts, n[new]), (names, own)))
                if len(keys) > 2 * kept:
                    counts = counts - np.partition(counts, len(counts) - kept - 1)[len(counts) - kept - 1]
                    live = counts > 0
                    keys, counts, names = keys[live], counts[live], names[live]
        if len(keys):
            top = np.sort(np.lexsort((keys, -counts))[:kept])
            sizes, _ = enc.merger.merge([x.encode() for x in names[top]])  # only of what is kept
            yield pa.RecordBatch.from_pydict({"h": pa.array(keys[top].view(np.int64)), "size": pa.array(sizes.astype(np.int32)), "n": pa.array(counts[top])})

    rows = docs.select("text").mapInArrow(pieces, "h long, size int, n long")
    top = rows.groupBy("h", "size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(entries).collect()
    cut = lambda k, kind: np.array([r[k] for r in top], dtype=kind)
    return {"keys": cut(0, np.int64).view(np.uint64), "sizes": cut(1, np.int32), "ids": np.zeros(0, dtype=np.int32)}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json", path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are counted each on its own; an empty
    table gives an empty one; other columns are not read. A special token's string inside a text counts as the library counts it."""
    spark = docs.sparkSession
    rows = text_table(docs, id_col, text_col)
    if path is None and name.endswith(".model"):
        return _by_sentencepiece(rows, name, limit)
    json, classes, _ = bpe.parts_to_ship(name, path)
    sent = spark.sparkContext.broadcast((json, classes, frequent_lengths(rows, json, classes)))

    def count(batches):
        enc = bpe.worker_encoder(sent)
        for b in batches:
            texts = bpe.texts_of(b.column(1))
            for i, j in bpe.chunks(texts):
                n, _ = enc.encode(texts[i:j], with_ids=False)
                yield _counted(b.column(0).slice(i, j - i), texts[i:j], n, limit)

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _counted(ids: pa.Array, texts: list[str], n: np.ndarray, limit: int) -> pa.RecordBatch:
    size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
    return pa.RecordBatch.from_pydict({"doc_id": ids, "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n.astype(np.int64)), "over_limit": pa.array(n > limit)})


def _by_sentencepiece(rows: DataFrame, name: str, limit: int) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        sent = rows.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=sent.value)
        for b in batches:
            texts = bpe.texts_of(b.column(1))
            for i, j in bpe.chunks(texts):
                n = np.array([len(x) for x in model.encode(texts[i:j], num_threads=1)], dtype=np.int64)
                yield _counted(b.column(0).slice(i, j - i), texts[i:j], n, limit)

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
