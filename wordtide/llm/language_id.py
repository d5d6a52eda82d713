"""Language identification of documents that may mix languages.

Each language has a model of character n-grams (bytes of lower-cased words with a blank on each side, hashed into a fixed table).
A document is a mixture: each of its words comes from one language, with proportions that expectation-maximisation estimates from
the words' n-gram likelihoods. Which languages take part is chosen by penalised likelihood (BIC): starting from the best single one,
every other language that could pay its price is tried, most promising first, and stays if it raises the likelihood by more than its
parameters cost. There is no bound on how many stay.

Words are scored once a slice of text, however often they occur, and documents are fitted on their distinct words and counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, merge_arrays, mix64, packed_counts, slices, span_hashes, utf8_buffers

#: Hashed n-grams; n-gram lengths in bytes; labelled documents drawn for each language (in expectation); bytes of a word, of which longer
#: runs are cut into several; bytes of text taken at once (a multiple of that); rounds of expectation-maximisation.
SLOTS_BITS, LENGTHS, PER_LANGUAGE, WORD_BYTES, BYTES, ROUNDS = 16, (2, 3, 4), 4000, 1000, 256_000, 12
#: Overlapping n-grams of a word repeat evidence; their log likelihoods are scaled by this.
TEMPER = 1 / 3
#: Likelihoods (word x language) held at once, and languages at most: more labels than that are an error, none is left out.
MATRIX, MOST_LANGUAGES = 1 << 22, 4096

_WORD = np.zeros(256, dtype=bool)
_WORD[97:123] = _WORD[128:] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased UTF-8 start and end."""
    ok = np.concatenate([[False], _WORD[data], [False]])
    s, e = np.flatnonzero(ok[1:] & ~ok[:-1]), np.flatnonzero(ok[:-1] & ~ok[1:])
    parts = -(-(e - s) // WORD_BYTES)
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        s, e = np.repeat(s, parts) + nth * WORD_BYTES, np.repeat(e, parts)
        e = np.minimum(e, s + WORD_BYTES)
    return s, e


def word_grams(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the n-grams of each word, words one after another; first of each word). Every word has some."""
    size = e - s
    if not len(s):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    at = np.cumsum(size + 1) - size  # a blank before each word and behind the last
    d = np.zeros(int((size + 1).sum()) + 4, dtype=np.uint32)
    inside = np.repeat(s - at, size) + (where := np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum()))
    d[where] = data[inside]
    ok = d > 0
    m = len(d) - 4
    word = np.cumsum(ok[:m] & ~np.concatenate([[False], ok[: m - 1]])) - 1
    slots, owner = [], []
    for n in LENGTHS:
        g, whole = np.zeros(m, dtype=np.uint64), np.ones(m, dtype=bool)
        for k in range(n):
            g |= d[k : k + m].astype(np.uint64) << np.uint64(8 * k)
            if 0 < k < n - 1:
                whole &= ok[k : k + m]
        whole &= (ok[:m] | ok[1 : m + 1]) if n == 2 else ok[1 : m + 1]
        at = np.flatnonzero(whole)
        slots.append((((g[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS_BITS)).astype(np.int32))
        owner.append(word[np.where(ok[at], at, at + 1)])
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return slots[order], np.searchsorted(owner[order], np.arange(len(s)))


def _parts(data: np.ndarray):
    """Lower-cased UTF-8 in parts of up to BYTES that cut no word, except where words of over WORD_BYTES are cut anyway."""
    a = 0
    while a < len(data):
        b = min(a + BYTES, len(data))
        if b < len(data):
            gaps = np.flatnonzero(~_WORD[data[a:b]])
            b = a + int(gaps[-1]) + 1 if len(gaps) else b
        yield data[a:b]
        a = b


def _batches(column: pa.Array, most: int = BYTES):
    _, offsets = utf8_buffers(column)
    for i, j in slices(offsets, most):
        yield i, [t or "" for t in column.slice(i, j - i).to_pylist()]


def _counted_words(texts: list[str]):
    """Distinct words of the texts and what each document has of them: (bytes, hash, start and end of each distinct word, document,
    word number and count of every pair). Words lie in order of hashes, pairs in order of documents."""
    raw = [t.lower().encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    del raw
    held, at, docs, words, counts = [], 0, [], [], []
    for part in _parts(data):
        s, e = words_of(part)
        if len(s):
            h = span_hashes(lambda a, b, part=part: _BYTE[part[a:b]], len(part), s, e)
            doc = np.searchsorted(ends, s + at, side="right")
            u, one, back = np.unique(h, return_index=True, return_inverse=True)
            pair, n = np.unique(doc * len(u) + back, return_counts=True)
            held.append((u, s[one] + at, e[one] + at))
            docs.append(pair // len(u))
            words.append(u[pair % len(u)])
            counts.append(n)
        at += len(part)
    if not held:
        none = np.zeros(0, dtype=np.int64)
        return data, none, none, none, none, none, none
    u, one = np.unique(np.concatenate([x[0] for x in held]), return_index=True)
    s, e = (np.concatenate([x[k] for x in held])[one] for k in (1, 2))
    doc, word, n = np.concatenate(docs), np.searchsorted(u, np.concatenate(words)), np.concatenate(counts)
    if len(held) > 1:  # a word of one document in several parts
        pair, back = np.unique(doc * len(u) + word, return_inverse=True)
        doc, word, n = pair // len(u), pair % len(u), np.bincount(back, weights=n).astype(np.int64)
    return data, u, s, e, doc, word, n


def held_out(id_col) -> F.Column:
    """The documents that no model learns from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (slot x language), from labelled documents outside the held-out fifth: all of a language's,
    or of a frequent one a hashed draw of about per_language. Counting is distributed; the driver gets a table of fixed size."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("id")), F.lit(False)))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels: these are hardly languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1 << SLOTS_BITS, 0), dtype=np.float32)
    rate = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))]), F.col("lang"))
    # (hash of the id) below the language's rate; ids decide, so a draw is the same however the table is split
    drawn = rows.where(F.col("lang").isin(langs) & ((F.xxhash64("id", F.lit(5)).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))) < rate))
    number = {k: i for i, k in enumerate(langs)}
    cells = 1 << SLOTS_BITS

    def count(batches):
        held = np.zeros(len(langs) * cells, dtype=np.uint32)
        for b in batches:
            of = np.array([number[x] for x in b.column(1).to_pylist()], dtype=np.int64)
            for i, texts in _batches(b.column(0)):
                data, _, s, e, doc, word, n = _counted_words(texts)
                slots, first = word_grams(data, s, e)
                size = np.diff(np.append(first, len(slots)))
                k = size[word]  # n-grams of each pair of document and word
                at = np.repeat(first[word] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                np.add.at(held, np.repeat(of[i + doc] * cells, k) + slots[at], np.repeat(n, k).astype(np.uint32))
        held = held.reshape(len(langs), cells)
        for k in np.flatnonzero(held.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "cells": pa.array([packed_counts(held[k])], pa.binary())})

    got = merge_arrays(drawn.select("text", "lang").mapInArrow(count, "chunk int, cells binary"), "sum")
    logp = np.empty((cells, len(langs)), dtype=np.float32)
    for k in range(len(langs)):
        c = got.get(k, np.zeros(cells)) + 0.1
        logp[:, k] = np.log(c / c.sum())
    return langs, logp


def _likelihoods(data: np.ndarray, s: np.ndarray, e: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log likelihood of every word (row) in every language of logp (column)."""
    slots, first = word_grams(data, s, e)
    return np.add.reduceat(logp[slots], first, axis=0) * np.float32(TEMPER) if len(first) else np.zeros((0, logp.shape[1]), dtype=np.float32)


class Scores:
    """Likelihoods of words in every language, kept for words met before; it starts anew when full, so memory is bounded."""

    def __init__(self, logp: np.ndarray):
        self.logp, self.most = logp, max(1, MATRIX // max(1, logp.shape[1]))
        self._clear()

    def _clear(self):
        self.keys, self.rows = np.zeros(0, dtype=np.uint64), np.zeros((0, self.logp.shape[1]), dtype=np.float32)

    def of(self, u: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """u: distinct hashes in order, at most `most`."""
        if len(self.keys) > self.most:
            self._clear()
        at = np.searchsorted(self.keys, u)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != u) if len(self.keys) else np.arange(len(u))
        if len(new):
            self.rows = np.insert(self.rows, at[new], _likelihoods(data, s[new], e[new], self.logp), axis=0)
            self.keys = np.insert(self.keys, at[new], u[new])
            at = np.searchsorted(self.keys, u)
        return self.rows[at]


def mixtures(texts: list[str], scores: Scores) -> list[list[tuple[int, float]]]:
    """For each text: its languages (numbers) and their shares, largest first; none without a word."""
    out: list[list[tuple[int, float]]] = [[] for _ in texts]
    data, u, s, e, doc, word, n = _counted_words(texts)
    logp = scores.logp
    if not len(doc) or not logp.shape[1]:
        return out
    here, at = np.unique(doc, return_index=True)
    back = np.repeat(np.arange(len(here)), np.diff(np.append(at, len(doc))))
    words = np.add.reduceat(n, at).astype(np.float64)
    price = 2 * np.log(words + 1)  # what a further language must add to the log likelihood

    # The best single language, then what each other one could add to it at most; some words at once if there are many languages.
    step = max(1, MATRIX // (16 * logp.shape[1]))
    whole = scores.of(u, data, s, e) if len(s) <= step else None

    def summed(f) -> np.ndarray:
        if whole is not None:
            return np.add.reduceat(f(whole[word], back) * n[:, None], at, axis=0)
        total = np.zeros((len(here), logp.shape[1]))
        for i in range(0, len(s), step):
            pick = np.flatnonzero((word >= i) & (word < i + step))
            part = _likelihoods(data, s[i : i + step], e[i : i + step], logp)
            for j in range(0, len(pick), step):
                x = pick[j : j + step]
                np.add.at(total, back[x], f(part[word[x] - i], back[x]) * n[x, None])
        return total

    best = np.argmax(summed(lambda ll, _: ll.astype(np.float64)), axis=1)
    gain = summed(lambda ll, of: np.maximum(ll - np.take_along_axis(ll, best[of][:, None], axis=1), 0).astype(np.float64))
    gain[np.arange(len(here)), best] = np.inf
    tries = int((gain > price[:, None]).sum(axis=1).max())
    cand = np.argsort(-gain, axis=1, kind="stable")[:, :tries]
    worth = np.take_along_axis(gain, cand, axis=1) > price[:, None]

    pi = np.zeros((len(here), tries))
    pi[:, 0] = 1.0
    live = np.flatnonzero(worth.sum(axis=1) > 1)  # documents with anything to try
    if len(live):
        mine = np.flatnonzero(np.isin(back, live))
        row = np.searchsorted(live, back[mine])
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        cols, which = np.unique(cand[live][worth[live]], return_inverse=True)
        own = np.zeros((len(live), tries), dtype=np.int64)
        own[worth[live]] = which
        used, word_row = np.unique(word[mine], return_inverse=True)
        ll = whole[used][:, cols] if whole is not None else _likelihoods(data, s[used], e[used], np.ascontiguousarray(logp[:, cols]))
        ll = np.take_along_axis(ll[word_row], own[row], axis=1).astype(np.float64)
        p = np.exp(ll - ll.max(axis=1, keepdims=True)) * worth[live][row] + 1e-300
        weight, total = n[mine].astype(np.float64), words[live]
        now = pi[live]
        like = np.add.reduceat(weight * np.log((p * now[row]).sum(axis=1)), first)
        for k in range(1, tries):
            asks = worth[live, k]
            trial = ((now > 0) | (np.arange(tries) == k)).astype(np.float64)
            trial /= trial.sum(axis=1, keepdims=True)
            for _ in range(ROUNDS):
                r = p[:, : k + 1] * trial[row, : k + 1]
                r *= (weight / r.sum(axis=1))[:, None]
                trial[:, : k + 1] = np.add.reduceat(r, first, axis=0) / total[:, None]
            found = np.add.reduceat(weight * np.log((p * trial[row]).sum(axis=1)), first)
            better = asks & (found - like > price[live])
            now[better], like[better] = trial[better], found[better]
        pi[live] = now
    for d, c, x in zip(here.tolist(), cand.tolist(), pi.tolist(), strict=True):
        out[d] = sorted(((k, y) for k, y in zip(c, x, strict=True) if y > 0), key=lambda t: -t[1])
    return out


def _judge(texts: list[str], names: list[str], scores: Scores):
    for t, found in zip(texts, mixtures(texts, scores), strict=True):
        if found and any(map(str.isalpha, t)):
            yield names[found[0][0]], min(1.0, round(found[0][1], 6)), [{"lang": names[k], "share": round(y, 6)} for k, y in found]
        else:
            yield "und", 0.0, []


def _at_once(names: list[str]) -> int:
    """Bytes of short documents taken together: fewer where there are many languages."""
    return max(16_000, BYTES * 16 // max(16, len(names)))


_MIX = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages for every row of docs.

    lang_pred is the language of most words, score their share, languages the chosen mixture. Predictions come from texts alone. A
    null text, or one without a letter, is `und` with score 0; so is every row if no row is labelled. Repeated rows are judged each
    on its own; a null doc_id is not held out; an empty table gives an empty result; other columns are not read."""
    names, logp = train(docs, id_col, text_col, lang_col, per_language)
    sent, at_once = docs.sparkSession.sparkContext.broadcast(logp), _at_once(names)  # 256 KB a language

    def judge(batches):
        scores = Scores(sent.value)
        for b in batches:
            for i, texts in _batches(b.column(2), at_once):
                got = list(_judge(texts, names, scores))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(i, len(texts)), "held_out": b.column(1).slice(i, len(texts)), "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64()), "languages": pa.array([g[2] for g in got], _MIX)})

    c = F.col(f"`{id_col}`")
    rows = docs.select(c.cast("long").alias("doc_id"), F.coalesce(held_out(c), F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs whose language can be told, all columns as they are but lang_col, which becomes the prediction. Rows that are
    `und` are rejected. One pass over the rows, without a shuffle."""
    names, logp = train(docs, id_col, text_col, lang_col, per_language)
    sent, at_once = docs.sparkSession.sparkContext.broadcast(logp), _at_once(names)
    order = docs.columns
    text_at, lang_at = order.index(text_col), order.index(lang_col)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == lang_col else f.dataType) for f in docs.schema.fields])

    def judge(batches):
        scores = Scores(sent.value)
        for b in batches:
            for i, texts in _batches(b.column(text_at).cast(pa.string()), at_once):
                found = [g[0] for g in _judge(texts, names, scores)]
                part = b.slice(i, len(texts))
                part = part.set_column(lang_at, lang_col, pa.array(found, pa.string()))
                yield part.filter(pa.array([x != "und" for x in found]))

    return docs.mapInArrow(judge, schema)
