"""Mixture-controlled packing of documents into fixed windows.

Each source is a queue of its own, and every window takes from each queue its target share of tokens: deficit round-robin with one
round a window, whatever is owed being carried. Token x of a queue of a tokens is due at time (x + 1 - phase) / a, and tokens are
served as they fall due, so what a queue has been served after w windows has a closed form: floor(a * v + phase) for the time v at which
those of all queues come to w windows, also for queues of less than a token a window. Phases in [0, 1) are spread over the queues, lest
many small ones fall due together. Any task can place its own documents without hearing from the others. Documents are cut where a queue's turn ends."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import spill

WINDOW = 2048


class Phase:
    """Tokens of each queue that are mixed at one set of shares until the first queue runs dry."""

    def __init__(self, amounts: list[int], window: int, first_sequence: int):
        self.amounts, self.window = amounts, window
        self.sizes = np.array(amounts, dtype=np.int64)
        self.phases = np.empty(len(amounts))
        self.phases[np.argsort(-self.sizes, kind="stable")] = (0.5 + np.arange(len(amounts)) * 0.6180339887498949) % 1
        self.total = sum(amounts)
        self.windows = -(-self.total // window)
        self.first = first_sequence
        rest = self.total - (self.windows - 1) * window if self.total else 0
        # The last, short window is cut into sequences of powers of two, which need no padding.
        self.tail = [0]
        while rest:
            self.tail.append(self.tail[-1] + (p := 1 << (rest.bit_length() - 1)))
            rest -= p
        self.next = first_sequence + max(0, self.windows - 1) + len(self.tail) - 1
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def due(self, v: float) -> np.ndarray:
        """Tokens of each queue that are due by time v."""
        return np.clip(np.floor(self.sizes * v + self.phases).astype(np.int64), 0, self.sizes)

    def served(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that each queue has given to the first w windows, and their sums over the queues before each."""
        held = self.kept.get(w)
        if held is None:
            upto = min(w * self.window, self.total)
            got = self._first(upto)
            held = got, np.concatenate([[0], np.cumsum(got)])
            if len(self.kept) > max(64, 400_000 // len(got)):
                self.kept.clear()
            self.kept[w] = held
        return held

    def _first(self, upto: int) -> np.ndarray:
        """The first `upto` tokens by time due, then queue. due() only grows with v, so any v that gives `upto` gives the same tokens;
        where several fall due at once, the last time before them is sought to the last bit."""
        if upto >= self.total:
            return self.sizes
        near = (len(self.sizes) + 2) / self.total
        v = upto / self.total
        low, high = max(0.0, v - near), v + near
        while self.due(low).sum() > upto:
            low = max(0.0, low - near)
        while self.due(high).sum() <= upto:
            high += near
        while low < v < high:
            got = self.due(v)
            n = int(got.sum())
            if n == upto:
                return got
            low, high = (v, high) if n < upto else (low, v)
            v = (low + high) / 2
        got = self.due(low)
        more = self.due(high) - got
        left = upto - int(got.sum()) - (np.cumsum(more) - more)
        return got + np.clip(left, 0, more)

    def window_of(self, q: int, x: int) -> int:
        """The window that takes token x of queue q."""
        before = int(self.due((x + 1 - self.phases[q]) / self.amounts[q]).sum())
        w = min(self.windows - 1, max(0, before - 1) // self.window)
        while self.served(w)[0][q] > x:
            w -= 1
        while self.served(w + 1)[0][q] <= x:
            w += 1
        return w

    def pieces(self, q: int, x: int, n: int):
        """(length, sequence, offset) of the pieces of tokens x to x + n of queue q."""
        w = self.window_of(q, x)
        while n:
            (before, ahead), (after, ahead_after) = self.served(w), self.served(w + 1)
            take = min(n, int(after[q]) - x)
            if take <= 0:  # a queue of less than a token a window
                w = self.window_of(q, x)
                continue
            at = int(ahead_after[q] - ahead[q]) + x - int(before[q])
            if w < self.windows - 1:
                yield take, self.first + w, at
                n, x = n - take, x + take
            else:
                while take:
                    k = bisect_right(self.tail, at) - 1
                    part = min(take, self.tail[k + 1] - at)
                    yield part, self.first + w + k, at - self.tail[k]
                    n, x, at, take = n - part, x + part, at + part, take - part
            w += 1


def phases(totals: dict[str, int], targets: dict[str, float] | None, window: int) -> tuple[list[Phase], list[dict[str, int]]]:
    """Phases and, for each, where every queue's part begins in its stream. Without targets the shares are those of the corpus,
    and there is one phase; with them, shares are rescaled over the queues that still have tokens each time one runs dry."""
    queues, left, out, begins, first = list(totals), dict(totals), [], [], 0
    while any(left.values()):
        live = [q for q in queues if left[q]]
        weight = {q: (targets or {}).get(q, 0.0) if targets else totals[q] for q in live}
        if not sum(weight.values()):
            weight = {q: left[q] for q in live}
        scale = min(left[q] / weight[q] for q in live if weight[q])
        part = dict.fromkeys(queues, 0)
        for q in live:
            dry = not targets or left[q] <= weight[q] * scale * (1 + 1e-12)
            part[q] = left[q] if dry and weight[q] else min(left[q], int(weight[q] * scale))
        begins.append({q: totals[q] - left[q] for q in queues})
        out.append(Phase([part[q] for q in queues], window, first))
        first = out[-1].next
        left = {q: left[q] - part[q] for q in queues}
    return out, begins


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str, float] | None = None, window: int = WINDOW, name: str = "byte_bpe_50k.json", path: str | None = None, end_id: int | None = 1, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue (and ids with keep_ids).

    Every id of every document lies in exactly one piece; all sequences are full but the last of each phase, which are powers of
    two. Queues: the sources, each of them; the driver and every worker hold a number and a name of each. targets: weights of sources (default: the corpus' own shares, at which all run dry together).
    A null text is empty (its end id alone is packed); a null source is a source of its own; repeated rows are packed each on its
    own; an empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    sent = bpe.shipped(spark, name, path)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("\x00null")).alias("source"))

    def tokens(batches):
        enc, part, upto = bpe.worker_encoder(sent), TaskContext.get().partitionId(), {}
        for b in batches:
            texts, sources = bpe.texts_of(b.column(1)), b.column(2).to_pylist()
            for i, j in bpe.chunks(texts):
                n, ids = enc.encode(texts[i:j])
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                at, before = np.concatenate([[0], np.cumsum(n)]), []
                for s, k in zip(sources[i:j], n.tolist(), strict=True):
                    before.append(upto.get(s, 0))
                    upto[s] = before[-1] + k
                kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
                data = ids.astype(kind).tobytes()
                wide = int(kind[2])
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * (j - i), pa.int32()), "doc_id": b.column(0).slice(i, j - i), "source": pa.array(sources[i:j]), "n": pa.array(n), "before": pa.array(before, pa.int64()), "ids": pa.array([data[x * wide : y * wide] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())})

    stored = spill(rows.mapInArrow(tokens, "part int, doc_id long, source string, n long, before long, ids binary"), "pack-ids")
    blocks = spill(stored.groupBy("part", "source").agg(F.sum("n").alias("n")), "pack-blocks")
    # Where each task's block of a source begins in its queue: one row a task and source, not a document.
    order = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0)))
    totals = {r[0]: r[1] for r in blocks.groupBy("source").agg(F.sum("n")).orderBy("source").collect()}  # a row a source
    wanted = None if targets is None else {q: float(targets.get(q[1:], 0.0)) for q in totals}
    streams, begins = phases(totals, wanted, window)
    number = {q: k for k, q in enumerate(totals)}
    placed = stored.join(spill(blocks.select("part", "source", "base"), "pack-bases"), ["part", "source"]).select("doc_id", "source", "n", (F.col("base") + F.col("before")).alias("at"), "ids")

    def cut(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"] + ["ids"] * keep_ids
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, q, n, x, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(data, dtype=f"<u{len(data) // n}").astype("<u4") if n else np.zeros(0, "<u4")
                k, start = number[q], 0
                for f, phase in enumerate(streams):
                    a = begins[f][q]
                    part = min(x + n, a + phase.amounts[k]) - (x + start)
                    if x + start < a or part <= 0:
                        continue
                    for length, sequence, offset in phase.pieces(k, x + start - a, part):
                        piece = ids[start : start + length]
                        row = (doc, start, length, zlib.crc32(piece.tobytes()), n, sequence, offset, q[1:]) + (piece.tolist(),) * keep_ids
                        for c, v in zip(out, row, strict=True):
                            c.append(v)
                        start += length
                if len(out[0]) > 20_000:
                    yield batch(names, out)
                    out = [[] for _ in names]
            yield batch(names, out)

    def batch(names, out):
        kinds = [pa.int64()] * 7 + [pa.string()] + [pa.list_(pa.int64())] * keep_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string" + ", ids array<long>" * keep_ids)
