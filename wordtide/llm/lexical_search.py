"""Ranked lexical search: each item's best documents by a saturated, length-normalised sum of term weights, in whole numbers.

The index has a row for each range of documents as they lie: term hashes, how many documents of the range hold each, and every document's
terms with their counts. A search lays a max tree over each range for the terms that are asked for: a node spans FAN nodes below it (at the
bottom, documents), and holds for each term the highest impact of any of its documents, so the sum of weight x impact over an item's terms
bounds what any document below can score. Each item descends best first: the node of the highest bound is opened, its children are
bounded (at the bottom, scored exactly), and the search of a range ends where the highest bound is below the item's k-th score so far; nodes
of equal bound are opened, as a document of a smaller id may tie. A task carries its items' best lists from range to range, and hands
on k rows an item.

Items go to tasks in rounds of a bounded number of terms, whatever the items' number; the index is read twice a round: for the terms'
document counts, and for the search. Terms are told apart by 64-bit hashes (chances of a clash are about pairs / 2**64)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, Temporaries, forget, scratch, slices, spill, text_table, utf8_buffers
from .words import lowered_hashes, table, word_spans

#: Bytes of text of a range, nodes (documents) below a node, terms of all items of a round.
RANGE, FAN, ROUND = 4 << 20, 8, 1 << 18
_APART = table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_INDEX = "ids binary, lens binary, terms binary, held binary, starts binary, at binary, tf binary, docs long, tokens long"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, documents that hold each, first entry of each document and the end, and each entry's term and occurrences."""
    s, e = word_spans(data, offsets, _APART)
    terms, which = np.unique(lowered_hashes(data, s, e), return_inverse=True)
    doc = np.searchsorted(offsets, s, side="right") - 1
    cell, tf = np.unique(doc * max(len(terms), 1) + which, return_counts=True)
    at = cell % max(len(terms), 1)
    return terms, np.bincount(at, minlength=len(terms)), np.searchsorted(cell // max(len(terms), 1), np.arange(len(offsets))), at, tf


def _ranges(batches):
    for batch in batches:
        data, offsets = utf8_buffers(batch.column(1))
        ids = batch.column(0).fill_null(-1).to_numpy()
        named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for i, j in slices(offsets, RANGE):
            part = offsets[i : j + 1]
            terms, held, starts, at, tf = _terms(data[part[0] : part[-1]], part - part[0])
            n = np.add.reduceat(np.append(tf, 0), starts[:-1]) * (np.diff(starts) > 0)
            row = {"ids": np.stack([ids[i:j], named[i:j]]), "lens": n, "terms": terms, "held": held.astype(np.int32), "starts": starts.astype(np.int32), "at": at.astype(np.int32), "tf": tf.astype(np.int32)}
            row = {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in row.items()}
            yield pa.RecordBatch.from_pydict(row | {"docs": pa.array([int((n > 0).sum())], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of every row of docs, as a table in the shared folder."""
    return spill(text_table(docs, id_col, text_col).mapInArrow(_ranges, _INDEX), "lexical-index")


def _item_terms(batches):
    for batch in batches:
        data, offsets = utf8_buffers(batch.column(1))
        s, e = word_spans(data, offsets, _APART)
        owner = np.searchsorted(offsets, s, side="right") - 1
        yield pa.RecordBatch.from_pydict({"item_id": batch.column(0).take(pa.array(owner)), "term": pa.array(lowered_hashes(data, s, e).view(np.int64))})


def _rounds(items: DataFrame):
    """Lists of (item_id, terms), each list of about ROUND terms, one item at least."""
    held, n = [], 0
    for r in items.groupBy("item_id").agg(F.collect_set("term").alias("terms")).toLocalIterator():  # an item's terms, as large as its text
        held.append((r["item_id"], np.sort(np.array(r["terms"], dtype=np.int64).view(U64))))
        n += len(r["terms"])
        if n >= ROUND:
            yield held
            held, n = [], 0
    if held:
        yield held


def _read(row: dict, name: str, kind) -> np.ndarray:
    return np.frombuffer(row[name], dtype=kind)


def _max_tree(doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int, terms: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from documents to the root: first entry of each node and the end, and each entry's term and highest value."""
    levels, node, n = [], doc, docs
    while True:
        levels.append((np.searchsorted(node, np.arange(n + 1)), term, value))
        if n == 1:
            return levels
        n = -(-n // FAN)
        cell = (node // FAN) * terms + term
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, dtype=np.int64)
        value = np.maximum.reduceat(value[order], new) if len(cell) else value
        node, term = cell[new] // terms, cell[new] % terms


def _descend(levels: list, weight: np.ndarray, best: list, k: int, ids: list) -> int:
    """Put a range's documents that belong among the k best into best, a heap of (score, -id); the number of nodes opened."""

    def bounds(level: int, a: int, b: int) -> list[int]:
        first, term, value = levels[level]
        s = first[a : b + 1]
        sums = np.concatenate([[0], np.cumsum(weight[term[s[0] : s[-1]]] * value[s[0] : s[-1]])])
        return np.diff(sums[s - s[0]]).tolist()

    top, opened = len(levels) - 1, 0
    queue = [(-bounds(top, 0, 1)[0], top, 0)]
    if not top:
        queue, levels = [(queue[0][0], 1, 0)], [*levels, levels[0]]  # a range of one document
    while queue:
        bound, level, node = heapq.heappop(queue)
        if not bound or len(best) == k and -bound < best[0][0]:
            break
        opened += 1
        a = node * FAN
        got = bounds(level - 1, a, min(a + FAN, len(levels[level - 1][0]) - 1))
        for child, x in enumerate(got, a):
            if not x or len(best) == k and x < best[0][0]:
                continue
            if level > 1:
                heapq.heappush(queue, (-x, level - 1, child))
            elif ids[child] is not None:
                entry = (x, -ids[child])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
    return opened


def _search(index: DataFrame, items: list, asked: np.ndarray, weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    places = [np.searchsorted(asked, t) for _, t in items]

    def search(batches):
        best = [[] for _ in items]
        weight = np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                terms = _read(row, "terms", U64)
                where = np.searchsorted(asked, terms)
                where[where == len(asked)] = 0
                to = np.where(asked[where] == terms, where, -1) if len(asked) else np.full(len(terms), -1)
                at, starts = to[_read(row, "at", np.int32)], _read(row, "starts", np.int32)
                if not (at >= 0).any():
                    continue
                ids, named = _read(row, "ids", np.int64).reshape(2, -1)
                ids = [x if ok else None for x, ok in zip(ids.tolist(), named.tolist(), strict=True)]
                lens, own = np.unique(_read(row, "lens", np.int64), return_inverse=True)
                spread = np.array([8 * (10 + 90 * n * total // length) for n in lens.tolist()])[own]  # whole numbers of any size
                doc = np.repeat(np.arange(len(ids)), np.diff(starts))
                keep = at >= 0
                doc, at, tf = doc[keep], at[keep], _read(row, "tf", np.int32)[keep].astype(np.int64)
                levels = _max_tree(doc, at, 1_000_000_000 * tf // (1000 * tf + spread[doc]), len(ids), len(asked))
                for heap, place in zip(best, places, strict=True):
                    weight[place] = weights[place]
                    _descend(levels, weight, heap, k, ids)
                    weight[place] = 0
        rows = [(items[i][0], -d, s) for i, heap in enumerate(best) for s, d in heap]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("item_id", "doc_id", "score"))})

    found = index.select("ids", "lens", "terms", "starts", "at", "tf").mapInArrow(search, "item_id long, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _held_by(index: DataFrame, asked: np.ndarray) -> np.ndarray:
    """How many documents of the index hold each term."""

    def counted(batches):
        n = np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                terms = _read(row, "terms", U64)
                where = np.searchsorted(asked, terms)
                where[where == len(asked)] = 0
                hit = asked[where] == terms
                n[where[hit]] += _read(row, "held", np.int32)[hit]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})

    out = np.zeros(len(asked), dtype=np.int64)
    for at, n in index.select("terms", "held").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # a round's terms
        out[at] = n
    return out


def search_index(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: every item's k best documents of an index with a score above 0, as rank_documents() says."""
    spark = index.sparkSession
    rows = text_table(items, id_col, text_col).withColumnRenamed("doc_id", "item_id").where("item_id is not null")
    total, length = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    path = scratch(spark, "lexical-found")
    _empty(spark).write.parquet(path)
    with Temporaries() as t:
        terms = t.spill(rows.mapInArrow(_item_terms, "item_id long, term long").distinct(), "lexical-items")
        for held in _rounds(terms) if total else ():
            asked = np.unique(np.concatenate([t for _, t in held]))
            df = _held_by(index, asked)
            weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)
            _search(index, held, asked, weights, total, length, k).write.mode("append").parquet(path)
    return spark.read.schema(_empty(spark).schema).parquet(path)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for every item, ties to the smaller doc_id.

    Terms are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII. With N documents that have a
    term, L terms in all and n in the document, a term of tf occurrences there that df documents hold adds
    floor(1000 ln((2N + 2) / (2df + 1))) x (10**9 tf div (1000 tf + 8 (10 + 90 n N div L))), once an item. A null or blank text has no
    terms: such a document is not found, such an item finds nothing. Rows of one item id are one item with the terms of all of them; rows of
    one doc_id are documents of their own; rows without a doc_id count in N, L and df but can't be named and so aren't listed,
    and items without an id find nothing. Empty tables give an empty result; other columns are not read."""
    index = build_index(docs, doc_col, text_col)
    try:
        return search_index(index, items, item_col, text_col, k)
    finally:
        forget(index)
