"""Exact top-k search by a three-phase uniform threshold.

Vectors are cut into slices of dimensions. Each slice is held by a node of its own, which knows a part of every score; the score is the
sum of the parts. A task is one node's slice of one block of rows and never sees another slice.

1. Every node lists its highest local scores. The nodes' parts of what is listed are summed up; the k-th highest sum of a query is a
   safe cutoff, since k rows are known that reach it.
2. The cutoff goes to every node, which ships the entries of at least its uniform share, cutoff / nodes: a row whose score reaches the
   cutoff must reach that share at some node.
3. Shipped entries visit the nodes that did not ship them, which add their parts, so their scores are exact.

Of rows with equal vectors only the k + 1 of the smallest ids can be among anyone's k highest; the others are no candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Temporaries, scratch
from .vectors import arrow, best, columns, grouped, lists, n_blocks, rounds, usable

#: Slices of dimensions; factor that turns components into whole numbers; entries that each node lists for a query, in times k.
NODES, SCALE, LISTED = 2, 64.0, 5
#: Queries that are scored at once.
CHUNK = 256

_ENTRIES = "rb int, node int, query_id long, ids array<long>, sums array<long>"
_FOUND = "query_id long, vec_id long, score long"


def _kind(rows: np.ndarray, queries: np.ndarray) -> type:
    """A type in which every partial sum of these products is exact: floats only where they hold all whole numbers that can occur."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class _Slice:
    """One node's slice of a block of rows, in ascending order of id, and the same dimensions of a round's queries."""

    def __init__(self, t: pa.Table, queries: dict[str, np.ndarray], cuts: list[int]):
        got = columns(t.select(["node", "vec_id", "v"]))
        order = np.argsort(got["vec_id"])
        self.node = int(got["node"][0])
        self.ids = got["vec_id"][order]
        rows, q = got["v"][order], queries["q"][:, cuts[self.node] : cuts[self.node + 1]]
        kind = _kind(rows, q)
        self.rows, self.q, self.query_id = rows.astype(kind), q.astype(kind), queries["query_id"]

    def scores(self):
        """(first query, local scores of some queries x rows, which of them are the query itself)."""
        for a in range(0, len(self.q), CHUNK):
            yield a, self.q[a : a + CHUNK] @ self.rows.T, self.query_id[a : a + CHUNK, None] == self.ids

    def part(self, query_id: int, ids: np.ndarray) -> np.ndarray:
        """Local scores of some rows for one query."""
        return (self.rows[np.searchsorted(self.ids, ids)] @ self.q[np.searchsorted(self.query_id, query_id)]).astype(np.int64)


def _table(rb: int, node: int, queries: list[int], ids: list[np.ndarray], sums: list[np.ndarray]) -> pa.Table:
    n = len(queries)
    return pa.table([pa.array([rb] * n, pa.int32()), pa.array([node] * n, pa.int32()), pa.array(queries, pa.int64()), lists(ids, pa.int64()), lists(sums, pa.int64())], schema=arrow(_ENTRIES))


def _resolve(entries: DataFrame, blocks: list[DataFrame], rb: int, sent, cuts: list[int], finish=None, schema: str = _ENTRIES) -> DataFrame:
    """Entries with whole scores: each visits every node but the one that gave it. finish: what to make of a block's, of that schema."""
    for node, block in enumerate(blocks):
        end = finish if node == len(blocks) - 1 else None
        kind = schema if end else _ENTRIES

        def add(rows: pa.Table, given: pa.Table) -> pa.Table:
            if not len(given):
                return arrow(kind).empty_table()
            held = _Slice(rows, sent.value, cuts)
            out = []
            for r, (q, by) in enumerate(zip(given["query_id"].to_pylist(), given["node"].to_pylist(), strict=True)):
                sums = given["sums"][r].values.to_numpy()
                out.append(sums if by == node else sums + held.part(q, given["ids"][r].values.to_numpy()))
            kept = given.select(["rb", "node", "query_id", "ids"]).append_column("sums", lists(out, pa.int64()))
            return (end or (lambda t: t))(kept.cast(arrow(_ENTRIES)))

        entries = grouped(block, ["rb"], rb).cogroup(grouped(entries, ["rb"], rb)).applyInArrow(add, kind)
    return entries


def _in_rows(entries: DataFrame) -> DataFrame:
    """query_id, vec_id, score of resolved entries, each once."""
    pairs = entries.select("query_id", F.explode(F.arrays_zip("ids", "sums")).alias("e"))
    return pairs.select("query_id", F.col("e.ids").alias("vec_id"), F.col("e.sums").alias("score")).distinct()


def exact_top(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_every: int = 20, scale: float = SCALE, nodes: int = NODES, rows_a_block: int | None = None, shipped: list[int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (long) of each query's k highest integer inner products of floor(scale * x).

    Queries: rows whose id is divisible by query_every, against every other row. Vectors that are null, or hold null or non-finite
    components, or whose length isn't the common one, take no part; zero vectors do. Ties go to the smaller vec_id; rows of one id count
    once; with fewer than k candidates all are returned; other columns are not read. shipped: a list that gets the number of entries
    that phase two shipped in each round of queries."""
    spark = table.sparkSession
    whole = usable(table, id_col, vector_col, zero=True)
    rows = whole.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("v"))
    queries = rows.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    one = whole.select(F.size("v")).first()
    if not one:
        return best(spark.createDataFrame([], _FOUND), k)
    nodes = min(nodes, one[0])
    cuts = np.linspace(0, one[0], nodes + 1).astype(int).tolist()
    rb = n_blocks(whole.count(), rows_a_block)
    copies = W.partitionBy("v").orderBy("vec_id")
    rows = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    paths = []
    with Temporaries() as kept:
        rows = kept.spill(rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(rb)).cast("int").alias("rb"), "vec_id", "v"), "topk-rows")
        blocks = [kept.spill(rows.select("rb", F.lit(i).alias("node"), "vec_id", F.slice("v", cuts[i] + 1, cuts[i + 1] - cuts[i]).alias("v")), f"topk-node-{i}") for i in range(nodes)]
        every = blocks[0]
        for block in blocks[1:]:
            every = every.unionByName(block)
        listed_a_block = -(-LISTED * k // rb) + 1
        for batch in rounds(queries):
            sent = spark.sparkContext.broadcast(batch)  # ROUND_BYTES at most

            def listed(t: pa.Table) -> pa.Table:
                held = _Slice(t, sent.value, cuts)
                m, q, ids, sums = min(listed_a_block, len(held.ids)), [], [], []
                for a, s, own in held.scores():
                    at = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    for r in range(len(s)):
                        some = at[r][~own[r, at[r]]]
                        q.append(int(held.query_id[a + r]))
                        ids.append(held.ids[some])
                        sums.append(s[r, some].astype(np.int64))
                return _table(t["rb"][0].as_py(), held.node, q, ids, sums)

            first = kept.spill(grouped(every, ["node", "rb"], nodes * rb).applyInArrow(listed, _ENTRIES), "topk-listed")
            sums = best(_in_rows(_resolve(first, blocks, rb, sent, cuts)), k)
            cutoffs = {r[0]: r[1] for r in sums.where(F.col("rank") == k).select("query_id", "score").collect()}  # a number a query of the round
            least = -(2**62)  # no cutoff: fewer than k candidates
            cutoff = np.array([cutoffs.get(int(q), least) for q in batch["query_id"]], dtype=np.int64)
            share = spark.sparkContext.broadcast((cutoff, -(-cutoff // nodes)))

            def reach(t: pa.Table) -> pa.Table:
                held = _Slice(t, sent.value, cuts)
                q, ids, sums = [], [], []
                for a, s, own in held.scores():
                    # a share that the type can't hold lies beyond all scores of this slice, and stays beyond them when rounded
                    some = (s >= share.value[1][a : a + CHUNK, None].astype(s.dtype)) & ~own
                    r, c = np.nonzero(some)
                    ends = np.searchsorted(r, np.arange(len(s) + 1))
                    for i in np.flatnonzero(np.diff(ends)):
                        at = c[ends[i] : ends[i + 1]]
                        q.append(int(held.query_id[a + i]))
                        ids.append(held.ids[at])
                        sums.append(s[i, at].astype(np.int64))
                return _table(t["rb"][0].as_py(), held.node, q, ids, sums)

            entries = kept.spill(grouped(every, ["node", "rb"], nodes * rb).applyInArrow(reach, _ENTRIES), "topk-entries")
            if shipped is not None:
                shipped.append(entries.agg(F.sum(F.size("ids"))).first()[0] or 0)

            def highest(t: pa.Table) -> pa.Table:
                """Of a block's resolved entries, each query's k highest that reach its cutoff."""
                by: dict[int, list[int]] = {}
                for r, q in enumerate(t["query_id"].to_pylist()):
                    by.setdefault(q, []).append(r)
                out = []
                for q, at in by.items():
                    ids, one = np.unique(np.concatenate([t["ids"][r].values.to_numpy() for r in at]), return_index=True)
                    score = np.concatenate([t["sums"][r].values.to_numpy() for r in at])[one]
                    order = np.argsort(-score, kind="stable")[:k]
                    order = order[score[order] >= share.value[0][np.searchsorted(sent.value["query_id"], q)]]
                    out.append((np.full(len(order), q), ids[order], score[order]))
                got = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
                return pa.table([pa.array(x) for x in got], schema=arrow(_FOUND))

            path = scratch(spark, "topk-found")
            best(_resolve(entries, blocks, rb, sent, cuts, highest, _FOUND), k).write.parquet(path)
            paths.append(path)
            sent.unpersist()
            share.unpersist()
    if not paths:
        return best(spark.createDataFrame([], _FOUND), k)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(*paths)
