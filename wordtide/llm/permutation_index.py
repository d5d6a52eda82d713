"""Approximate nearest neighbours by a permutation index.

A bounded sample of vectors are pivots. Every vector is represented by its nearest pivots in order, and posted, with its place in that
order, in the inverted file of each of them. A query reads the files of its own nearest pivots only, ranks what it meets by footrule
distance between the two orders (pivots that only one of them names count as last), and reranks the nearest by inner product of the
original vectors in double precision. Inverted files are kept by block of rows, so that no file is larger than a block.

Nearness is the inner product, which is no distance: long vectors are near everything. So rows are dealt into bands whose lengths differ
by less than a factor of two, and get one more component within their band that makes all its vectors equally long; queries get 0 there.
Order by distance is then order by inner product, whatever the lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Temporaries, scratch
from .vectors import arrow, best, columns, grouped, n_blocks, rounds, usable

#: Pivots (a hashed draw of this many vectors), pivots that represent a vector, share of a block that is reranked, and at least so many
#: in times k.
PIVOTS, NEAREST, SHARE, LEAST = 256, 128, 0.1, 10

_FOUND = "query_id long, vec_id long, score double"


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and logarithms of lengths to base 2 (lengths themselves may be beyond what doubles hold)."""
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / top
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / n, np.log2(top[:, 0]) + np.log2(n[:, 0])


def band_of(length: np.ndarray) -> np.ndarray:
    """A band holds lengths from 2 ** (band - 0.5) to 2 ** (band + 0.5)."""
    return np.floor(length + 0.5).astype(np.int32)


def levelled(unit: np.ndarray, length: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Unit vectors of one more component: v / longest, and what it lacks."""
    part = np.exp2(np.minimum(length - longest, 0.0))[:, None]
    return np.concatenate([unit * part, np.sqrt(np.maximum(1 - part**2, 0))], axis=1)


def nearest_pivots(v: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """Numbers of each vector's n nearest pivots, nearest first; ties to the smaller number."""
    return np.argsort(-np.round(v @ pivots.T, 9), axis=1, kind="stable")[:, :n]


class Inverted:
    """The inverted files of a block: for each pivot, the credit (n - place in the row's order) of every row, 0 where it isn't posted.
    As a row is in half the files, they are laid out dense."""

    def __init__(self, perm: np.ndarray, pivots: int):
        rows, self.n = perm.shape
        self.credit = np.zeros((pivots, rows), dtype=np.uint8 if self.n < 256 else np.uint16)
        self.credit[perm.T, np.arange(rows)] = (self.n - np.arange(self.n))[:, None]

    def closeness(self, perm: np.ndarray) -> np.ndarray:
        """For a query's order, a number for each row that falls as footrule distance grows: distance = n(n + 1) - 2 x closeness."""
        own = (self.n - np.arange(self.n)).astype(self.credit.dtype)[:, None]
        return np.minimum(self.credit[perm], own).sum(axis=0, dtype=np.uint16 if self.n < 256 else np.uint32)


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_every: int = 20, pivots: int = PIVOTS, near: int = NEAREST, share: float = SHARE, least: int = LEAST, rows_a_block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found by each query: rows whose id is divisible by query_every, against every other row.

    Vectors that are null, zero, or hold null or non-finite components, or whose length isn't the common one, take no part. Ties go to
    the smaller vec_id; rows of one id count once; with fewer than k candidates all are returned; other columns are not read."""
    spark = table.sparkSession
    vectors = usable(table, id_col, vector_col, zero=False)
    drawn = np.array([r[0] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()], dtype=np.float64)
    none = spark.createDataFrame([], _FOUND)
    if not len(drawn):
        return best(none, k)

    def measure(batches):
        for b in batches:
            _, length = directions(b.column(1).flatten().to_numpy().reshape(len(b), -1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(length), pa.array(band_of(length))], names=["vec_id", "v", "length", "band"])

    paths = []
    with Temporaries() as kept:
        measured = kept.spill(vectors.mapInArrow(measure, "vec_id long, v array<double>, length double, band int"), "lengths")
        # bands are exponents of doubles, so there are 2,200 at most
        bands = {r[0]: (r[1], n_blocks(r[2], rows_a_block)) for r in measured.groupBy("band").agg(F.max("length"), F.count("*")).collect()}
        unit, length = directions(drawn)
        sent = spark.sparkContext.broadcast(levelled(unit, length, np.array([bands[x][0] for x in band_of(length).tolist()])))  # `pivots` vectors at any size of input
        near = min(near, len(drawn))

        def represent(batches):
            for b in batches:
                unit, length = directions(b.column(1).flatten().to_numpy().reshape(len(b), -1))
                longest = np.array([bands[x][0] for x in b.column(3).to_pylist()])
                perm = nearest_pivots(levelled(unit, length, longest), sent.value, near).astype(np.int32)
                asked = nearest_pivots(unit, sent.value[:, :-1], near).astype(np.int32)
                ends = np.arange(0, perm.size + 1, near, dtype=np.int32)
                blocks = pa.array([bands[x][1] for x in b.column(3).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), blocks, *(pa.ListArray.from_arrays(ends, x.ravel()) for x in (perm, asked))], names=["vec_id", "v", "band", "blocks", "perm", "asked"])

        index = measured.mapInArrow(represent, "vec_id long, v array<double>, band int, blocks int, perm array<int>, asked array<int>")
        index = kept.spill(index.withColumn("rb", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")), "permutations")
        queries = index.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("asked").alias("query_perm"))
        rows = index.select("band", "rb", "vec_id", "v", "perm")
        groups = sum(n for _, n in bands.values())
        for batch in rounds(queries):
            asking = spark.sparkContext.broadcast(batch)  # a round: ROUND_BYTES of vectors and `near` numbers a query

            def search(t: pa.Table) -> pa.Table:
                got = columns(t.select(["vec_id", "v", "perm"]))
                order = np.argsort(got["vec_id"])
                ids, v = got["vec_id"][order], got["v"][order]
                files = Inverted(got["perm"][order], len(sent.value))
                take = min(len(ids), max(least * k, int(np.ceil(share * len(ids)))))
                found = [], [], []
                for q, x, perm in zip(asking.value["query_id"].tolist(), asking.value["q"], asking.value["query_perm"], strict=True):
                    at = np.arange(len(ids))
                    if take < len(ids):
                        c = files.closeness(perm)
                        kth = np.partition(c, len(c) - take)[len(c) - take]
                        over = np.flatnonzero(c > kth)
                        at = np.sort(np.concatenate([over, np.flatnonzero(c == kth)[: take - len(over)]]))  # ties to smaller ids
                    at = at[ids[at] != q]
                    score = (v[at] * x).sum(axis=1)  # a row's sum doesn't depend on its place, so equal vectors tie
                    top = np.lexsort((at, -score))[:k]
                    for held, one in zip(found, (np.full(len(top), q), ids[at[top]], score[top]), strict=True):
                        held.append(one)
                return pa.table([pa.array(np.concatenate(x)) for x in found], schema=arrow(_FOUND))

            path = scratch(spark, "nearest-found")
            best(grouped(rows, ["band", "rb"], groups).applyInArrow(search, _FOUND), k).write.parquet(path)
            paths.append(path)
            asking.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score double").parquet(*paths) if paths else best(none, k)
