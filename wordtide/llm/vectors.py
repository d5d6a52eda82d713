"""What the vector searches share: usable vectors, blocks of rows, rounds of queries.

Queries are a stated set that is searched against all rows. Rows are dealt by a hash into blocks of a bounded size. Queries go in
rounds of a bounded number and width to every worker, so neither rows nor queries are copied for each other, and no task holds more
than a block and a round whatever the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import spill

#: Rows of a block, queries of a round, bytes of a round's vectors (one query at least).
ROWS, QUERIES, ROUND_BYTES = 4096, 4096, 16 << 20


def usable(table: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null or empty, no null or non-finite component, not zero (unless zero is True),
    and as long as most vectors are. Rows of one id count once, with the smallest vector; a null id takes no part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)))
    if not zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (common["d"] if common else 0))
    return spill(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")


def n_blocks(n: int, rows_a_block: int | None = None) -> int:
    return max(1, -(-n // (rows_a_block or ROWS)))


def rounds(queries: DataFrame) -> Iterator[dict[str, np.ndarray]]:
    """The columns of queries (query_id, q, ...), a round at a time, in ascending order of query_id; empty rounds are left out."""
    n, one = queries.count(), queries.select(F.size("q")).first()
    parts = max(1, -(-n // max(1, min(QUERIES, ROUND_BYTES // (8 * one[0]))))) if one else 0
    for i in range(parts):
        got = queries.where(F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(parts)) == i).toArrow().sort_by("query_id")
        if len(got):
            yield columns(got)


def grouped(rows: DataFrame, keys: list[str], groups: int) -> GroupedData:
    """rows by keys, about a group a partition; so many partitions that AQE can't put all blocks into few tasks."""
    return rows.repartition(min(max(groups, 1), 20_000), *keys).groupBy(*keys)


def columns(t: pa.Table) -> dict[str, np.ndarray]:
    """Columns as arrays; lists become rows of a matrix."""
    return {c: _column(t, c) for c in t.column_names}


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}


def arrow(schema: str) -> pa.Schema:
    """The Arrow schema of "name type, ..."; unlike Spark's own parser it works in a worker."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of arrays."""
    ends = np.cumsum([0] + [len(x) for x in values])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat).cast(kind))


def _column(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name).combine_chunks()
    if isinstance(c, pa.ChunkedArray):
        c = pa.concat_arrays(c.chunks)
    if pa.types.is_list(c.type):
        return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
    return c.to_numpy(zero_copy_only=False)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each query, ties to the smaller vec_id. Spark drops what can't be among them
    before the shuffle."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

