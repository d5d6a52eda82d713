"""What the operators of this subpackage share: the shared folder, tables in it, mergeable arrays."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder. Where both are unset, a temporary
    one if everything runs in this machine's one process (tests), and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        root = sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='wordtide-')}")
            root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/wordtide/{what}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch between Spark and Python workers, and of a row group of an intermediate table: texts are wide rows, and Spark's
#: defaults (10,000 rows or 64 MB, and 128 MB a writer) are most of an executor's memory at small heaps.
BATCH_BYTES, ROW_GROUP = 8 << 20, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches in this session, unless the application set a bound itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def spill(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, so lost executors cost a reread."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch(spark, what)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wordtide_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that spill() wrote; nothing may read it afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._wordtide_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark._jvm.System.gc()


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def text_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns, under fixed names: other columns are never read, so their names can't clash."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges [i, j) of documents that hold about `most` bytes each, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits over 64 bits, one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Symbols that are hashed at once; powers of the base are kept for so many.
SPAN = 1 << 20


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to SPAN."""
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.ones(SPAN, dtype=U64)
            k, b = 1, base
            while k < SPAN:  # p[k:2k] = p[:k] * base**k
                p[k : 2 * k] = p[:k] * U64(b)
                k, b = 2 * k, b * b % (1 << 64)
            _POWERS[name] = p
    return _POWERS["up"], _POWERS["down"]


def span_hashes(values, n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of symbols s to e of n for every span, in ascending order of starts and ends. values(a, b): those symbols as
    uint64, one well-mixed number a symbol. Spans of equal content get equal hashes wherever they lie; SPAN symbols are in memory."""
    up, down = _powers()
    at_start, at_end, back = (np.empty(len(starts), dtype=U64) for _ in range(3))
    carry = U64(0)
    for a in range(0, max(n, 1), SPAN):
        b = min(a + SPAN, n)
        sums = np.empty(b - a + 1, dtype=U64)
        sums[0] = 0
        np.multiply(values(a, b), up[: b - a], out=sums[1:])
        np.cumsum(sums, out=sums)
        if a:
            sums *= U64(pow(_BASE, a, 1 << 64))
            sums += carry
        last = b == n
        i, j = np.searchsorted(starts, [a, b + last])
        at_start[i:j], back[i:j] = sums[starts[i:j] - a], down[np.minimum(starts[i:j] - a, SPAN - 1)]
        if a:
            back[i:j] *= U64(pow(_BASE_INVERSE, a, 1 << 64))
        i, j = np.searchsorted(ends, [a, b + last])
        at_end[i:j] = sums[ends[i:j] - a]
        carry = sums[-1]
    return mix64((at_end - at_start) * back + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


_ZSTD = "zstd"


def packed_counts(x: np.ndarray) -> bytes:
    """Whole numbers >= 0 in the narrowest width that holds them, compressed; unpacked_counts() gives them back in 64 bits."""
    top = int(x.max(initial=0))
    kind = next(k for k in ("<u1", "<u2", "<u4", "<i8") if top <= np.iinfo(k).max)
    return kind[1:].encode() + len(x).to_bytes(4, "little") + pa.Codec(_ZSTD).compress(np.ascontiguousarray(x, dtype=kind).tobytes(), asbytes=True)


def unpacked_counts(b: bytes) -> np.ndarray:
    kind = f"<{b[:2].decode()}"
    size = int.from_bytes(b[2:6], "little") * np.dtype(kind).itemsize
    return np.frombuffer(pa.Codec(_ZSTD).decompress(b[6:], size, asbytes=True), dtype=kind).astype(np.int64)


def merge_arrays(rows: DataFrame, how: str) -> dict[int, np.ndarray]:
    """rows: chunk int, cells binary (packed_counts), many for each chunk. Adds ("sum", in 64 bits) or ORs ("or") those of a chunk, in
    one streaming pass; what reaches the driver has the fixed size of one set of chunks."""

    def merged(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = unpacked_counts(x.as_buffer().to_pybytes())
                if c not in held:
                    held[c] = x
                elif how == "sum":
                    held[c] += x
                else:
                    held[c] |= x
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(held), pa.int32()), "cells": pa.array([packed_counts(x) for x in held.values()], pa.binary())})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = rows.repartition(min(parts, 16), "chunk").mapInArrow(merged, "chunk int, cells binary")
    return {r[0]: unpacked_counts(bytes(r[1])) for r in got.collect()}


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df lacks, in any spelling of case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Temporaries:
    """Tables in the shared folder that go when the block ends, well or not: with Temporaries() as t: t.spill(df, "what")."""

    def __enter__(self):
        self.held: list[DataFrame] = []
        return self

    def spill(self, df: DataFrame, what: str) -> DataFrame:
        out = spill(df, what)
        self.held.append(out)
        return out

    def __exit__(self, *_):
        for df in self.held:
            forget(df)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component) for every node of an edge, all DataFrame work.

    Each round every node follows its neighbour (or itself) of the smallest seeded hash, edges are redrawn between what was
    followed, and doubles and loops go; a round takes a constant share of the nodes away whatever the shape, so the number of
    rounds grows with the logarithm of the input. Group minima are combined before the shuffle, so a hub's edges don't meet in
    one task. component: some node of the component; callers take the minimum they want. Null ends and loops link nothing."""
    kind = dict(edges.dtypes)["a"]
    cur = spill(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    steps = []
    while not is_empty(cur):
        seed = F.lit(len(steps))
        rank = lambda x, seed=seed: F.struct(F.xxhash64(x, seed).alias("h"), x.alias("x"))
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank(F.col("a")))["x"].alias("to"))
        to = spill(to, "cc-step")
        steps.append(to)
        redrawn = cur.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        nxt = spill(redrawn.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges")
        forget(cur)
        cur = nxt
    if not steps:
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    out = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return out
