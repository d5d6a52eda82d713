"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of documents in ascending doc_id order. Blocks of BLOCK ids: the block's minimum is subtracted, the rest is
packed at a width chosen from percentiles of the block, and what doesn't fit goes to the block's exception list. An index of block
starts and the documents' ids and lengths stand at the end, so one document can be read without the others.

Layout, little-endian: MAGIC; blocks, each min u32, ids u16, exceptions u16, width u8, packed bits, exception positions u16 and
high parts u32; index of block starts u64; doc_id i64, null flag u8 and length u64 of each document; then the counts of blocks and
documents and the place of the index (u64 each) and MAGIC."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import scratch, spill, text_table
from .files import open_read, open_write

MAGIC = b"WTPFOR01"
BLOCK = 1024
PERCENTILES = (90.0, 95.0, 98.0, 100.0)
HEAD = np.dtype([("low", "<u4"), ("n", "<u2"), ("odd", "<u2"), ("width", "u1")])
GROUP = 1024  # blocks packed side by side


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids (uint32), each of BLOCK ids but the last."""
    out: list[bytes] = []
    whole = len(ids) // BLOCK * BLOCK
    for at in range(0, whole, GROUP * BLOCK):
        out += _pack(ids[at : min(at + GROUP * BLOCK, whole)].reshape(-1, BLOCK))
    if whole < len(ids):
        out += _pack(ids[whole:].reshape(1, -1))
    return out


def _pack(v: np.ndarray) -> list[bytes]:
    n = v.shape[1]
    low = v.min(axis=1)
    d = v - low[:, None]
    widths = _bits(np.percentile(d, PERCENTILES, axis=1, method="higher"))  # percentile x block
    odd = np.stack([(d >> np.minimum(w, 31)[:, None].astype(np.uint32) != 0).sum(axis=1) * (w < 32) for w in widths])
    pick = np.argmin((n * widths + 7) // 8 + 6 * odd, axis=0)
    width, odd = widths[pick, np.arange(len(v))], odd[pick, np.arange(len(v))]
    out: list[bytes] = [b""] * len(v)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        bits = ((d[at, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        for k, i in enumerate(at.tolist()):
            head = np.array([(low[i], n, odd[i], w)], dtype=HEAD).tobytes()
            tail = b""
            if odd[i]:
                where = np.flatnonzero(d[i] >> np.uint32(w))
                tail = where.astype("<u2").tobytes() + (d[i][where] >> np.uint32(w)).astype("<u4").tobytes()
            out[i] = head + packed[k].tobytes() + tail
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at starts in data."""
    raw = np.frombuffer(data, dtype=np.uint8)
    heads = np.frombuffer(raw[starts[:, None] + np.arange(HEAD.itemsize)].tobytes(), dtype=HEAD)
    n, width = heads["n"].astype(np.int64), heads["width"].astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(begin[-1], dtype=np.uint32)
    for w, size in {(int(a), int(b)) for a, b in zip(width, n, strict=True)}:
        at = np.flatnonzero((width == w) & (n == size))
        length = (size * w + 7) // 8
        packed = raw[(starts[at] + HEAD.itemsize)[:, None] + np.arange(length)]
        bits = np.unpackbits(packed, axis=1, bitorder="little", count=size * w).reshape(len(at), size, w)
        if w <= 24:
            v = (bits.astype(np.float32) @ (2.0 ** np.arange(w)).astype(np.float32)).astype(np.uint32)
        else:
            v = (bits.astype(np.uint64) @ (np.uint64(1) << np.arange(w, dtype=np.uint64))).astype(np.uint32)
        out[begin[at][:, None] + np.arange(size)] = v + heads["low"][at][:, None]
    for i in np.flatnonzero(heads["odd"]).tolist():
        m, p = int(heads["odd"][i]), int(starts[i]) + HEAD.itemsize + (int(n[i]) * int(width[i]) + 7) // 8
        where = np.frombuffer(data, dtype="<u2", count=m, offset=p)
        out[begin[i] + where] += np.frombuffer(data, dtype="<u4", count=m, offset=p + 2 * m) << np.uint32(width[i])
    return out


class TokenFileWriter:
    """Writes one file as a stream: memory holds one group of blocks and the documents' lengths."""

    def __init__(self, uri: str):
        self.file, self.at = open_write(uri), len(MAGIC)
        self.file.write(MAGIC)
        self.starts, self.docs, self.lens, self.nulls = [], [], [], []
        self.held, self.waiting, self.n_ids = [], 0, 0

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray):
        self.docs += [d or 0 for d in doc_ids]
        self.nulls += [d is None for d in doc_ids]
        self.lens.append(lengths)
        self.held.append(ids.astype(np.uint32))
        self.waiting += len(ids)
        self.n_ids += len(ids)
        if self.waiting >= GROUP * BLOCK:
            self._write(self.waiting // BLOCK * BLOCK)

    def _write(self, n: int):
        ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.uint32)
        blocks = pack_blocks(ids[:n])
        size = np.array([len(b) for b in blocks], dtype=np.int64)
        self.starts.append(self.at + np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size)
        self.file.write(b"".join(blocks))
        self.at += int(size.sum())
        self.held, self.waiting = [ids[n:]], len(ids) - n

    def close(self):
        self._write(self.waiting)
        starts = np.concatenate(self.starts)
        lens = np.concatenate(self.lens) if self.lens else np.zeros(0)
        self.file.write(starts.astype("<u8").tobytes() + np.array(self.docs, dtype="<i8").tobytes() + np.array(self.nulls, dtype="u1").tobytes() + lens.astype("<u8").tobytes())
        self.file.write(np.array([len(starts), len(self.docs), self.at], dtype="<u8").tobytes() + MAGIC)
        self.file.close()


class TokenFile:
    """Reads a file; documents() streams all of them, ids(k) decodes the blocks of one document only."""

    def __init__(self, uri: str):
        self.file = open_read(uri)
        end = self.file.seek(0, 2)
        self.file.seek(end - 24 - len(MAGIC))
        tail = self.file.read()
        if tail[24:] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        blocks, docs, self.end = (int(x) for x in np.frombuffer(tail[:24], dtype="<u8"))
        self.file.seek(self.end)
        foot = self.file.read(8 * blocks + 17 * docs)
        self.starts = np.frombuffer(foot, dtype="<u8", count=blocks).astype(np.int64)
        nulls = np.frombuffer(foot, dtype="u1", count=docs, offset=8 * (blocks + docs))
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(foot, dtype="<i8", count=docs, offset=8 * blocks).tolist(), nulls.tolist(), strict=True)]
        self.lengths = np.frombuffer(foot, dtype="<u8", count=docs, offset=8 * (blocks + docs) + docs).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)])

    def blocks(self, i: int, j: int) -> np.ndarray:
        """The ids of blocks i to j - 1."""
        if i >= j:
            return np.zeros(0, dtype=np.uint32)
        a, b = self.starts[i], self.starts[j] if j < len(self.starts) else self.end
        self.file.seek(a)
        return unpack_blocks(self.file.read(b - a), self.starts[i:j] - a)

    def ids(self, k: int) -> np.ndarray:
        a, b = int(self.begin[k]), int(self.begin[k + 1])
        return self.blocks(a // BLOCK, -(-b // BLOCK))[a % BLOCK :][: b - a]

    def documents(self):
        """(k, part of its ids, whether it is the last part): documents in order, a group of blocks in memory."""
        k, left = 0, self.lengths.tolist()
        while k < len(left) and not left[k]:
            yield k, np.zeros(0, dtype=np.uint32), True
            k += 1
        for i in range(0, len(self.starts), GROUP):
            ids, at = self.blocks(i, min(i + GROUP, len(self.starts))), 0
            while at < len(ids):
                take = min(left[k], len(ids) - at)
                left[k] -= take
                yield k, ids[at : at + take], not left[k]
                at += take
                while k < len(left) and not left[k]:
                    k += 1
                    if k < len(left) and not self.lengths[k]:
                        yield k, np.zeros(0, dtype=np.uint32), True


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json", path: str | None = None, end_id: int | None = 0) -> DataFrame:
    """Encode every whole text, append end_id, and write the ids in ascending doc_id order over range-partitioned files.

    Returns the manifest (part, uri, n_docs, n_ids), one row a file, parts in doc_id order; it is a table in the shared folder, so
    only files of attempts that ended well are listed. Null ids come first; rows of the same id lie side by side, by text."""
    spark = docs.sparkSession
    sent = bpe.shipped(spark, name, path)
    rows = text_table(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        part, writer, n_docs = TaskContext.get().partitionId(), None, 0
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.pfor"
        enc = bpe.worker_encoder(sent)
        for b in batches:
            texts = bpe.texts_of(b.column(1))
            for i, j in bpe.chunks(texts):
                n, ids = enc.encode(texts[i:j])
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(n), end_id)
                    n = n + 1
                writer = writer or TokenFileWriter(uri)
                writer.add(b.column(0).slice(i, j - i).to_pylist(), n, ids)
                n_docs += j - i
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part]), "uri": pa.array([uri]), "n_docs": pa.array([n_docs]), "n_ids": pa.array([writer.n_ids])})

    return spill(rows.mapInArrow(write, "part long, uri string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, decoded from the files."""
    files = manifest.count()
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each file, not document
    todo = manifest.select("uri", before.alias("base")).repartition(max(1, files))

    def read(batches):
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(uri)
                crc = np.zeros(len(f.doc_ids), dtype=np.int64)
                now = 0
                for k, ids, last in f.documents():
                    now = zlib.crc32(ids.astype("<u4").tobytes(), now)
                    if last:
                        crc[k], now = now, 0
                for i in range(0, len(f.doc_ids), 50_000):
                    j = min(i + 50_000, len(f.doc_ids))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(f.doc_ids[i:j], pa.int64()), "start": pa.array(base + f.begin[i:j]), "n_tokens": pa.array(f.lengths[i:j]), "ids_crc32": pa.array(crc[i:j])})

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, **options) -> DataFrame:
    """Write docs as token files below the shared folder and digest what is read back from them.

    A null text counts as empty, so its document is the end id alone; ties and repeated rows each have their own document; an
    empty table gives an empty result; other columns are not read."""
    folder = scratch(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, **options))
