"""N-gram Jaccard join: which documents' shingle sets are similar, how many links each has, and the components of those links.

Exact all-pairs set similarity by prefix filtering. Shingles get one global order, rare first, from a count sketch over all
documents, whose cells grow with the corpus; two sets of Jaccard >= t share a shingle among the first |x| - ceil(t|x|) + 1 of each, so
sets meet on prefix shingles only. A pair that meets passes three lossless filters: length; position (what can still follow the shared
shingle); and a suffix filter, a lower bound of the sets' Hamming distance. For the last, each set carries a folded parity bitmap: an
element flips one bit, so the bits in which two bitmaps differ never outnumber the elements in which the sets differ. If the sets first
meet behind i and j elements, these i + j differ in any case, so bounding the suffixes' distance by (differing bits - i - j) against what
the suffixes may differ by is the same test as bounding the whole sets' distance, which needs one bitmap a set, not one a posting.

What passes is verified on the whole sets, but pairs are drawn in rounds: each component asks for its nearest few partners outside
itself in each posting list, verified links are contracted, and only the last round draws every pair that still lies between two
components. Pairs inside a component are never drawn, so a group of n near copies costs about n verifications; every link between
components is found, so components are exact. Long posting lists are dealt in blocks of rows.

All links lie inside components. They are listed or counted by comparing the classes of each component once a pair, in cells of two
chunks: a set is sent once a cell, not once a pair, and a cell's shared shingles are counted by one matrix product.

Sets are told apart by 64- and 128-bit hashes (xxh3 of words, mixed); chances of a clash are about pairs / 2**64."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPAN, U64, Temporaries, connected_components, forget, free_name, is_empty, merge_arrays, mix64, packed_counts, release, slices, span_hashes, text_table, utf8_buffers
from .common import spill as _spill

#: Bits of a parity bitmap. Cells of a chunk of the frequency sketch; bytes of text a cell; cells at least and at most (a byte each is
#: broadcast). Bits of the filter of rows to fetch: for each wanted row, and at most; where that is too few, rows are joined instead.
LEAST_BITS, MOST_BITS = 256, 2048
CHUNK, BYTES_A_CELL, LEAST_CELLS, MOST_CELLS = 1 << 14, 128, 1 << 16, 1 << 24
BITS_A_ROW, MOST_FETCH_BITS = 16, 1 << 26
#: Rows of a block of a long posting list, and partners that a component draws in each list in each round but the last.
BLOCK, DRAWN = 2048, (2,)
BYTES = 1 << 19
#: Shares of the prefix shingles that are shuffled one after another.
SHARES = 4
#: Classes and shingles of a chunk of a component, and shingles counted at once, when links are listed or counted.
CHUNK_CLASSES, CHUNK_SHINGLES, COLUMNS = 512, 1 << 20, 1 << 13

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, and the first word of each text and the end."""
    n = len(data)
    starts, ends = [], []
    heads = offsets[:-1][np.diff(offsets) > 0]
    for a in range(0, n, SPAN):  # a byte before and behind, so that a word may lie across windows
        b = min(a + SPAN, n)
        word = ~_SPACE[data[max(a - 1, 0) : b + 1]]
        lead, own = int(a > 0), word[int(a > 0) : int(a > 0) + b - a]
        first = np.zeros(b - a + 1, dtype=bool)  # a text starts here
        i, j = np.searchsorted(heads, [a, b + 1])
        first[heads[i:j] - a] = True
        before = np.concatenate([[False], own[:-1]]) if not lead else word[: b - a]
        behind = np.append(own[1:], word[lead + b - a] if lead + b - a < len(word) else False)
        starts.append(np.flatnonzero(own & (~before | first[:-1])) + a)
        ends.append(np.flatnonzero(own & (~behind | first[1:])) + a + 1)
    s, e = np.concatenate(starts), np.concatenate(ends)
    return span_hashes(lambda a, b: _BYTE[_LOWER[data[a:b]]], n, s, e), np.searchsorted(s, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """Distinct shingle hashes, by document and then hash: (hashes, first of each document and the end). data, offsets: UTF-8
    texts laid end to end. A-Z are lower-cased, words are runs of [^\\x20\\x09-\\x0D]; fewer than n words are one shingle. A long text's
    words are hashed in windows, and memory beyond the text is some bytes a word."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, dtype=U64), np.zeros(docs + 1, dtype=np.int64)
    w, first = _words(data, offsets)
    if docs == 1:
        if not len(w):
            return w, np.array([0, 0])
        if len(w) > SPAN:
            parts = [np.unique(_shingles(w[k : k + SPAN + n - 1], min(SPAN, len(w) - n + 1 - k), n, n)) for k in range(0, len(w) - n + 1, SPAN)]
            del w
            h = np.concatenate(parts)
            del parts
            h.sort()
            h = h[np.concatenate([[True], h[1:] != h[:-1]])]
            return h, np.array([0, len(h)])
    words = np.diff(first)
    owner = np.repeat(np.arange(docs, dtype=np.int32), words)
    k = np.arange(len(w)) - first[owner]  # word number in its document
    take = np.where(words < n, 1, words - n + 1) * (words > 0)  # shingles a document
    h = _shingles(w, len(w), n, np.minimum(words, n)[owner], k, words[owner])
    mine = k < take[owner]
    h, owner = h[mine], owner[mine]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(docs + 1))


def _shingles(w: np.ndarray, m: int, n: int, size, k: np.ndarray | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the m shingles that start at the first words of w; size: words of each; k, words: number of each word in its document,
    and of words there (without them, all shingles have n words)."""
    h = np.zeros(m, dtype=U64)
    for j in range(n):
        factor = U64((0x9E3779B97F4A7C15 * (2 * j + 1) + 0xC2B2AE3D27D4EB4F * j) % (1 << 64) | 1)
        if k is None:
            h += mix64(w[j : j + m] + U64(j)) * factor
        else:
            at = np.flatnonzero(k + j < words)
            h[at] += mix64(w[at + j] + U64(j)) * factor
    return mix64(h + (U64(size) if np.isscalar(size) else size.astype(U64)))


def _sets_of(batch: pa.RecordBatch, n: int):
    """(i, j, hashes, firsts) over slices of a batch's documents; columns doc_id, text."""
    data, offsets = utf8_buffers(batch.column(1))
    for i, j in slices(offsets, BYTES):
        part = offsets[i : j + 1]
        yield i, j, *shingle_sets(data[part[0] : part[-1]], part - part[0], n)


def _keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set: two sums over its mixed elements, mixed with its size. 0, 0 for the empty set."""
    size = np.diff(first).astype(U64)
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        sums = np.zeros(len(h) + 1, dtype=U64)
        np.cumsum(mix64(h ^ U64(salt)), out=sums[1:])
        out.append(np.where(size > 0, mix64(sums[first[1:]] - sums[first[:-1]] + size * U64(salt | 1)), U64(0)).view(np.int64))
    return out[0], out[1]


def _bits_of(size: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


def _bitmaps(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each set's parity bitmap, as wide as the set is large, within bounds."""
    bits = _bits_of(np.diff(first))
    at = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(bits)), np.diff(first))
    place = at[owner] + (h & (bits[owner] - 1).astype(U64)).astype(np.int64)
    odd = (np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[x // 8 : y // 8] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _bit_matrix(data: np.ndarray, offsets: np.ndarray, narrow: int) -> np.ndarray:
    """Bitmaps of at least `narrow` bits folded to that width, as rows of 64-bit words; XOR of the halves keeps parity."""
    words = narrow // 64
    out = np.zeros((len(offsets) - 1, words), dtype=np.uint64)
    size = np.diff(offsets) * 8
    for s in np.unique(size[size >= narrow]).tolist():
        at = np.flatnonzero(size == s)
        m = data[offsets[at][:, None] + np.arange(s // 8)].view("<u8")
        while m.shape[1] > words:
            m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
        out[at] = m
    return out


def _binary_buffers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls laid end to end, and the n + 1 offsets."""
    c = column.combine_chunks()
    c = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c).cast(pa.large_binary())
    _, offsets, data = c.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=c.offset + len(c) + 1)[c.offset :]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), at


def _pairs_in(group: np.ndarray):
    """All (i, j), i < j, of rows of the same group; equal groups lie side by side. Streams over lags to bound memory."""
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]), len(group) - 1)
    last = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
    live, lag, held, n = np.arange(len(group)), 1, [], 0
    while True:
        live = live[live + lag <= last[live]]
        if not len(live):
            break
        held.append((live, live + lag))
        n += len(live)
        if n > 200_000:
            yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held, n = [], 0
        lag += 1
    if held:
        yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, shares: int = SHARES) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row of docs.

    Rows link when den * |x & y| >= num * |x | y| over their sets of distinct n-word shingles. component_id is the smallest doc_id
    reachable by links, itself included; class_id the smallest doc_id with the same set. A null or blank text has the empty set and
    links with nothing. Rows of one doc_id are told apart by their sets; a null doc_id is kept and never the smallest, unless all
    are null. An empty table gives an empty result; other columns are not read. shares: prefix shingles are shuffled in so many parts, one
    after another, which takes less disk; the result is the same."""
    sets, named_classes, _ = _classes(docs, id_col, text_col, n, num, den, shares)
    return _placed(sets, named_classes)


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, shares: int = SHARES) -> DataFrame:
    """class_a, class_b, n_a, n_b, shared: every link between two classes of ngram_components, once, class_a < class_b, with the sizes of
    their sets and of what they share. Rows of one class link with each other and are not listed. A class without an id is null."""
    listed = lambda held, labels, hashes, classes: _in_cells(held, labels, hashes, classes, num, den, True)
    _, named_classes, links = _classes(docs, id_col, text_col, n, num, den, shares, listed)
    end = lambda c: named_classes.select(F.col("k1").alias(c), F.col("class_id").alias(f"class_{c}"))
    swap = F.coalesce(F.col("class_a") > F.col("class_b"), F.col("class_a").isNull())
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    return links.join(end("a"), "a").join(end("b"), "b").select(pick("class_a", "class_b", "class_a"), pick("class_b", "class_a", "class_b"), pick("n_a", "n_b", "n_a"), pick("n_b", "n_a", "n_b"), "shared")


def ngram_link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, shares: int = SHARES) -> DataFrame:
    """ngram_components with n_links: how many other rows each row links with, those with the same set included. Links are counted where
    they are found, so pairs are never laid out."""
    counted = lambda held, labels, hashes, classes: _in_cells(held, labels, hashes, classes, num, den, False)
    sets, named_classes, links = _classes(docs, id_col, text_col, n, num, den, shares, counted)
    far = links.groupBy("k1").agg(F.sum("far").alias("far"))
    return _placed(sets, named_classes.join(far, "k1", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("far", F.lit(0))), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, shares: int, count=None):
    """Rows' sets (doc_id, n, k1, k2); classes (k1, k2, class_id) with component_id and, if count is given, what it makes of (labels, sets
    of classes, classes)."""
    rows = text_table(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // BYTES_A_CELL).bit_length()))
    shift = U64(65 - cells.bit_length())

    def named(batches):
        held = np.zeros(cells, dtype=np.uint32)
        for b in batches:
            for i, j, h, first in _sets_of(b, n):
                k1, k2 = _keys(h, first)
                np.add.at(held, (h >> shift).astype(np.int64), 1)
                m = j - i
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(i, m), "n": pa.array(np.diff(first).astype(np.int32)), "k1": pa.array(k1), "k2": pa.array(k2), "chunk": pa.nulls(m, pa.int32()), "cells": pa.nulls(m, pa.binary())})
        parts = held.reshape(-1, min(CHUNK, cells))
        some = np.flatnonzero(parts.any(axis=1)).tolist()
        for k in range(0, len(some), 64):
            at, m = some[k : k + 64], len(some[k : k + 64])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(m, pa.int64()), "n": pa.nulls(m, pa.int32()), "k1": pa.nulls(m, pa.int64()), "k2": pa.nulls(m, pa.int64()), "chunk": pa.array(at, pa.int32()), "cells": pa.array([packed_counts(parts[x]) for x in at], pa.binary())})

    both = _spill(rows.mapInArrow(named, "doc_id long, n int, k1 long, k2 long, chunk int, cells binary"), "join-sketches")
    sets = _spill(both.where("chunk is null").select("doc_id", "n", "k1", "k2"), "join-sets")
    order = _rarity(both, cells)
    forget(both)  # a sketch of every task
    with Temporaries() as held:
        classes = held.spill(sets.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "join-classes")
        labels, hashes = _link_classes(held, rows, order, classes, n, num, den, shares)
        release(rows.sparkSession)
        more = _spill(count(held, labels, hashes, classes), "join-counted") if count else None
        of = classes.join(labels, "k1", "left").withColumn("component", F.coalesce("component", "k1"))
        # Component of each class: the smallest member of any of its classes.
        least = held.spill(of.groupBy("component").agg(F.min("class_id").alias("component_id")), "join-least")
        named_classes = _spill(of.join(least, "component").select("k1", "k2", "class_id", "component_id", "copies"), "join-components")
    return sets, named_classes, more


def _rarity(both: DataFrame, cells: int) -> np.ndarray:
    """A byte for each cell of the sketch that grows with its count: exact up to 31, then by eighths of a doubling."""
    counts = np.zeros(cells, dtype=np.int64)
    chunk = min(CHUNK, cells)
    for c, x in merge_arrays(both.where("chunk is not null").select("chunk", "cells"), "sum").items():
        counts[c * chunk : (c + 1) * chunk] = x
    return np.where(counts < 32, counts, np.minimum(255, 31 + 8 * np.log2(np.maximum(counts, 32) / 31))).astype(np.uint8)


def _placed(sets: DataFrame, named_classes: DataFrame, *more) -> DataFrame:
    out = sets.join(named_classes, ["k1", "k2"], "left")
    own = lambda c: F.when(F.col("n") > 0, F.coalesce(c, "doc_id")).otherwise(F.col("doc_id")).alias(c)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own("component_id"), own("class_id"), *more)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, shares: int = SHARES) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, all columns as they are. Rows of one id all stay or all go, as the
    component of any of them says; rows without an id stay."""
    found = ngram_components(docs, id_col, text_col, n, num, den, shares)
    name = free_name(docs, "_join_gone")
    gone = _spill(found.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "join-gone")
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")


def _link_classes(held: Temporaries, rows: DataFrame, order: np.ndarray, classes: DataFrame, n: int, num: int, den: int, shares: int) -> tuple[DataFrame, DataFrame]:
    """(k1, component) for every class that meets another, component is some k1; and (k1, hashes) of, at least, all classes that link."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(order)  # at most MOST_CELLS bytes
    shift, spill = U64(65 - len(order).bit_length()), held.spill

    def prefixes(batches):
        seen = np.zeros(0, dtype=np.int64)
        order_of = sent.value
        for b in batches:
            for _, _, h, first in _sets_of(b, n):
                k1, _ = _keys(h, first)
                size = np.diff(first)
                # Copies add nothing; what a task misses is dropped later.
                fresh = np.zeros(len(size), dtype=bool)
                fresh[np.unique(k1, return_index=True)[1]] = True
                fresh &= (size > 0) & ~np.isin(k1, seen)
                if len(seen) < 200_000:
                    seen = np.concatenate([seen, k1[fresh]])
                owner = np.repeat(np.arange(len(size)), size)
                keep = fresh[owner]
                h, owner = h[keep], owner[keep]
                size = size * fresh
                first = np.concatenate([[0], np.cumsum(size)])
                at = np.lexsort((h, order_of[(h >> shift).astype(np.int64)], owner))
                pos = np.arange(len(h)) - first[owner]
                length = size - -(-size * num // den) + 1
                pick = pos < length[owner]
                t, o, p = h[at][pick], owner[pick], pos[pick]
                maps = _bitmaps(h, first)
                f = np.flatnonzero(fresh)
                keys = np.concatenate([k1[o], k1[f]])
                yield pa.RecordBatch.from_pydict({
                    "token": pa.array(np.concatenate([t.view(np.int64), np.zeros(len(f), dtype=np.int64)])), "k1": pa.array(keys),
                    "n": pa.array(np.concatenate([size[o], size[f]]).astype(np.int32)), "pos": pa.array(np.concatenate([p, np.full(len(f), -1)]).astype(np.int32)),
                    "bits": pa.array([None] * len(t) + [maps[i] for i in f.tolist()], pa.binary()),
                })

    drawn = _spill(rows.mapInArrow(prefixes, "token long, k1 long, n int, pos int, bits binary"), "join-prefixes")
    posts = drawn.where("pos >= 0").select("token", "k1", "n", "pos")
    # Shingles in the prefix of one class only meet nobody; group minima are combined before the shuffle.
    # One share of the shingles at a time, so that the shuffles of one share are gone before the next one's.
    shared = []
    for k in range(shares):
        part = posts.where(F.pmod("token", F.lit(shares)) == k)
        met = part.groupBy("token").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("token")
        shared.append(_spill(part.join(met, "token", "left_semi").distinct(), "join-met"))
        del part, met
        release(spark)
    posts = reduce(DataFrame.unionByName, shared)
    sizes = posts.groupBy("token").agg(F.count("*").alias("posts"))
    posts = posts.join(sizes, "token").withColumn("salt", F.pmod(F.xxhash64("k1", F.lit(17)), F.ceil(F.col("posts") / BLOCK)).cast("int"))
    posts = spill(posts, "join-posts")
    for part in shared:
        forget(part)
    keys = spill(posts.select("k1").distinct(), "join-keys")
    maps = spill(drawn.where("pos < 0").select("k1", "bits").join(keys, "k1", "left_semi").dropDuplicates(["k1"]), "join-bits")
    forget(drawn)
    release(spark)

    labels, sets, tried = None, None, None
    for most in (*DRAWN, None):
        if labels is None:
            live = posts.withColumn("component", F.col("k1"))
        else:  # lists that still hold two components
            live = posts.join(labels, "k1")
            mixed = live.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
            live = live.join(mixed, "token", "left_semi")
        pairs = _draw(live.join(maps, "k1"), num, den, most)
        pairs = pairs.groupBy("a", "b").agg(F.first("ca").alias("ca"), F.first("cb").alias("cb"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = spill(pairs, "join-pairs")
        del live
        release(spark)  # the bitmaps' shuffle is gone before the sets' one
        if labels is not None and is_empty(pairs):
            continue
        before = keys.withColumn("component", F.col("k1")) if labels is None else labels
        asked = pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()
        if sets is not None:
            asked = spill(asked.join(sets.select("k1"), "k1", "left_anti"), "join-asked")
        if sets is None or not is_empty(asked):
            fetched = _fetch_sets(held, rows, classes, asked, n)
            sets = fetched if sets is None else sets.unionByName(fetched)
        links = spill(_verify(pairs, sets, num, den), "join-links")
        release(spark)
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        joined = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        labels = spill(before.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("k1", F.coalesce("to", "component").alias("component")), "join-labels")
    return labels, sets


def _draw(live: DataFrame, num: int, den: int, most: int | None) -> DataFrame:
    """Pairs (a, b, ca, cb) of classes a < b in different components ca, cb that meet on a prefix shingle and pass the filters.

    With most: of each posting list's block, each component's `most` nearest. Without: all, with blocks of a long list paired."""
    if most is None:
        s = F.ceil(F.col("posts") / BLOCK).cast("int")
        live = live.withColumn("other", F.explode(F.sequence(F.lit(0), s - 1))).withColumn("block", F.least("salt", "other") * s + F.greatest("salt", "other"))
    else:
        live = live.withColumn("other", F.lit(0)).withColumn("block", F.col("salt"))
    live = live.select("token", "block", "k1", "n", "pos", "component", "bits", "salt", "other")
    parts = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    live = live.repartition(parts, "token", "block").sortWithinPartitions("token", "block", "k1")

    def draw(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            token, block = t.column("token").to_numpy(), t.column("block").to_numpy()
            cut = np.flatnonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1]))
            if not len(cut):
                held = t
                continue
            held = t.slice(cut[-1] + 1)
            yield from found(t.slice(0, cut[-1] + 1))
        if held is not None:
            yield from found(held)

    def found(t: pa.Table):
        token, block, k, size, pos, comp, salt, other = (t.column(c).to_numpy() for c in ("token", "block", "k1", "n", "pos", "component", "salt", "other"))
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        group = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]) | (block[1:] != block[:-1])]))
        maps = _binary_buffers(t.column("bits"))
        wide = {w: _bit_matrix(*maps, w) for w in np.unique(_bits_of(size)).tolist()}
        chosen = []
        for i, j in _pairs_in(group):
            ok = (comp[i] != comp[j]) & (np.minimum(size[i], size[j]) * den >= num * np.maximum(size[i], size[j]))
            if most is None:
                ok &= (salt[i] != salt[j]) | (salt[i] == other[i])  # a block of two salts is there for pairs between them
            i, j = i[ok], j[ok]
            both = size[i] + size[j]
            need = -(-num * both // (den + num))  # |x & y| of a pair that links
            ok = np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need  # the shared shingle and what follows it
            i, j, both, need = i[ok], j[ok], both[ok], need[ok]
            if not len(i):
                continue
            differ = np.zeros(len(i), dtype=np.int64)
            width = np.minimum(_bits_of(size[i]), _bits_of(size[j]))
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                m = wide[w]
                for c in range(0, len(at), 65536):
                    x = at[c : c + 65536]
                    differ[x] = np.bitwise_count(m[i[x]] ^ m[j[x]]).sum(axis=1)
            ok = differ <= both - 2 * need
            if ok.any():
                chosen.append((i[ok], j[ok], differ[ok]))
        if not chosen:
            return
        i, j, d = (np.concatenate(x) for x in zip(*chosen, strict=True))
        if most is not None:  # each component's nearest in its list
            ends, twice, dist = np.concatenate([comp[i], comp[j]]), np.tile(np.arange(len(i)), 2), np.tile(d, 2)
            order = np.lexsort((k[j[twice]], k[i[twice]], dist, ends, np.tile(group[i], 2)))
            g, c = np.tile(group[i], 2)[order], ends[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
            nth = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            pick = np.unique(twice[order[nth < most]])
            i, j = i[pick], j[pick]
        swap = k[i] > k[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        order = np.lexsort((k[j], k[i]))
        new = np.concatenate([[True], (k[i][order][1:] != k[i][order][:-1]) | (k[j][order][1:] != k[j][order][:-1])])
        one = order[new]
        for c in range(0, len(one), 100_000):
            x = one[c : c + 100_000]
            yield pa.RecordBatch.from_pydict({"a": pa.array(k[i[x]]), "b": pa.array(k[j[x]]), "ca": pa.array(comp[i[x]]), "cb": pa.array(comp[j[x]])})

    return live.mapInArrow(draw, "a long, b long, ca long, cb long")


def _fetch_sets(held: Temporaries, rows: DataFrame, classes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(k1, hashes) of the wanted classes, hashed again from the smallest member's text. A bit filter, as large as what is wanted, tells
    which rows to hash, so texts and sets aren't shuffled for it; a row that it lets through in error is a set that no pair asks for, or
    a copy. Where the filter would outgrow its bound, rows are joined with the wanted ids instead."""
    ids = held.spill(classes.join(wanted, "k1").select(F.coalesce("class_id", F.lit(-1)).alias("doc_id")), "join-ids")
    bits = 1 << max(17, (ids.count() * BITS_A_ROW).bit_length())
    if bits > MOST_FETCH_BITS:
        rows = rows.join(ids.distinct().withColumnRenamed("doc_id", "wanted"), F.coalesce("doc_id", F.lit(-1)) == F.col("wanted"), "left_semi")
        sent = None
    else:
        sent = rows.sparkSession.sparkContext.broadcast(_row_filter(ids, bits))  # at most MOST_FETCH_BITS / 8 bytes

    def fetch(batches):
        for b in batches:
            if sent is not None:
                x = (mix64(b.column(0).fill_null(-1).to_numpy().view(U64)) & U64(bits - 1)).astype(np.int64)
                b = b.filter(pa.array((sent.value[x >> 3] >> (x & 7) & 1).astype(bool)))
            for _, _, h, first in _sets_of(b, n):
                k1, _ = _keys(h, first)
                at = np.flatnonzero(np.diff(first)).tolist()
                yield pa.RecordBatch.from_pydict({"k1": pa.array(k1[at]), "hashes": pa.array([h[first[r] : first[r + 1]].tobytes() for r in at], pa.binary())})

    return held.spill(rows.mapInArrow(fetch, "k1 long, hashes binary"), "join-hashes")


def _row_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """`bits` bits, those of the ids' hashes set."""
    chunk = 1 << 14

    def flag(batches):
        own = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            x = (mix64(b.column(0).to_numpy().view(U64)) & U64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(own, x >> 3, (1 << (x & 7)).astype(np.uint8))
        parts = own.reshape(-1, chunk)
        at = np.flatnonzero(parts.any(axis=1)).tolist()
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(at, pa.int32()), "cells": pa.array([packed_counts(parts[i]) for i in at], pa.binary())})

    out = np.zeros(bits // 8, dtype=np.uint8)
    for c, x in merge_arrays(ids.select("doc_id").mapInArrow(flag, "chunk int, cells binary"), "or").items():
        out[c * chunk : (c + 1) * chunk] = x
    return out


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets link."""

    def check(batches):
        for b in batches:
            x, y = b.column(2), b.column(3)
            ok = np.zeros(len(b), dtype=bool)
            for r in range(len(b)):
                p, q = np.frombuffer(x[r].as_buffer(), dtype=U64), np.frombuffer(y[r].as_buffer(), dtype=U64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                ok[r] = den * both >= num * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["ca", "cb"]).filter(pa.array(ok))

    with_a = pairs.join(sets.select(F.col("k1").alias("a"), F.col("hashes").alias("x")), "a")
    both = with_a.join(sets.select(F.col("k1").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("ca", "cb", "x", "y").mapInArrow(check, "ca long, cb long")


def _in_cells(held: Temporaries, labels: DataFrame, sets: DataFrame, classes: DataFrame, num: int, den: int, listed: bool) -> DataFrame:
    """All links between classes, found by comparing the classes of each component. listed: (a, b, n_a, n_b, shared) for every two classes
    a < b (k1) that link; else (k1, far), how many rows of other classes a class links with, in parts to be summed up."""
    sizes = labels.join(classes.select("k1", "copies"), "k1").join(sets.select("k1", (F.octet_length("hashes") / 8).cast("long").alias("n")).dropDuplicates(["k1"]), "k1")
    members = held.spill(sizes, "join-members")
    groups = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1")
    chunks = F.ceil(F.greatest(F.col("m") / CHUNK_CLASSES, F.col("total") / CHUNK_SHINGLES)).cast("int")
    dealt = members.join(groups.select("component", chunks.alias("chunks")), "component")
    dealt = dealt.select("k1", "component", "copies", "chunks", F.pmod(F.xxhash64("k1", F.lit(23)), F.col("chunks")).cast("int").alias("c"))
    dealt = dealt.join(sets.dropDuplicates(["k1"]), "k1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("component", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "k1", "copies", "hashes")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "k1")

    def link(batches):
        kept = None
        for b in batches:
            t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            g = np.stack([t.column(c).to_numpy() for c in ("component", "i", "j")])
            cut = np.concatenate([[0], np.flatnonzero((g[:, 1:] != g[:, :-1]).any(axis=0)) + 1])
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield from cell(t.slice(x, y - x))
            kept = t.slice(cut[-1])
        if kept is not None and len(kept):
            yield from cell(kept)

    def cell(t: pa.Table):
        k, c, copies = (t.column(x).to_numpy() for x in ("k1", "c", "copies"))
        data, at = _binary_buffers(t.column("hashes"))
        h = data[at[0] : at[-1]].view(U64)
        size = np.diff(at) // 8
        _, place, times = np.unique(h, return_inverse=True, return_counts=True)
        met = times[place] > 1  # shingles of one class only are shared with nobody
        place, owner = (np.cumsum(times > 1) - 1)[place[met]], np.repeat(np.arange(len(k), dtype=np.int32), size)[met]
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        shared = np.zeros((len(k), len(k)), dtype=np.int64)
        for first in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
            x, y = np.searchsorted(place, [first, first + COLUMNS])
            has = np.zeros((len(k), min(COLUMNS, int(place[-1]) + 1 - first)), dtype=np.float32)
            has[owner[x:y], place[x:y] - first] = 1
            shared += (has @ has.T).astype(np.int64)
        ok = den * shared >= num * (size[:, None] + size - shared)
        if t.column("i")[0] != t.column("j")[0]:
            ok &= c[:, None] != c  # pairs within a chunk have a cell of their own
        if listed:
            for r in range(0, len(k), 64):  # some rows of the matrix at once
                p, q = np.nonzero(np.triu(ok[r : r + 64], r + 1))
                yield pa.RecordBatch.from_pydict({"a": pa.array(k[p + r]), "b": pa.array(k[q]), "n_a": pa.array(size[p + r]), "n_b": pa.array(size[q]), "shared": pa.array(shared[p + r, q])})
        else:
            np.fill_diagonal(ok, False)
            far = ok @ copies
            some = np.flatnonzero(far)
            yield pa.RecordBatch.from_pydict({"k1": pa.array(k[some]), "far": pa.array(far[some].astype(np.int64))})

    return dealt.mapInArrow(link, "a long, b long, n_a long, n_b long, shared long" if listed else "k1 long, far long")
