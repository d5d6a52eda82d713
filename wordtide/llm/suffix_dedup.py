"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts earlier.

Each window of `length` bytes is owned by the smallest hash among its KEY-byte strings (the first of equals): its anchor. Windows of equal bytes
have equal anchors at equal offsets, so windows meet on their anchor's string alone, and no suffix leaves its group. A context is the
text under all neighbouring windows of one anchor, about 1.2 windows long. Equal contexts are counted once: the first stands for all, and
what it keeps or loses is decided with the different contexts of the same anchor string. Those are laid end to end, the shared
string as one symbol, and sorted by suffix (suffix_sort: Lyndon-prefix groups); neighbours in that order that agree over a window's
length start equal windows, of which the first in the corpus stays. Contexts that can't agree with any other over that length (by
how far they agree with their neighbours before and behind the anchor) are left out first.

Blocks of whole documents lie in the shared folder under numbers of their own. What is shuffled are packed arrays, a row for each block and
range of anchor hashes: 32 bytes an anchor before compression (about one in 24 bytes), each distinct context of a block once; then
the bytes of contexts whose anchor string has several contexts; then, to each block, what it loses. An anchor string with over HOT
contexts is taken apart into its windows, which meet on their own hash, so no common passage makes a large group. Contexts are told apart by
64-bit hashes (chances of a clash are about pairs / 2**64); windows of different contexts by their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Temporaries, _powers, bounded_batches, mix64, release, slices, spill, utf8_buffers
from .suffix_sort import suffix_array
from .words import _BYTE

#: Bytes of a block, window starts looked at together, bytes of an anchor string.
BLOCK, CHUNK, KEY = 2 << 20, 1 << 17, 50
#: Anchors of a group of the first shuffle, contexts of a group that is sorted, contexts of an anchor string that is taken apart.
ANCHORS, CONTEXTS, HOT = 1 << 18, 1 << 11, 1 << 11
_LOW = U64((1 << 24) - 1)
_LAST = np.iinfo(np.int64).max
_BLOCKS = "block long, size long, ids binary, named binary, ties binary, offsets binary, data binary"
_ENTRY = {"core": U64, "context": U64, "doc": np.int64, "tie": np.uint32, "start": np.uint32, "count": np.uint8, "offset": np.uint8}
_OPEN = {"start": np.uint32, "count": np.uint8, "offset": np.uint8, "core": U64, "doc": np.int64, "tie": np.uint32, "apart": np.uint8}


def _packed(columns: dict[str, np.ndarray], kinds: dict) -> bytes:
    n = len(next(iter(columns.values())))
    raw = b"".join(np.ascontiguousarray(columns[c], dtype=k).tobytes() for c, k in kinds.items())
    return n.to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpacked(b: bytes, kinds: dict) -> dict[str, np.ndarray]:
    b = memoryview(b)
    n, at, out = int.from_bytes(b[:8], "little"), 0, {}
    raw = pa.Codec("zstd").decompress(b[8:], n * sum(np.dtype(k).itemsize for k in kinds.values()), asbytes=True)
    for c, k in kinds.items():
        out[c] = np.frombuffer(raw, dtype=k, count=n, offset=at)
        at += n * np.dtype(k).itemsize
    return out


_TEXT = {"byte": np.uint8}
_GONE = {"start": np.uint32, "count": np.uint8}


def _blocks(batches):
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, ties = batch.column(0).fill_null(_LAST).to_numpy(), batch.column(1).to_numpy()
        named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        data, offsets = utf8_buffers(batch.column(2))
        for i, j in slices(offsets, BLOCK):
            part = offsets[i : j + 1]
            row = {"ids": ids[i:j], "named": named[i:j], "ties": ties[i:j].astype(np.uint32), "offsets": part - part[0]}
            row = {k: v.tobytes() for k, v in row.items()} | {"data": _packed({"byte": data[part[0] : part[-1]]}, _TEXT)}  # it is shuffled twice
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "size": pa.array([int(part[-1] - part[0])], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in row.items()})
            block += 1


def _rows(batch: pa.RecordBatch):
    """Rows as dictionaries, one at a time; binary values are buffers, not copies."""
    for k in range(batch.num_rows):
        yield {c: v.as_buffer() if pa.types.is_binary(v.type) and v.is_valid else [x.as_py() for x in v.values] if pa.types.is_list(v.type) and v.is_valid else v.as_py() for c, v in ((c, batch.column(c)[k]) for c in batch.schema.names)}


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """core, context: hashes of each anchor's string and context; start, count: its windows; offset: of the anchor in the context;
    row: the document. CHUNK windows are looked at together; a context that lies across two chunks counts as two."""
    up, down = _powers()
    ends = np.repeat(offsets[1:], np.diff(offsets)) if len(data) else np.zeros(0, dtype=np.int64)  # of the document at each byte
    held = []
    for x in range(0, max(len(data) - length + 1, 0), CHUNK):
        d = data[x : x + CHUNK + length - 1]
        n = len(d) - length + 1
        sums = np.zeros(len(d) + 1, dtype=U64)
        np.cumsum(_BYTE[d] * up[: len(d)], out=sums[1:])
        h = mix64((sums[KEY:] - sums[:-KEY]) * down[: len(d) - KEY + 1])
        low = h & ~_LOW | np.arange(len(h)).astype(U64)
        width, reach = length - KEY + 1, 1
        while 2 * reach <= width:
            low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
        if width > reach:
            low = np.minimum(low[: -(width - reach)], low[width - reach :])
        anchor = (low & _LOW).astype(np.int64)
        at = np.flatnonzero(np.arange(n) + x + length <= ends[x : x + n])  # windows that lie in one document
        if not len(at):
            continue
        own = anchor[at]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
        start, count, own = at[new], np.diff(np.append(new, len(at))), own[new]
        size = count + length - 1
        context = mix64((sums[start + size] - sums[start]) * down[start] + size.astype(U64) * U64(0xD6E8FEB86659FD93))
        held.append({"core": h[own], "context": context, "start": start + x, "count": count, "offset": own - start})
    if not held:
        return {c: np.zeros(0, dtype=np.int64) for c in ("core", "context", "start", "count", "offset", "row")}
    out = {c: np.concatenate([part[c] for part in held]) for c in held[0]}
    out["row"] = np.searchsorted(offsets, out["start"], side="right") - 1
    return out


def _entries(length: int, groups: int):
    """Blocks -> grp, block, entries (a block's distinct contexts of that range of anchor hashes), gone (a block's repeats of its own)."""

    def entries(batches):
        for batch in batches:
            for r in _rows(batch):
                offsets, ids, ties = np.frombuffer(r["offsets"], dtype=np.int64), np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["ties"], dtype=np.uint32)
                x = _anchors(_unpacked(r["data"], _TEXT)["byte"], offsets, length)
                if not len(x["start"]):
                    continue
                rank = np.empty(len(ids), dtype=np.int64)
                rank[np.lexsort((ties, ids))] = np.arange(len(ids))
                order = np.lexsort((x["start"], rank[x["row"]], x["context"]))
                first = np.ones(len(order), dtype=bool)
                first[1:] = x["context"][order[1:]] != x["context"][order[:-1]]
                gone, stay = order[~first], np.sort(order[first])
                group = ((x["core"][stay] >> U64(20)) % U64(groups)).astype(np.int64)
                x = {c: v[stay] if c not in ("start", "count") else v for c, v in x.items()}
                own = {"start": x["start"][gone], "count": x["count"][gone]}
                x |= {"start": x["start"][stay], "count": x["count"][stay], "doc": ids[x["row"]], "tie": ties[x["row"]]}
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0, [True]]))
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    at = order[a:b]
                    part = _packed({c: x[c][at] for c in _ENTRY}, _ENTRY)
                    yield pa.RecordBatch.from_pydict({"grp": pa.array([int(group[at[0]])], pa.int32()), "block": pa.array([r["block"]], pa.int64()), "entries": pa.array([part], pa.binary()), "gone": pa.array([None if k or not len(gone) else _packed(own, _GONE)], pa.binary())})

    return entries


def _by_block(block: np.ndarray, columns: dict[str, np.ndarray], kinds: dict) -> dict[int, bytes]:
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0, [True]])) if len(block) else [0]
    return {int(block[order[a]]): _packed({c: columns[c][order[a:b]] for c in kinds}, kinds) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


_TOLD = "block long, gone binary, open binary, opened long"


def _told(gone: list[dict[int, bytes]], opened: dict[int, bytes], sizes: dict[int, int]) -> pa.Table:
    rows = [(b, g, None, 0) for part in gone for b, g in part.items()] + [(b, None, o, sizes[b]) for b, o in opened.items()]
    kinds = {"block": pa.int64(), "gone": pa.binary(), "open": pa.binary(), "opened": pa.int64()}
    return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(kinds.items())})


def _classes(rows: pa.Table) -> pa.Table:
    """Which entries of a range of anchor hashes are repeats, and which need their bytes compared."""
    parts = [_unpacked(b, _ENTRY) for b in rows["entries"].to_pylist()]
    block = np.repeat(rows["block"].to_numpy(), [len(p["core"]) for p in parts])
    x = {c: np.concatenate([p[c] for p in parts]) for c in _ENTRY} | {"block": block}
    order = np.argsort(x["core"], kind="stable")
    core = x["core"][order]
    same = core[1:] == core[:-1]
    often = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # strings that one context has stay as they are
    x = {c: v[often] for c, v in x.items()}
    order = np.lexsort((x["start"], x["block"], x["tie"], x["doc"], x["context"], x["core"]))
    x = {c: v[order] for c, v in x.items()}
    n = len(order)
    first = np.ones(n, dtype=bool)
    first[1:] = (x["core"][1:] != x["core"][:-1]) | (x["context"][1:] != x["context"][:-1])
    passed = [{b: g for b, g in [pair]} for pair in zip(rows["block"].to_pylist(), rows["gone"].to_pylist(), strict=True) if pair[1] is not None]
    gone = _by_block(x["block"][~first], {c: x[c][~first] for c in _GONE}, _GONE)
    x = {c: v[first] for c, v in x.items()}
    kinds, which, contexts = np.unique(x["core"], return_inverse=True, return_counts=True)
    several = contexts[which] > 1 if len(kinds) else np.zeros(0, dtype=bool)
    x["apart"] = (contexts[which] > HOT).astype(np.uint8) if len(kinds) else np.zeros(0, dtype=np.uint8)
    x = {c: v[several] for c, v in x.items()}
    sizes = dict(zip(*[v.tolist() for v in np.unique(x["block"], return_counts=True)], strict=True))
    return _told([*passed, gone], _by_block(x["block"], x, _OPEN), sizes)


_CUT = {"core": U64, "doc": np.int64, "tie": np.uint32, "start": np.uint32, "count": np.uint8, "offset": np.uint8}


def _spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Those spans of data end to end."""
    at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    return data[at]


def _cut(length: int, groups: int):
    """block, data, open (packed requests) -> grp, block, entries, bytes of contexts."""

    def cut(batches):
        up, down = _powers()
        for batch in batches:
            for r in _rows(batch):
                parts = [_unpacked(b, _OPEN) for b in r["open"]]
                x = {c: np.concatenate([p[c] for p in parts]) for c in _OPEN}
                data = _unpacked(r["data"], _TEXT)["byte"]
                hot = np.flatnonzero(x["apart"])
                x["window"] = x["core"].copy()
                if len(hot):  # every window of these by itself, under a hash of its own
                    count = x["count"][hot].astype(np.int64)
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    one = {c: np.repeat(v[hot], count) for c, v in x.items()}
                    one["start"], one["offset"], one["count"] = (one["start"] + step).astype(np.uint32), (one["offset"] - step).astype(np.uint8), np.ones(len(step), dtype=np.uint8)
                    text = _spans(data, one["start"].astype(np.int64), np.full(len(step), length)).reshape(-1, length)
                    one["core"] = mix64((_BYTE[text] * up[:length]).sum(axis=1, dtype=U64))
                    rest = np.flatnonzero(x["apart"] == 0)
                    x = {c: np.concatenate([v[rest], one[c]]) for c, v in x.items()}
                group = ((x["core"] >> U64(20)) % U64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0, [True]]))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    at = order[a:b]
                    text = _spans(data, x["start"][at].astype(np.int64), x["count"][at].astype(np.int64) + length - 1)
                    yield pa.RecordBatch.from_pydict({"grp": pa.array([int(group[at[0]])], pa.int32()), "block": pa.array([r["block"]], pa.int64()), "entries": pa.array([_packed({c: x[c][at] for c in _CUT}, _CUT)], pa.binary()), "bytes": pa.array([text.tobytes()], pa.binary())})

    return cut


def _may_agree(core: np.ndarray, left: np.ndarray, right: np.ndarray, need: int) -> np.ndarray:
    """Whether a context may share a window with another of its anchor string: how far it agrees with any other on either side of the
    string, which neighbours in sorted order tell, adds up to `need`. left, right: rows of bytes + 1 away from the string, 0 behind the end."""
    most = []
    for side in (left, right):
        order = np.lexsort((np.ascontiguousarray(side).view(f"S{side.shape[1]}").ravel(), core))
        a, b = side[order[1:]], side[order[:-1]]
        agree = np.logical_and.accumulate((a == b) & (a > 0), axis=1).sum(axis=1) * (core[order[1:]] == core[order[:-1]])
        alone = core[order[1:]] != core[order[:-1]]
        agree = np.where(alone, -need - 1, agree)
        m = np.empty(len(core), dtype=np.int64)
        m[order] = np.maximum(np.append(agree, -need - 1), np.concatenate([[-need - 1], agree]))
        most.append(m)
    return most[0] + most[1] >= need


def _sorted(length: int):
    """entries, bytes of contexts of a range of anchor strings -> what each block loses."""

    def decide(rows: pa.Table) -> pa.Table:
        parts = [_unpacked(b, _CUT) for b in rows["entries"].to_pylist()]
        block = np.repeat(rows["block"].to_numpy(), [len(p["core"]) for p in parts])
        x = {c: np.concatenate([p[c] for p in parts]).astype(np.int64 if c != "core" else U64) for c in _CUT} | {"block": block}
        data = np.frombuffer(b"".join(rows["bytes"].to_pylist()), dtype=np.uint8)
        size = x["count"] + length - 1
        base = np.cumsum(size) - size
        # Earliest first by document, then by place; the anchor's place, since contexts of one anchor may begin apart.
        rank = np.empty(len(size), dtype=np.int64)
        rank[np.lexsort((x["start"] + x["offset"], x["block"], x["tie"], x["doc"]))] = np.arange(len(size))
        around = np.arange(length - KEY)
        at = (base + x["offset"])[:, None] - 1 - around
        left = np.where(around < x["offset"][:, None], data[np.maximum(at, 0)] + np.uint8(1), np.uint8(0))
        behind = size - x["offset"] - KEY
        at = (base + x["offset"] + KEY)[:, None] + around
        right = np.where(around < behind[:, None], data[np.minimum(at, len(data) - 1)] + np.uint8(1), np.uint8(0))
        use = np.flatnonzero(_may_agree(x["core"], left, right, length - KEY))
        if not len(use):
            return _told([], {}, {})
        use = use[np.argsort(x["core"][use], kind="stable")]
        # One text: each context's symbols, the anchor string as one, and an end; the ends are the smallest symbols.
        core = np.unique(x["core"][use], return_inverse=True)[1]
        sizes = size[use] - KEY + 2
        start = np.cumsum(sizes) - sizes
        symbol = np.empty(int(sizes.sum()), dtype=np.int64)
        inner = np.arange(len(symbol)) - np.repeat(start, sizes)
        offset = np.repeat(x["offset"][use], sizes)
        source = np.repeat(base[use], sizes) + inner + np.where(inner > offset, KEY - 1, 0)
        symbol[:] = data[np.minimum(source, len(data) - 1)].astype(np.int64) + 2
        symbol[start + x["offset"][use]] = 258 + core
        symbol[start + sizes - 1] = 1
        order = suffix_array(symbol)
        owner = np.repeat(np.arange(len(use)), sizes)
        begins = inner < np.repeat(x["count"][use], sizes)
        at = order[begins[order]]  # starts of windows by what follows
        wide = np.lib.stride_tricks.sliding_window_view(symbol, length - KEY + 1)
        equal = np.concatenate([(wide[at[k : k + CONTEXTS + 1][1:]] == wide[at[k : k + CONTEXTS]][: len(at[k + 1 : k + CONTEXTS + 1])]).all(axis=1) for k in range(0, len(at), CONTEXTS)])
        heads = np.flatnonzero(np.concatenate([[True], ~equal]))
        ranks = rank[use][owner[at]]
        lowest = np.repeat(np.minimum.reduceat(ranks, heads), np.diff(np.append(heads, len(at))))
        lost = at[ranks > lowest]
        who = use[owner[lost]]
        return _told([_by_block(x["block"][who], {"start": x["start"][who] + inner[lost], "count": np.ones(len(lost))}, _GONE)], {}, {})

    return decide


def _covered(data: np.ndarray, gone: list[bytes], length: int) -> np.ndarray:
    """Whether each byte lies under a window that goes."""
    steps = np.zeros(len(data) + 1, dtype=np.int32)
    for part in gone:
        g = _unpacked(part, _GONE)
        s = g["start"].astype(np.int64)
        np.add.at(steps, s, 1)
        np.add.at(steps, s + g["count"] + (length - 1), -1)
    return np.cumsum(steps[:-1]) > 0


def _kept(length: int):
    def kept(batches):
        for batch in batches:
            for r in _rows(batch):
                data, offsets = _unpacked(r["data"], _TEXT)["byte"], np.frombuffer(r["offsets"], dtype=np.int64)
                off = _covered(data, r["gone"] or [], length)
                head = np.zeros(len(data) + 1, dtype=bool)
                head[offsets] = True
                begins = off & (head[:-1] | ~np.concatenate([[False], off[:-1]]))
                up_to = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[offsets].astype(np.int64)
                stay = data[~off].tobytes()
                ends = up_to(~off).tolist()
                ids = pa.array(np.frombuffer(r["ids"], dtype=np.int64), mask=~np.frombuffer(r["named"], dtype=bool))
                texts = [stay[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(np.diff(up_to(off))), "n_spans": pa.array(np.diff(up_to(begins))), "kept": pa.array(texts, pa.binary())})

    return kept


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay): every row of docs.

    A byte goes if a string of `length` bytes of its document covers it that also starts earlier, in a document of a smaller id or further
    ahead in its own; overlaps count, and strings are those of the input. Strings lie in one document. A null text is empty, and texts
    shorter than `length` stay whole. Documents without an id come last; rows of one id come in the order of a 32-bit hash of their texts, and
    equal rows one after the other. An empty table gives an empty result; other columns are not read. What stays need not be valid
    UTF-8, as removal is by bytes. length: from KEY + 1 to KEY + 200."""
    if not KEY < length <= KEY + 200:
        raise ValueError(f"windows of {KEY + 1} to {KEY + 200} bytes, not {length}")
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))).alias("tie"), text.alias("text"))
    with Temporaries() as t:
        blocks = t.spill(rows.mapInArrow(_blocks, _BLOCKS), "dedup-blocks")
        size = blocks.agg(F.sum("size")).first()[0] or 0
        groups = max(1, int(size / 24 / ANCHORS) + 1)
        entries = blocks.mapInArrow(_entries(length, groups), "grp int, block long, entries binary, gone binary")
        told = t.spill(entries.groupBy("grp").applyInArrow(_classes, _TOLD), "dedup-told")
        release(spark)
        groups = max(1, int((told.agg(F.sum("opened")).first()[0] or 0) / CONTEXTS) + 1)
        wanted = told.where("open is not null").groupBy("block").agg(F.collect_list("open").alias("open"))  # a block's own contexts
        cut = blocks.select("block", "data").join(wanted, "block").mapInArrow(_cut(length, groups), "grp int, block long, entries binary, bytes binary")
        more = t.spill(cut.groupBy("grp").applyInArrow(_sorted(length), _TOLD), "dedup-sorted")
        release(spark)
        gone = told.unionByName(more).where("gone is not null").groupBy("block").agg(F.collect_list("gone").alias("gone"))
        kept = blocks.drop("ties").join(gone, "block", "left").mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
        return spill(kept, "dedup-kept")


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """deduplicate() with kept_sha256, the SHA-256 of what stays, in place of it."""
    return deduplicate(docs, id_col, text_col, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
