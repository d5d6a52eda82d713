"""Byte-level BPE over Arrow batches: a worker cache of pre-tokens in front of the tokenizers library.

Pre-tokens are found with array operations from a table of character classes that is read off the library's own pre-tokenizer;
each is looked up by a 64-bit hash, and those not met before are merged by the tokenizer's own merge list, all of a batch side by
side. Texts that hold a special token's string or code points outside the probed blocks, pre-tokens of more than LONGEST
characters, and tokenizers of any other kind go to the library. Results are the library's (tests/llm compare them)."""

from __future__ import annotations

import json as js

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .common import U64, mix64, span_hashes

LONGEST = 64
SEGMENT = 1 << 18
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 3, 9
NEVER = 2**31 - 1
#: The basic plane without surrogates, mathematical letters, pictographs.
BLOCKS = (range(0xD800), range(0xE000, 0x10000), range(0x1D400, 0x1D800), range(0x1F000, 0x1FC00))


def tokenizer_json(name: str = "byte_bpe_50k.json", path: str | None = None) -> str:
    """The tokenizer's file as text, from a path or by its public name; a fixed size of about 1.5 MB."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def class_table(tok: Tokenizer) -> np.ndarray:
    """The class of every code point of BLOCKS, as the library's pre-tokenizer splits it: what stays with a letter is a letter, ..."""
    points = [c for block in BLOCKS for c in block]
    out = np.full(0x110000, UNKNOWN, dtype=np.uint8)
    out[points] = SPACE
    for kind, lead in ((OTHER, "!"), (NUMBER, "1"), (LETTER, "a")):
        text = "".join(f"{lead}{chr(c)}\n" for c in points)  # three characters each
        starts = np.zeros(len(text) + 1, dtype=bool)
        starts[[s for _, (s, _) in tok.pre_tokenizer.pre_tokenize_str(text)]] = True
        out[np.array(points)[~starts[1 : 3 * len(points) : 3]]] = kind
    return out


class Merger:
    """Applies the merge list to many pre-tokens side by side: in each round every pre-token merges its first pair of lowest rank."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
        names = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(kept))}
        self.byte = np.array([vocab[names[b]] for b in range(256)], dtype=np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.rank[i], NEVER)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece: how many, and all of them."""
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        sym = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)
        rank = np.full(len(sym), NEVER, dtype=np.int32)  # of the pair that starts here
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same] = self._ranks(sym[same], sym[same + 1])
        done_sym, done_owner = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            over = least == NEVER
            if over.any():
                done_sym.append(sym[over])
                done_owner.append(owner[over])
                sym, owner, rank, least = sym[~over], owner[~over], rank[~over], least[~over]
                if not len(sym):
                    break
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            at = np.minimum.reduceat(np.where(rank == least, np.arange(len(sym)), len(sym)), first)
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            rank[moved] = NEVER
            r = moved[moved + 1 < len(sym)]
            r = r[owner[r] == owner[r + 1]]
            rank[r] = self._ranks(sym[r], sym[r + 1])
            left = moved[moved > 0]
            left = left[owner[left] == owner[left - 1]] - 1
            rank[left] = self._ranks(sym[left], sym[left + 1])
        if not done_sym:
            return size, np.zeros(0, dtype=np.int32)
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        return np.bincount(owner, minlength=len(pieces)), sym[np.argsort(owner, kind="stable")]


def piece_starts(cp: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. cp: code points of texts laid end to end; first: where each non-empty text starts."""
    n = len(cp)
    kind = classes[cp]
    run = np.empty(n + 1, dtype=bool)
    run[0] = run[n] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:n])
    head = np.zeros(n + 1, dtype=bool)
    head[first] = head[n] = True
    run |= head
    st = run.copy()
    # The last blank before a word starts a piece; if it is a space, the word belongs to that piece.
    after = np.flatnonzero(run[1:n] & ~head[1:n] & (kind[:-1] == SPACE)) + 1
    st[after - 1] = True
    st[after[cp[after - 1] == 32]] = False
    # 's 't 'm 'd 're 've 'll after anything but a space.
    q = np.flatnonzero((cp == 39) & st[:n])
    q = q[q + 1 < n]
    q = q[run[q + 1] & ~head[q + 1] & (kind[q + 1] == LETTER)]
    if len(q):
        c1 = cp[q + 1]
        one = np.isin(c1, [ord(x) for x in "stmd"])
        c2 = np.where((q + 2 < n) & ~head[np.minimum(q + 2, n)], cp[np.minimum(q + 2, n - 1)], 0)
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        st[q[one | two] + 1] = False
        st[q[one] + 2] = True
        st[q[two] + 3] = True
    return np.flatnonzero(st[:n])


class Encoder:
    """One for each worker. slots: size of the cache, a power of two (16 bytes each); it starts anew when half full, so memory is bounded."""

    def __init__(self, json: str, classes: np.ndarray | None = None, frequent: dict[str, np.ndarray] | None = None, slots: int = 1 << 20):
        self.tok = Tokenizer.from_str(json)
        spec = js.loads(json)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.fast = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["normalizer"] is None and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.merger = Merger(model) if self.fast else None
        self.classes = (class_table(self.tok) if self.fast else np.zeros(0x110000, dtype=np.uint8)) if classes is None else classes
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.values = mix64(np.arange(1, 0x110001, dtype=U64) * U64(0x9E3779B97F4A7C15))
        self.slots, self.shift = slots, U64(64 - slots.bit_length() + 1)
        self.frequent = frequent
        self.misses = self.pieces = 0
        self._clear()

    def _clear(self):
        self.keys = np.zeros(self.slots, dtype=U64)
        self.at = np.zeros(self.slots, dtype=np.int32)
        self.size = np.zeros(self.slots, dtype=np.int32)
        self.pool, self.pooled, self.held = np.zeros(1 << 16, dtype=np.int32), 0, 0
        if self.frequent is not None:
            self._insert(self.frequent["keys"], self.frequent["sizes"], self.frequent["ids"])

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slots, or -1."""
        slot = (h >> self.shift).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, slot, -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            got = self.keys[slot[open_]]
            hit = got == h[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (got != 0)]
        return out

    def _insert(self, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        """h: distinct and not held."""
        if self.pooled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.pooled], np.zeros(max(len(ids), len(self.pool)) + len(ids), dtype=np.int32)])
        self.pool[self.pooled : self.pooled + len(ids)] = ids
        at = self.pooled + np.concatenate([[0], np.cumsum(sizes[:-1])]) if len(sizes) else sizes
        self.pooled += len(ids)
        slot, left = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.at[slot[put]], self.size[slot[put]] = h[put], at[put], sizes[put]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & (self.slots - 1)
        self.held += len(h)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _segment(self, texts: list[str], with_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and all ids (empty without with_ids)."""
        whole = "".join(texts)
        lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lens)
        if not whole:
            return np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.int32)
        cp = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        s = piece_starts(cp, (ends - lens)[lens > 0], self.classes)
        e = np.append(s[1:], len(cp))
        h = span_hashes(lambda a, b: self.values[cp[a:b]], len(cp), s, e)
        h[h == 0] = 1
        long = np.flatnonzero(e - s > LONGEST)
        self.pieces += len(s)
        slot = self._find(h)
        slot[long] = -2
        new = np.flatnonzero(slot == -1)
        if len(new):
            distinct, where = np.unique(h[new], return_index=True)
            if self.held + len(distinct) > self.slots // 2:
                self._clear()
                new = np.flatnonzero((self._find(h) == -1) & (slot != -2))
                distinct, where = np.unique(h[new], return_index=True)
            if self.held + len(distinct) > self.slots // 2:  # more than the cache can hold at once
                if len(texts) > 1:
                    half = len(texts) // 2
                    a, b = self._segment(texts[:half], with_ids), self._segment(texts[half:], with_ids)
                    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
                ids = self._library(texts)[0]
                return np.array([len(ids)]), np.array(ids if with_ids else [], dtype=np.int32)
            at = new[where]
            self.misses += len(at)
            self._insert(distinct, *self.merger.merge([whole[i:j].encode() for i, j in zip(s[at].tolist(), e[at].tolist(), strict=True)]))
            slot = self._find(h)
            slot[long] = -2
        size = np.where(slot >= 0, self.size[slot], 0).astype(np.int64)
        apart = {}
        for i in long.tolist():
            apart[i] = self._library([whole[s[i] : e[i]]])[0]
            size[i] = len(apart[i])
        upto = np.concatenate([[0], np.cumsum(size)])
        bound = np.searchsorted(s, ends)
        counts = np.diff(np.concatenate([[0], upto[bound]]))
        if not with_ids:
            return counts, np.zeros(0, dtype=np.int32)
        start = np.where(slot >= 0, self.at[slot], 0).astype(np.int64)
        ids = self.pool[np.minimum(np.repeat(start - upto[:-1], size) + np.arange(upto[-1]), len(self.pool) - 1)]
        for i, x in apart.items():
            ids[upto[i] : upto[i + 1]] = x
        return counts, ids

    def encode(self, texts: list[str], with_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and the ids of all texts one after another."""
        counts, ids = np.zeros(len(texts), dtype=np.int64), []
        group: list[tuple[int, str]] = []
        held = 0

        def flush():
            nonlocal group, held
            if group:
                c, x = self._segment([t for _, t in group], with_ids)
                np.add.at(counts, [i for i, _ in group], c)
                ids.append(x)
            group, held = [], 0

        for i, t in enumerate(texts):
            if not self.fast or any(x in t for x in self.special) or (not t.isascii() and len(t.encode("utf-16-le")) != 2 * len(t) and (self.classes[[ord(c) for c in set(t)]] == UNKNOWN).any()):
                flush()
                x = self._library([t])[0]
                counts[i] = len(x)
                ids.append(np.array(x if with_ids else [], dtype=np.int32))
                continue
            for part in parts_of(t):
                if held + len(part) > SEGMENT:
                    flush()
                group.append((i, part))
                held += len(part)
        flush()
        return counts, np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)


def parts_of(t: str):
    """A very long text in parts, cut before a single space between two non-blanks, where a pre-token starts in any case."""
    at = 0
    while len(t) - at > 2 * SEGMENT:
        cut = t.find(" ", at + SEGMENT)
        while cut != -1 and (t[cut - 1].isspace() or cut + 1 >= len(t) or t[cut + 1].isspace()):
            cut = t.find(" ", cut + 1)
        if cut == -1:
            break
        yield t[at:cut]
        at = cut
    yield t[at:] if at else t


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def chunks(texts: list[str], most: int = 1 << 20):
    """Ranges of texts with about so many characters."""
    i, held = 0, 0
    for j, t in enumerate(texts):
        if held + len(t) > most and j > i:
            yield i, j
            i, held = j, 0
        held += len(t)
    if i < len(texts):
        yield i, len(texts)


_WORKER: dict[tuple, Encoder] = {}


def shipped(spark, name: str = "byte_bpe_50k.json", path: str | None = None, frequent: dict[str, np.ndarray] | None = None):
    """Broadcast what a worker needs to encode: the tokenizer's file, the class table and, if given, a table of frequent pre-tokens.
    All three have fixed sizes (1.5 MB, 1.1 MB, at most its parameter's entries)."""
    return spark.sparkContext.broadcast((*parts_to_ship(name, path)[:2], frequent))


def parts_to_ship(name: str, path: str | None) -> tuple[str, bytes, None]:
    json = tokenizer_json(name, path)
    return json, Encoder(json, slots=1 << 10).classes.tobytes(), None


def worker_encoder(sent) -> Encoder:
    """The worker's own encoder, kept from task to task so that its cache stays warm."""
    json, classes, frequent = sent.value
    key = (hash(json), None if frequent is None else hash(frequent["keys"].tobytes()))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(json, np.frombuffer(classes, dtype=np.uint8), frequent)
    return _WORKER[key]
