"""Phrase collocation mining: the phrases of 2 to 4 words that a language uses far more than their parts would suggest.

Words that are frequent in their language get dense numbers; every other word breaks a piece, as a phrase of count >= least has only
words of count >= least. Texts become blocks of numbers, first those of the block's own dictionary (so that a word's text is
shuffled once a block, not once an occurrence), then the corpus' numbers by a join on (language, word). N-grams of numbers are packed into
fixed-width keys of 16 bytes, radix-sorted and run-length counted in each block, cut into key ranges, and each range is radix-sorted
and run-length counted again; a key comes from a block once, and where there are many blocks they are merged in a tree, so no
task holds a frequent phrase's occurrences. Range bounds come from a sample of keys of bounded size, which decides who counts what and not
what is counted. From there on everything is joins of counts.

Words are told apart within a block by 64-bit hashes of (language, word); everything else is exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, Temporaries, bounded_batches, mix64, slices, spill, utf8_buffers
from .words import LOWER, lowered_hashes, radix_order, table, word_spans

#: Bytes of text a block, tokens whose n-grams are sorted at once, keys of a range (a task's memory), keys sampled for the bounds of ranges,
#: and blocks whose counts of a range meet at once.
BLOCK, TOKENS, RANGE, SAMPLE, MERGE = 4 << 20, 1 << 19, 1 << 21, 1 << 16, 4096
_BREAK, _BLANK = table(b".,;:!?\n\x0b\x0c\r"), table(b" \t")


def _blocks(batches):
    """lang, text -> block, toks (numbers in the block's dictionary, -1 between pieces), langs, words, counts."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        langs = pa.array(batch.column(0)).dictionary_encode()
        names, which = langs.dictionary, langs.indices.to_numpy()
        data, offsets = utf8_buffers(batch.column(1))
        salt = lowered_hashes(*_laid(names)) if len(names) else np.zeros(0, dtype=U64)
        for i, j in slices(offsets, BLOCK):
            part = offsets[i : j + 1]
            d, o = data[part[0] : part[-1]], part - part[0]
            s, e = word_spans(d, o, _BREAK | _BLANK)
            doc = np.searchsorted(o, s, side="right") - 1
            lang = which[i:j][doc]
            h = mix64(lowered_hashes(d, s, e) + salt[lang] * U64(3))
            first, toks, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)[1:]
            breaks = np.flatnonzero(_BREAK[d])
            piece = np.searchsorted(breaks, s) + doc  # grows from piece to piece and from text to text
            out = np.full(2 * len(s), -1, dtype=np.int32)
            at = np.arange(len(s)) + (np.concatenate([[0], np.cumsum(np.diff(piece) > 0)]) if len(s) else 0)
            out[at] = toks
            out = out[: at[-1] + 1] if len(s) else out[:0]
            low = LOWER[d].tobytes()
            words = [low[a:b].decode() for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
            row = {"block": [block], "toks": [out.tobytes()], "langs": [names.take(pa.array(lang[first])).to_pylist()], "words": [words], "counts": [counts.tolist()]}
            yield pa.RecordBatch.from_pydict(row, schema=_BLOCK_SCHEMA)
            block += 1


def _laid(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = utf8_buffers(names)
    return data, offsets[:-1], offsets[1:]


_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("toks", pa.binary()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _numbered(batches):
    """block, toks, js, ids -> block, ids of all tokens (0: a break or a word that isn't frequent) as uint32."""
    for batch in batches:
        for block, toks, js, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            local = np.frombuffer(toks, dtype=np.int32)
            to = np.zeros(int(local.max(initial=-1)) + 2, dtype=np.uint32)
            to[np.array(js or [], dtype=np.int64)] = np.array(ids or [], dtype=np.uint32)
            to[-1] = 0  # breaks have the number -1
            yield pa.RecordBatch.from_pydict({"block": [block], "ids": pa.array([to[local].tobytes()], pa.binary())})


def _grams(ids: np.ndarray, most: int):
    """(hi, lo) keys of all n-grams of 2 to `most` numbers without a 0, in parts of TOKENS starts."""
    for a in range(0, len(ids), TOKENS):
        w = ids[a : a + TOKENS + most - 1].astype(U64)
        starts = min(TOKENS, len(ids) - a)
        w = np.concatenate([w, np.zeros(starts + most - len(w), dtype=U64)]) if len(w) < starts + most else w
        col = [w[k : k + starts] for k in range(most)]
        hi = col[0] << U64(32) | col[1]
        good, his, los = (col[0] > 0) & (col[1] > 0), [], []
        lo = np.zeros(starts, dtype=U64)
        for n in range(2, most + 1):
            if n > 2:
                good = good & (col[n - 1] > 0)
                lo = lo | col[n - 1] << U64(32 * (4 - n))
            at = np.flatnonzero(good)
            his.append(hi[at])
            los.append(lo[at])
        yield np.concatenate(his), np.concatenate(los)


def _counted(hi: np.ndarray, lo: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often they occur (the sum of c)."""
    order = radix_order([hi, lo])
    hi, lo = hi[order], lo[order]
    new = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.append(new, len(hi))) if c is None else (np.add.reduceat(c[order], new) if len(hi) else c)
    return hi[new], lo[new], n.astype(np.int64)


def _zip(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.Codec("zstd").compress(np.ascontiguousarray(x).tobytes(), asbytes=True)


def _unzip(b: bytes, kind) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(b[8:], n * np.dtype(kind).itemsize, asbytes=True), dtype=kind)


_RUNS = "part int, node long, hi binary, lo binary, c binary"


def _run(part: int, node: int, hi, lo, c) -> pa.RecordBatch:
    step = np.diff(hi, prepend=U64(0))  # ascending: differences compress
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "node": pa.array([node], pa.int64()), "hi": pa.array([_zip(step)], pa.binary()), "lo": pa.array([_zip(lo)], pa.binary()), "c": pa.array([_zip(c)], pa.binary())})


def _read(rows: pa.Table):
    hi = [np.cumsum(_unzip(x, U64), dtype=U64) for x in rows["hi"].to_pylist()]
    return np.concatenate(hi), np.concatenate([_unzip(x, U64) for x in rows["lo"].to_pylist()]), np.concatenate([_unzip(x, np.int64) for x in rows["c"].to_pylist()])


def _key_counts(ids: DataFrame, blocks: int, most: int, least: int) -> DataFrame:
    """key (4 bytes a word, big-endian), f: the n-grams of 2 to `most` words that occur `least` times."""
    tokens = ids.agg(F.sum(F.length("ids") / 4)).first()[0] or 0
    parts = max(1, int(tokens * (most - 1) / RANGE))
    each, step = max(1, SAMPLE // max(blocks, 1)), max(1, blocks // SAMPLE)

    def sampled(batches):
        for batch in batches:
            for block, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = np.frombuffer(b.as_buffer(), dtype=np.uint32).astype(U64)
                if block % step == 0 and len(w) > 1:
                    at = np.flatnonzero((w[1:] > 0) & (w[:-1] > 0))
                    at = at[:: max(1, len(at) // each)][:each]
                    yield pa.RecordBatch.from_pydict({"hi": pa.array((w[at] << U64(32) | w[at + 1]).view(np.int64))})

    drawn = np.array([r[0] for r in ids.mapInArrow(sampled, "hi long").collect()] if parts > 1 else [], dtype=np.int64).view(U64)  # SAMPLE numbers
    drawn.sort()
    bounds = np.unique(drawn[(np.arange(1, parts) * len(drawn) // parts)]) if len(drawn) else drawn

    def cut(hi, lo, c, node):
        ends = np.concatenate([[0], np.searchsorted(hi, bounds), [len(hi)]])
        for p in np.flatnonzero(np.diff(ends)).tolist():
            a, b = ends[p], ends[p + 1]
            yield _run(p, node, hi[a:b], lo[a:b], c[a:b])

    def runs(batches):
        for batch in batches:
            for block, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for hi, lo in _grams(np.frombuffer(b.as_buffer(), dtype=np.uint32), most):
                    yield from cut(*_counted(hi, lo), block)

    def merged(rows: pa.Table) -> pa.Table:
        part, node = rows["part"][0].as_py(), rows["node"][0].as_py()
        return pa.Table.from_batches([_run(part, node, *_counted(*_read(rows)))])

    def frequent(rows: pa.Table) -> pa.Table:
        hi, lo, c = _counted(*_read(rows))
        keep = c >= least
        keys = np.stack([hi[keep], lo[keep]], axis=1).astype(">u8").tobytes()
        size = [8 + 4 * int(x & 0xFFFFFFFF > 0) + 4 * int(x > 0) for x in lo[keep].tolist()]
        return pa.table({"key": pa.array([keys[16 * k : 16 * k + n] for k, n in enumerate(size)], pa.binary()), "f": pa.array(c[keep], pa.int64())})

    found = ids.mapInArrow(runs, _RUNS)
    nodes = blocks
    while nodes > MERGE:  # counts of a key come from every block: merge them in a tree
        nodes = -(-nodes // MERGE)
        found = found.withColumn("node", F.pmod(F.xxhash64("node"), F.lit(nodes))).groupBy("part", "node").applyInArrow(merged, _RUNS)
    return found.groupBy("part").applyInArrow(frequent, "key binary, f long")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, most: int = 4, inside: tuple[int, int] = (80, 100), scale: int = 2_000_000, k: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the k best phrases of every language.

    A-Z are lower-cased, pieces end at .,;:!? and line ends, words are runs without blanks and tabs. n: word occurrences of the language
    (und for null); a: occurrences of the phrase, overlaps included, at least `least`; l, r: those of its parts at the cut of the
    lowest score floor(scale x a / (l + r)), at the first of equal cuts. Phrases that lie in a longer one of at least inside[0] / inside[1] of
    their count go. Order: score, a, both falling, then the phrase's bytes. A null or blank text has no words; repeated rows count
    each; an empty table gives an empty result; no other column is read. most: 4 words at most, which a key holds."""
    if not 2 <= most <= 4:
        raise ValueError(f"phrases of 2 to 4 words, not {most}")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with Temporaries() as t:
        blocks = t.spill(rows.mapInArrow(_blocks, "block long, toks binary, langs array<string>, words array<string>, counts array<long>"), "phrase-blocks")
        words = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("j", "w")).select("block", "j", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
        totals = t.spill(words.groupBy("lang").agg(F.sum("c").alias("n")), "phrase-totals")
        often = t.spill(words.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least).withColumn("bin", F.pmod(F.xxhash64("lang", "word"), F.lit(256)).cast("int")), "phrase-often")
        before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sizes = often.groupBy("bin").agg(F.count("*").alias("n")).select("bin", before.alias("before"))  # 256 rows
        own = F.row_number().over(W.partitionBy("bin").orderBy("lang", "word"))
        vocabulary = t.spill(often.withColumn("own", own).join(F.broadcast(sizes), "bin").select((F.col("before") + F.col("own")).alias("id"), "lang", "word", "f"), "phrase-words")
        if (vocabulary.agg(F.max("id")).first()[0] or 0) >= 1 << 32:
            raise ValueError("over 2**32 frequent words: raise least")
        ids = words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("j", "id")).alias("x"))  # a block's words
        numbered = blocks.select("block", "toks").join(ids, "block").select("block", "toks", F.col("x.j").alias("js"), F.col("x.id").alias("ids"))
        numbered = t.spill(numbered.mapInArrow(_numbered, "block long, ids binary"), "phrase-ids")
        counts = t.spill(_key_counts(numbered, blocks.count(), most, least), "phrase-counts")
        return spill(_scored(counts, vocabulary, totals, inside, scale, k), "phrases")


def _scored(counts: DataFrame, vocabulary: DataFrame, totals: DataFrame, inside: tuple[int, int], scale: int, k: int) -> DataFrame:
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products may pass 64 bits
    single = vocabulary.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "f", "lang")
    parts = counts.select("key", "f", F.lit(None).cast("string").alias("lang")).unionByName(single)
    cut = F.explode(F.transform(F.sequence(F.lit(1), (F.length("key") / 4 - 1).cast("int")), lambda i: F.struct(i.alias("at"), F.substring(F.col("key"), F.lit(1), i * 4).alias("left"), F.substring(F.col("key"), i * 4 + 1, F.lit(16)).alias("right"))))
    cuts = counts.select("key", F.col("f").alias("a"), cut.alias("cut")).select("key", "a", "cut.*")
    cuts = cuts.join(parts.select(F.col("key").alias("left"), F.col("f").alias("l"), "lang"), "left").join(parts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))").cast("long")
    lowest = F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("x")
    scored = cuts.groupBy("key").agg(F.max("a").alias("a"), F.max("lang").alias("lang"), lowest).select("key", "a", "lang", "x.l", "x.r", "x.score")
    within = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), (F.length("key") / 4 - 1).cast("int")), lambda m: F.transform(F.sequence(F.lit(0), (F.length("key") / 4).cast("int") - m), lambda i: F.substring(F.col("key"), i * 4 + 1, m * 4)))))
    longer = counts.where(F.length("key") > 8).select("f", within.alias("key")).groupBy("key").agg(F.max("f").alias("longer"))
    covered = F.col("longer").isNotNull() & (wide("longer") * inside[1] >= wide("a") * inside[0])
    left = scored.join(longer, "key", "left").where(~covered).drop("longer")
    # The best of every language in two rounds, ties included, so that no task ranks a whole language; words are looked up for those only.
    by = [F.desc("score"), F.desc("a")]
    bins = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))
    left = left.withColumn("k", F.rank().over(W.partitionBy("lang", "bin").orderBy(*by))).where(F.col("k") <= k).drop("bin")
    left = left.withColumn("k", F.rank().over(W.partitionBy("lang").orderBy(*by))).where(F.col("k") <= k).drop("k")
    at = F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("key") / 4 - 1).cast("int")), lambda i: F.substring(F.col("key"), i * 4 + 1, F.lit(4)))).alias("at", "one")
    spelled = left.select("key", at).join(vocabulary.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("one"), "word"), "one").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ").alias("phrase"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*by, "phrase")).cast("long")
    out = left.join(spelled, "key").withColumn("rank", rank).where(F.col("rank") <= k).join(totals, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
