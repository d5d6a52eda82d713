"""Topics of documents: clusters of hashed term vectors, the same whatever the table's partitioning.

A document is a signed-hash vector of its distinct words, scaled to a fixed length in whole numbers and centred on the mean of its
language, lest clusters be languages. Lloyd's rounds are passes over all documents' vectors; tasks send sums of whole numbers, of a
fixed size, so no order of summation shows in the result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import _batches, _counted_words

#: Topics; dimensions of the vectors; their length; rounds at most.
TOPICS, DIMENSIONS, LENGTH, ROUNDS = 8, 128, 1000.0, 8
NONE = "none"


def term_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of int16 for each text; zeros without a word."""
    out = np.zeros(len(texts) * dimensions, dtype=np.int64)
    _, u, _, _, doc, word, _ = _counted_words(texts)
    h = u[word].astype(np.uint64)
    np.add.at(out, doc * dimensions + (h % np.uint64(dimensions)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1))
    out = out.reshape(len(texts), dimensions)
    norm = np.sqrt((out * out).sum(axis=1))
    return np.rint(out * (LENGTH / np.maximum(norm, 1e-300))[:, None] * (norm > 0)[:, None]).astype(np.int16)


def packed(vectors: np.ndarray) -> pa.Array:
    d = vectors.shape[1] * 2
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(np.arange(0, (len(vectors) + 1) * d, d, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(vectors, dtype="<i2"))])


def unpacked(column: pa.Array, dimensions: int) -> np.ndarray:
    data = b"".join(x.as_buffer().to_pybytes() for x in column)
    return np.frombuffer(data, dtype="<i2").reshape(len(column), dimensions)


class TopicModel:
    """means: of each language's vectors; centroids: topic x dimension."""

    def __init__(self, means: dict[str | None, np.ndarray], centroids: np.ndarray):
        self.means, self.centroids = means, centroids

    def centred(self, vectors: np.ndarray, langs: list) -> np.ndarray:
        names = list(self.means)
        at = {k: i for i, k in enumerate(names)}
        means = np.array([self.means[k] for k in names] + [np.zeros(vectors.shape[1], dtype=np.int64)])
        return vectors.astype(np.int64) - means[[at.get(x, len(names)) for x in langs]]

    def assign(self, vectors: np.ndarray, langs: list) -> np.ndarray:
        """The topic of the nearest centroid by direction, the first of several; -1 for texts without a word."""
        if not len(vectors) or not len(self.centroids):
            return np.full(len(vectors), -1)
        norm = np.maximum(np.linalg.norm(self.centroids, axis=1), 1e-9)
        near = np.round(self.centred(vectors, langs).astype(np.float64) @ (self.centroids / norm[:, None]).T, 6)
        return np.where(vectors.any(axis=1), np.argmax(near, axis=1), -1)

    def names(self, vectors: np.ndarray, langs: list) -> list[str]:
        return [f"t{k}" if k >= 0 else NONE for k in self.assign(vectors, langs).tolist()]


def _summed(rows: DataFrame, sums_of, size: int) -> np.ndarray:
    """Sum over tasks of an array of `size` whole numbers that sums_of(batches) gives."""

    def own(batches):
        yield pa.RecordBatch.from_pydict({"sums": pa.array([sums_of(batches).astype("<i8").tobytes()], pa.binary())})

    def merged(batches):
        total = np.zeros(size, dtype="<i8")
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), dtype="<i8")
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = min(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    got = rows.mapInArrow(own, "sums binary").repartition(parts).mapInArrow(merged, "sums binary").collect()
    return sum((np.frombuffer(bytes(r[0]), dtype="<i8") for r in got), np.zeros(size, dtype=np.int64))


def fit(rows: DataFrame, topics: int = TOPICS, dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> TopicModel:
    """The model of rows(doc_id, lang, vector): all of them. Begins with the documents of the smallest hashes of ids; ends when no
    centroid moves. The driver holds a vector a language and a topic."""
    langs = [r[0] for r in rows.select("lang").distinct().collect()]
    langs = sorted(langs, key=lambda x: (x is not None, x or ""))
    at = {k: i for i, k in enumerate(langs)}

    def of_languages(batches):
        out = np.zeros((len(langs), dimensions + 1), dtype=np.int64)
        for b in batches:
            v, of = unpacked(b.column(1), dimensions), np.array([at[x] for x in b.column(0).to_pylist()], dtype=np.int64)
            some = v.any(axis=1)
            np.add.at(out, of[some], np.concatenate([v[some].astype(np.int64), np.ones((int(some.sum()), 1), dtype=np.int64)], axis=1))
        return out.ravel()

    sums = _summed(rows.select("lang", "vector"), of_languages, len(langs) * (dimensions + 1)).reshape(-1, dimensions + 1)
    means = {k: np.rint(sums[i, :-1] / max(1, sums[i, -1])).astype(np.int64) for k, i in at.items()}
    zero = bytes(2 * dimensions)
    first = rows.where(F.col("vector") != F.lit(zero)).select(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(11)).alias("h"), "lang", "vector").distinct().orderBy("h", "lang", "vector").limit(topics).collect()
    model = TopicModel(means, np.zeros((0, dimensions)))
    if not first:
        return model
    model.centroids = np.array([model.centred(np.frombuffer(bytes(r["vector"]), dtype="<i2")[None], [r["lang"]])[0] for r in first], dtype=np.float64)
    k = len(model.centroids)
    for _ in range(rounds):

        def of_topics(batches, model=model):
            out = np.zeros((k, dimensions + 1), dtype=np.int64)
            for b in batches:
                names, v = b.column(0).to_pylist(), unpacked(b.column(1), dimensions)
                topic = model.assign(v, names)
                some = topic >= 0
                np.add.at(out, topic[some], np.concatenate([model.centred(v, names)[some], np.ones((int(some.sum()), 1), dtype=np.int64)], axis=1))
            return out.ravel()

        sums = _summed(rows.select("lang", "vector"), of_topics, k * (dimensions + 1)).reshape(k, -1)
        moved = np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), model.centroids)
        if (moved == model.centroids).all():
            break
        model = TopicModel(means, moved)
    return model


def with_topics(rows: DataFrame, text_col: str, lang_col: str, model: TopicModel, name: str) -> DataFrame:
    """rows with a column of that name: each row's topic."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    text_at, lang_at = rows.columns.index(text_col), rows.columns.index(lang_col)

    def assign(batches):
        for b in batches:
            for i, texts in _batches(b.column(text_at).cast(pa.string())):
                part = b.slice(i, len(texts))
                langs = part.column(lang_at).cast(pa.string()).to_pylist()
                yield part.append_column(name, pa.array(sent.value.names(term_vectors(texts, sent.value.centroids.shape[1]), langs), pa.string()))

    from pyspark.sql import types as T

    return rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))
