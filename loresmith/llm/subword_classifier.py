"""Quality classifier: hashed word and character n-gram vectors, averaged, with a softmax; trained by stochastic gradient descent in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import U, frugal, mix, release_memory, slices, string_bytes, words

#: Rows of the vector table; n-grams of these many words and of these many characters share it.
BUCKETS, DIM = 1 << 18, 8
WORD_GRAMS, GRAMS = (1, 2, 3), (1, 3, 4)
#: Labelled rows used at most for training: those with the least hash of their id.
TRAIN_ROWS = 4000
EPOCHS, RATE = 12, 8.0


@dataclass
class SubwordModel:
    """Vectors of the buckets, the output layer and its bias, as trained."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """What each bucket adds to the margin of class 1: averaging is linear, so a document's margin is the mean of these."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float64)


def characters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each UTF-8 character (its bytes, low to high) and the row bounds in characters; a byte that begins none is joined to the one before it in its row."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(bounds), np.int64)
    begins = (data & 0xC0) != 0x80
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    at = np.flatnonzero(begins)
    size = np.diff(np.r_[at, len(data)])
    code = data[at].astype(U)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] |= data[at[more] + k].astype(U) << U(8 * k)
    return code, np.searchsorted(at, bounds)


def features(data: np.ndarray, bounds: np.ndarray):
    """Arrays of buckets with the bounds of rows inside them: each size of word n-gram, then each of character n-gram; none crosses rows."""
    row, _, _, value = words(data, bounds, lower=True)
    for n in WORD_GRAMS:
        count = max(0, len(value) - n + 1)
        code = value[:count]
        for k in range(1, n):
            code = mix(code * U(0x100000001B3) + value[k : k + count])
        inside = np.flatnonzero(row[:count] == row[n - 1 : n - 1 + count])
        at = np.searchsorted(row[inside], np.arange(len(bounds)))
        yield (code[inside] & U(BUCKETS - 1)).astype(np.int64), np.c_[at[:-1], at[1:]]
    wide, bounds = characters(data, bounds)
    wide = wide + U(1)
    for n in GRAMS:
        count = max(0, len(wide) - n + 1)
        code = np.zeros(count, U)
        for k in range(n):
            code = code * U(0x100000001B3) + wide[k : k + count]
        bucket = (mix(code + U(n << 56)) & U(BUCKETS - 1)).astype(np.int64)
        first = np.minimum(bounds[:-1], count)
        yield bucket, np.c_[first, np.maximum(np.minimum(bounds[1:] - n + 1, count), first)]


def margin(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean of the table over all features of each row; a row without any has 0."""
    total, count = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    for bucket, at in features(data, bounds):
        run = np.r_[0.0, np.cumsum(table[bucket])]
        a, b = at.T
        total += run[b] - run[a]
        count += b - a
    return total / np.maximum(count, 1)


def train(texts: list[str], labels: list[int], seed: int = 13, epochs: int = EPOCHS, rate: float = RATE) -> SubwordModel:
    """Plain SGD, one document at a time in a seeded order, with a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    output, bias = rng.normal(0, 1 / DIM**0.5, (2, DIM)), np.zeros(2)
    share = float(np.mean(labels)) if labels else 0.5
    if not labels or len(set(labels)) < 2:
        return SubwordModel(vectors, np.zeros((2, DIM)), np.array([0.0, np.log((share + 1e-3) / (1 - share + 1e-3))]))
    rows = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        found = np.concatenate([b for b, _ in features(data, np.array([0, len(data)]))])
        bucket, times = np.unique(found, return_counts=True)
        rows.append((bucket.astype(np.int32), (times / max(1, times.sum())).astype(np.float32)))
    bias[:] = [np.log(1 - share), np.log(share)]
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            pace = rate * (1 - step / steps)
            step += 1
            bucket, part = rows[k]
            own = vectors[bucket]
            to_vectors, to_output, to_bias = gradients(own, part, output, bias, labels[k])
            output -= 0.05 * pace * to_output
            bias -= 0.001 * pace * to_bias
            vectors[bucket] = own - pace * to_vectors
    return SubwordModel(vectors, output, bias)


def gradients(own: np.ndarray, part: np.ndarray, output: np.ndarray, bias: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one document's softmax loss: by its buckets' vectors (``part`` is each one's share of the features), the output layer and the bias."""
    hidden = part @ own
    odds = output @ hidden + bias
    error = np.exp(odds - odds.max())
    error /= error.sum()
    error[label] -= 1
    return part[:, None] * (error @ output), np.outer(error, hidden), error


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> SubwordModel:
    """Train on labelled documents; only the text is an input.

    At most ``train_rows`` labelled rows are used, those whose id has the least
    hash, so the sample is the same in every run.  Rows with a null label, id or
    text are left out; where ids repeat, at most ``train_rows`` of the joined
    rows are used, in the same order.  Without two classes the model gives the
    share of class 1.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__y IN (0, 1)")
    picked = known.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id", "__y").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).where("__t IS NOT NULL")
    joined = texts.join(F.broadcast(picked), "__id").select("__id", "__t", "__y")
    rows = joined.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id", "__y", F.md5(F.col("__t").cast("binary"))).limit(train_rows).collect()
    rows.sort(key=lambda r: (r["__id"], r["__y"], r["__t"]))
    labels_of, texts_of = [r["__y"] for r in rows], [r["__t"] for r in rows]
    del rows
    model = train(texts_of, labels_of)
    release_memory()
    return model


def _scores(column: pa.Array, table: np.ndarray, shift: float) -> np.ndarray:
    data, bounds = string_bytes(column)
    out = np.empty(len(column))
    for i, j in slices(bounds):
        out[i:j] = margin(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], table)
    return 1 / (1 + np.exp(-(out + shift)))


def _shared(docs: DataFrame, model: SubwordModel):
    """The table of margins (its size is fixed by BUCKETS) and the bias."""
    return docs.sparkSession.sparkContext.broadcast((model.margins().astype(np.float32), float(model.bias[1] - model.bias[0])))


def score(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``score``, the probability of class 1 of the whole text; null text counts as empty and gets the bias alone."""
    shared = _shared(docs, model)

    @frugal
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), *shared.value))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: SubwordModel, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, in all their columns; nothing is joined or shuffled.

    Null text counts as empty and has the bias alone; ids play no part, so null
    and repeated ones need no rule; an empty table stays empty.
    """
    shared, at = _shared(docs, model), docs.columns.index(text_col)

    @frugal
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), *shared.value) >= least))

    return docs.mapInArrow(run, docs.schema)
