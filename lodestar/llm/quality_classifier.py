"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Words (runs of letters, digits or marks, case kept) fall into a fixed number of hash buckets. Each bucket has a
sparse ternary index vector; its word vector is the sum of the index vectors around all its occurrences, counted
over all documents and summed by a grouped aggregation. A document is the mean and the spread of its words' unit
vectors, the mean cosine of words one and two places apart, and the logarithm of its length. A two-layer network in numpy is fitted on a bounded sample of the labelled
rows (``MAX_FIT_ROWS``, chosen by hash); a temperature fitted on rows held back from it calibrates the scores.

Null texts count as empty and get a score like any other. Null labels are ignored; several labels of one id count
once, as the lowest. With labels of one class or none all scores are the smoothed share of label 1. Repeated rows
score alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, slices

#: Hash buckets of words, dimensions, entries of an index vector that aren't zero, words to each side.
BUCKETS, DIM, NONZERO, REACH = 1 << 13, 32, 4, 2
#: Labelled rows that the network is fitted on at most, and the share of them that calibrates.
MAX_FIT_ROWS, CALIBRATION = 20_000, 0.2
#: Network and training.
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 128, 0.01, 1e-4
#: Characters pooled at once.
POOL_CHARS = 1_000_000
#: Entries of a document's pooled vector.
WIDTH = 2 * DIM + REACH + 1


@lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every bucket's index vector."""
    rng = np.random.default_rng(20_011)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def _buckets(column: pa.Array) -> tuple[np.ndarray, Words]:
    words = Words(column, lower=False, runs=True)
    return (words.hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), words


def _context(batches):
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    seen = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch):
            bucket, words = _buckets(part.column("text"))
            row = words.rows()
            seen += np.bincount(bucket, minlength=BUCKETS)
            for reach in range(1, REACH + 1):
                near = row[reach:] == row[:-reach]
                left, right = bucket[:-reach][near], bucket[reach:][near]
                for mine, other in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(mine * DIM + places[other, k], weights=signs[other, k], minlength=BUCKETS * DIM)
    some = np.flatnonzero(seen)
    vectors = total.reshape(BUCKETS, DIM)[some].astype(np.int64)
    columns = {"bucket": pa.array(some, pa.int32()), **{f"c{i}": pa.array(vectors[:, i], pa.int64()) for i in range(DIM)}}
    yield pa.RecordBatch.from_pydict(columns)


def word_vectors(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """Unit word vectors of all buckets (a fixed number of rows, whatever the corpus)."""
    schema = "bucket int, " + ", ".join(f"c{i} bigint" for i in range(DIM))
    partial = docs.select(F.col(text).alias("text")).mapInArrow(_context, schema)
    summed = partial.groupBy("bucket").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(DIM)))
    out = np.zeros((BUCKETS, DIM), np.float32)
    for r in summed.collect():
        out[r["bucket"]] = r[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(vectors: np.ndarray, column: pa.Array) -> np.ndarray:
    """Mean, spread, likeness of neighbours and log length of every text."""
    bucket, words = _buckets(column)
    n = words.counts
    out = np.zeros((len(n), WIDTH), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        seen = vectors[bucket]
        at, size = words.first[:-1][some], n[some, None]
        mean = np.add.reduceat(seen, at, axis=0) / size
        out[some, :DIM] = mean
        out[some, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(seen * seen, at, axis=0) / size - mean * mean, 0))
        row = words.rows()
        for reach in range(1, REACH + 1):
            near = np.flatnonzero(row[reach:] == row[:-reach])
            like = np.einsum("ij,ij->i", seen[near], seen[near + reach])
            out[:, 2 * DIM + reach - 1] = np.bincount(row[near], weights=like, minlength=len(n)) / np.maximum(n - reach, 1)
    out[:, -1] = np.log1p(n)
    return out


def features(docs: DataFrame, vectors: np.ndarray, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the packed pooled vector of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            for part in slices(batch, chars=POOL_CHARS):
                rows = pooled(shared.value, part.column("text"))
                yield pa.RecordBatch.from_pydict({key: part.column(key), "features": pa.array([r.tobytes() for r in rows], pa.binary())})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, features binary")


class Network:
    """Two layers, fitted by Adam on the logistic loss, with a temperature on the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        held = rng.random(len(x)) < CALIBRATION
        if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
            held[:] = False
        fit, target = x[~held], y[~held]
        self.mean, self.scale = fit.mean(0), fit.std(0) + 1e-6
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        self._fit((fit - self.mean) / self.scale, target, rng)
        if held.any():
            self._calibrate(x[held], y[held])

    def _fit(self, x, y, rng) -> None:
        first, second, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                a, b, c, d = self.w
                hidden = np.tanh(x[rows] @ a + b)
                error = (_sigmoid(hidden @ c + d) - y[rows]) / len(rows)
                back = np.outer(error, c) * (1 - hidden**2)
                grads = [x[rows].T @ back + DECAY * a, back.sum(0), hidden.T @ error + DECAY * c, np.array([error.sum()])]
                step += 1
                for w, g, m, v in zip(self.w, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _calibrate(self, x, y) -> None:
        z, sign = self.logits(x), 2 * y - 1
        tries = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        losses = [np.logaddexp(0, -sign * z / t).mean() for t in tries]
        self.temperature = float(tries[int(np.argmin(losses))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Constant:
    """What is known of quality without labels of both classes."""

    def __init__(self, y: np.ndarray):
        self.share = float((y.sum() + 1) / (len(y) + 2))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float32).reshape(len(packed), WIDTH).astype(np.float64)


def _draw(key: str) -> Column:
    """A number of the key's hash for drawing the fitting rows, in steps of a sixteenth of a power of two."""
    return F.floor(F.log2(F.shiftrightunsigned(F.xxhash64(key), 1).cast("double") + 1) * 16)


def fit(rows: DataFrame, labels: DataFrame, train: Column, *, key: str = "doc_id", label: str = "quality", limit: int = MAX_FIT_ROWS):
    """Fit on the labelled rows of ``rows`` (key, features) for which ``train`` holds, ``limit`` of them at most.

    The counts of the steps of the draw (about a thousand) tell which ones hold ``limit`` rows; only their rows are joined with
    their vectors and sent, whatever the number of tasks. Repeated rows are learned from once.
    """
    marks = labels.filter(train).select(F.col(key), F.col(label).alias("label")).filter("label is not null").groupBy(key).agg(F.min("label").alias("label"))
    steps = rows.select(key).distinct().join(marks.select(key), key, "left_semi").groupBy(_draw(key).alias("step")).count().collect()
    total, top = 0, -1
    for step, count in sorted(tuple(r) for r in steps):
        if total >= limit:
            break
        total, top = total + count, step
    near = _draw(key) <= top
    some = rows.filter(near).join(marks.filter(near), key).select("features", (F.col("label") > 0).cast("int").alias("y"), F.xxhash64(key).alias("draw")).distinct()
    got = some.orderBy(F.shiftrightunsigned("draw", 1), "draw", "features").limit(limit).collect()
    y = np.array([r["y"] for r in got], np.float64)
    return Network(_matrix([bytes(r["features"]) for r in got]), y) if len(set(y)) == 2 else Constant(y)


def score(rows: DataFrame, model, *, key: str = "doc_id") -> DataFrame:
    """``key``, ``score`` and ``predicted`` for every row of ``rows`` (key, features)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = model.score(_matrix(batch.column("features").to_pylist()))
                yield pa.RecordBatch.from_pydict({key: batch.column(key), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "features").mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, train: Column, *, key: str = "doc_id") -> DataFrame:
    """Score every document after learning from the labels for which ``train`` holds."""
    scratch = Scratch(docs.sparkSession, "classifier")
    rows = scratch.keep(features(docs, word_vectors(docs), key=key), "features")
    return score(rows, fit(rows, labels, train, key=key), key=key)


def keep_good(docs: DataFrame, labels: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted 1, with all their columns. Rows are scored in place, so texts aren't shuffled."""
    scratch = Scratch(docs.sparkSession, "classifier")
    vectors = word_vectors(docs, text=text)
    model = fit(scratch.keep(features(docs, vectors, key=key, text=text), "features"), labels, train, key=key)
    scratch.release()
    shared, at = docs.sparkSession.sparkContext.broadcast(vectors), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            start = 0
            for part in slices(texts, chars=POOL_CHARS):
                rows = pooled(shared.value, part.column("text")).astype(np.float64)
                yield batch.slice(start, part.num_rows).filter(pa.array(model.score(rows) >= 0.5))
                start += part.num_rows

    return docs.mapInArrow(run, docs.schema)
