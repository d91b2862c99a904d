"""Language model: hashed maximum entropy with a class-factored softmax.

P(word | history) = P(class | history) * P(subclass | class, history) * P(word | subclass). The class of a word follows
from its last characters, the subclass from the whole word. The first two factors are log-linear models over hashed
features of the history: the previous word, a skip feature on the word before it, and the n-gram of the two previous
classes; the second crosses them with the class. They start from the exact shares of classes and subclasses. The last
is the smoothed share of the word in its subclass, from exact counts of all training tokens.

Training is distributed: the training texts are dealt over ``UPDATES`` parts by hash. For each part every task sums the
expected and the observed counts of its tokens, a grouped aggregation adds them up by feature, and the difference, scaled
by the expected count, moves the weights. So the model depends on the table, not on its files or partitions (but for
rounding). The table of features grows with the tokens up to ``MOST_FEATURES``; word counts grow with the corpus and stay
in a table. Scoring handles a batch of texts as index arrays. Counts of frequent words travel as one array of at most
``HEAD_WORDS`` entries; all other words of a text are looked up by a join, so no word is left out.

Null texts count as empty: they consist of the end token. Rows are scored one by one, so repeated rows score alike; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, array_column, mix, slices

#: Classes (0 is the end token alone) and, as many, subclasses of a class.
CLASSES = 32
#: Hashed features of a factor, and the training tokens for each of them.
LEAST_FEATURES, MOST_FEATURES, FEATURE_TOKENS = 1 << 12, 1 << 16, 1 << 14
#: Updates of the weights, each from a part of the texts of its own; step, tokens a feature must outweigh, largest step.
UPDATES, RATE, PRIOR, CLIP = 8, 0.5, 8.0, 1.0
#: Training tokens of a task for each feature (tasks are merged up to it), and tokens handled at once.
TASK_TOKENS, CHUNK = 128, 1 << 15
#: Words whose counts travel to the tasks, and distinct words that a task gathers before it passes them on.
HEAD_WORDS, FLUSH_WORDS = 1 << 18, 1_000_000
#: Characters scored at once.
SCORE_CHARS = 1_000_000

END = np.uint64(0x0E4D0E4D0E4D0E4D)


class Tokens:
    """Lower-cased words of every text, each text followed by the end token; hashes, classes, subclasses and histories."""

    def __init__(self, column: pa.Array):
        words = Words(column)
        n = words.counts
        raw, e = words.raw, words.ends
        tail = np.zeros(len(e), np.uint64)
        for k in range(1, 3):  # the last two bytes, as far as the word has them
            tail = tail * np.uint64(256) + np.where(e - k >= words.starts, raw[np.maximum(e - k, 0)], 0).astype(np.uint64)
        kind = (mix(tail + np.uint64(77)) % np.uint64(CLASSES - 1)).astype(np.int64) + 1
        self.sizes = n + 1
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        at = np.arange(len(e)) + np.repeat(np.arange(len(n)), n)
        self.hashes = np.full(self.first[-1], END)
        self.hashes[at] = words.hashes
        self.classes = np.zeros(self.first[-1], np.int64)
        self.classes[at] = kind
        self.subclasses = (mix(self.hashes + np.uint64(5)) % np.uint64(CLASSES)).astype(np.int64)
        self.subclasses[self.classes == 0] = 0
        self.groups = self.classes * CLASSES + self.subclasses
        self.rows = np.repeat(np.arange(len(n)), self.sizes)

    def histories(self) -> list[np.ndarray]:
        """Hashes of each token's previous word, of the word before it and of the classes of both, within its text."""
        size = len(self.hashes)
        place = np.arange(size) - self.first[self.rows]
        before = np.zeros((2, size), np.uint64)
        kinds = np.zeros((2, size), np.uint64)
        for k in (1, 2):
            has = np.flatnonzero(place >= k)
            before[k - 1, has] = self.hashes[has - k]
            kinds[k - 1, has] = self.classes[has - k].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            return [before[0] ^ np.uint64(1), before[1] * np.uint64(3) + np.uint64(2), (kinds[0] * np.uint64(64) + kinds[1]) * np.uint64(0x2545F491) + np.uint64(3)]

    def factors(self, features: int):
        """Both log-linear factors, in chunks: (tokens, feature indices, rows of the shares they start from, targets)."""
        grams = self.histories()
        words = np.flatnonzero(self.classes)
        salt = mix(self.classes.astype(np.uint64) + np.uint64(99))
        for at in range(0, len(self.hashes), CHUNK):
            part = np.arange(at, min(at + CHUNK, len(self.hashes)))
            yield part, [(mix(g[part]) % np.uint64(features)).astype(np.int64) for g in grams], np.zeros(len(part), np.int64), self.classes[part]
        for at in range(0, len(words), CHUNK):
            part = words[at : at + CHUNK]
            index = [(mix(g[part] ^ salt[part]) % np.uint64(features)).astype(np.int64) + features for g in grams]
            yield part, index, self.classes[part], self.subclasses[part]


def _counted(batches):
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        return u, c[at], np.bincount(back, weights=n, minlength=len(u)).astype(np.int64)

    def rows(h, c, n):
        return pa.RecordBatch.from_pydict({"word": pa.array(h.view(np.int64)), "word_group": pa.array(c.astype(np.int32)), "n": pa.array(n)})

    for batch in batches:
        for part in slices(batch):
            t = Tokens(part.column("text"))
            u, at, n = np.unique(t.hashes, return_index=True, return_counts=True)
            held.append((u, t.groups[at], n))
            if sum(len(x[0]) for x in held) > FLUSH_WORDS:
                held = [merged()]
                if len(held[0][0]) > FLUSH_WORDS // 2:
                    yield rows(*held.pop())
    if held:
        yield rows(*merged())


def _probabilities(weights: np.ndarray, shares: np.ndarray, index: list[np.ndarray], context: np.ndarray) -> np.ndarray:
    z = shares[context]
    for column in index:
        z += weights[column]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def add_counts(weights: np.ndarray, shares: np.ndarray, tokens: Tokens, expected: np.ndarray, observed: np.ndarray) -> None:
    """Add the counts of features and outcomes that the model expects in ``tokens``, and those observed."""
    for _, index, context, target in tokens.factors(len(weights) // 2):
        p = _probabilities(weights, shares, index, context)
        for column in index:
            np.add.at(observed.reshape(-1), column * CLASSES + target, 1)
            order = np.argsort((column % (len(weights) // 2)).astype(np.uint16), kind="stable")
            f = column[order]
            starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            expected[f[starts]] += np.add.reduceat(p[order], starts, axis=0)


def moved(weights: np.ndarray, expected: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """The weights after a step against the gradient, scaled by the counts expected."""
    return (weights - np.clip(RATE * (expected - observed) / (expected + PRIOR), -CLIP, CLIP)).astype(np.float32)


def _gradients(model):
    def run(batches):
        weights, shares = model.value
        expected, observed = np.zeros(weights.shape), np.zeros(weights.shape, np.int64)
        for batch in batches:
            for part in slices(batch, chars=SCORE_CHARS):
                add_counts(weights, shares, Tokens(part.column("text")), expected, observed)
        some = np.flatnonzero(expected.any(axis=1))
        columns = {f"e{k}": pa.array(expected[some, k].astype(np.float32)) for k in range(CLASSES)}
        columns |= {f"o{k}": pa.array(observed[some, k]) for k in range(CLASSES)}
        yield pa.RecordBatch.from_pydict({"feature": pa.array(some.astype(np.int32)), **columns})

    return run


def _scored(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for part in slices(batch, chars=SCORE_CHARS):
                t = Tokens(part.column("text"))
                n_rows = part.num_rows
                chosen = -m["group_log"][t.groups]
                for at, index, context, target in t.factors(len(m["weights"]) // 2):
                    p = _probabilities(m["weights"], m["shares"], index, context)[np.arange(len(at)), target]
                    chosen[at] += np.log10(np.maximum(p, 1e-30, dtype=np.float64))
                place = np.minimum(np.searchsorted(m["head"], t.hashes), max(len(m["head"]) - 1, 0))
                known = m["head"][place] == t.hashes if len(m["head"]) else np.zeros(len(t.hashes), bool)
                counts = np.where(known, m["head_n"][place], 0) if len(m["head"]) else np.zeros(len(t.hashes))
                total = lambda x: np.add.reduceat(x, t.first[:-1])  # noqa: B023, E731  every row has its end token
                rest = np.flatnonzero(~known)
                # distinct (row, word) of the others, with their number
                order = rest[np.lexsort((t.hashes[rest], t.rows[rest]))]
                h, r = t.hashes[order], t.rows[order]
                starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(order) else order
                repeats = np.diff(np.concatenate([starts, [len(order)]]))
                sizes = np.bincount(r[starts], minlength=n_rows)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(t.sizes.astype(np.int64)),
                    "head_known": pa.array(total(known.astype(np.int64))), "head_log": pa.array(total(np.log10(counts + 1.0))), "class_score": pa.array(total(chosen)),
                    "rest": array_column(h[starts].view(np.int64), sizes, pa.int64()), "times": array_column(repeats.astype(np.int32), sizes, pa.int32()),
                })

    return run


class LanguageModel:
    """Word counts and weights learned from ``texts`` (doc_id, text)."""

    def __init__(self, texts: DataFrame, scratch: Scratch, updates: int = UPDATES):
        partial = texts.select("text").mapInArrow(_counted, "word bigint, word_group int, n bigint")
        self.counts = scratch.keep(partial.groupBy("word").agg(F.min("word_group").alias("word_group"), F.sum("n").alias("n")), "counts")
        n, v = np.zeros(CLASSES * CLASSES, np.int64), np.zeros(CLASSES * CLASSES, np.int64)
        for group, tokens, words in self.counts.groupBy("word_group").agg(F.sum("n"), F.count("*")).collect():
            n[group], v[group] = tokens, words
        self.tokens, self.words = int(n.sum()), int(v.sum())
        self.group_log = np.log10(n + v + 1.0)
        self.head, self.head_n = self._head()
        # the start: subclasses by their share in a class; the first row, where no words are, holds the shares of classes
        share = n.reshape(CLASSES, CLASSES) + 1.0
        share[0] = n.reshape(CLASSES, CLASSES).sum(axis=1) + 1.0
        self.shares = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
        features = LEAST_FEATURES
        while features < MOST_FEATURES and 2 * features * FEATURE_TOKENS <= self.tokens:
            features *= 2
        self.weights = np.zeros((2 * features, CLASSES), np.float32)
        for k in range(updates if self.tokens else 0):
            self._update(texts, k, updates)

    def _update(self, texts: DataFrame, k: int, updates: int) -> None:
        """Move the weights by the summed gradient of the ``k``-th part of the texts."""
        tasks = max(1, self.tokens // updates // (TASK_TOKENS * len(self.weights) // 2))
        part = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(updates)) == k).select("text").coalesce(tasks)
        shared = texts.sparkSession.sparkContext.broadcast((self.weights, self.shares))
        schema = ", ".join(["feature int", *(f"e{c} float" for c in range(CLASSES)), *(f"o{c} bigint" for c in range(CLASSES))])
        sums = [F.sum(f"{x}{c}").alias(f"{x}{c}") for x in "eo" for c in range(CLASSES)]
        got = part.mapInArrow(_gradients(shared), schema).groupBy("feature").agg(*sums).toArrow()
        rows = got.column("feature").to_numpy()
        expected, observed = (np.stack([got.column(f"{x}{c}").to_numpy() for c in range(CLASSES)], axis=1) for x in "eo")
        self.weights[rows] = moved(self.weights[rows], expected, observed)

    def _head(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the words that occur at least ``2 ** k`` times, for the smallest k that leaves few enough."""
        steps = {r["k"]: r["v"] for r in self.counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("v")).collect()}
        least = 64
        while least > 0 and sum(v for k, v in steps.items() if k >= least - 1) <= HEAD_WORDS:
            least -= 1
        rows = self.counts.filter(F.floor(F.log2("n")) >= least).select("word", "n").toPandas()
        words, n = rows["word"].to_numpy(dtype=np.int64).view(np.uint64), rows["n"].to_numpy(dtype=np.int64)
        order = np.argsort(words)
        return words[order], n[order]

    def score(self, docs: DataFrame, scratch: Scratch) -> DataFrame:
        """Scores of ``docs`` (doc_id, held_out, text)."""
        shared = docs.sparkSession.sparkContext.broadcast({"weights": self.weights, "shares": self.shares, "group_log": self.group_log, "head": self.head, "head_n": self.head_n})
        kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, head_known bigint, head_log double, class_score double, rest array<bigint>, times array<int>"
        part = scratch.keep(docs.mapInArrow(_scored(shared), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
        rest = part.select("row", F.explode(F.arrays_zip("rest", "times")).alias("t")).select("row", F.col("t.rest").alias("word"), F.col("t.times").alias("times"))
        found = rest.join(self.counts.select("word", "n"), "word").groupBy("row").agg(F.sum("times").alias("rest_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rest_log"))
        logs = F.col("head_log") + F.coalesce("rest_log", F.lit(0.0))
        return part.drop("rest", "times").join(found, "row", "left").select(
            "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
            F.lit(self.tokens).cast("long").alias("train_tokens"),
            (logs - F.col("n_tokens") * F.lit(float(np.log10(self.tokens + self.words + 1)))).alias("base_score"),
            (logs + F.col("class_score")).alias("score"),
        )


def score_corpus(docs: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows that aren't held out and score all: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (unigram) and score (this model), both log10 of the text's probability."""
    scratch = Scratch(docs.sparkSession, "maxent")
    rows = docs.select(F.col(key).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return LanguageModel(rows.filter("not held_out"), scratch).score(rows, scratch)
