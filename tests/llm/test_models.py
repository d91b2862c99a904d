import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import maxent_lm, quality_classifier, queries
from lodestar.llm.common import Scratch, fold

from .hard import TEXTS, by_id, documents

SMALL = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_quality_on_held_out_rows(spark):
    scored = queries.op7_quality_classifier(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    bad, good = scored[scored["quality"] == 0], scored[scored["quality"] == 1]
    assert ((scored["score"] >= 0) & (scored["score"] <= 1)).all()
    assert (good["predicted"] == 1).mean() > 0.97 and (bad["predicted"] == 0).mean() > 0.8


def test_classifier_on_hard_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in TEXTS if i], "doc_id bigint, quality int")
    rows = by_id(quality_classifier.classify(docs, labels, F.lit(True)))
    assert {i: len(r) for i, r in rows.items()} == Counter(i for i, _ in TEXTS)
    assert rows[6][0]["score"] == rows[6][1]["score"]
    assert quality_classifier.keep_good(docs, labels, F.lit(True)).columns == docs.columns
    constant = quality_classifier.classify(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in constant.collect()} == {0.5}
    assert quality_classifier.classify(docs.limit(0), labels, F.lit(True)).count() == 0


def test_fitting_rows_are_bounded_and_do_not_follow_the_layout(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier, "Network", lambda x, y: seen.append(x) or quality_classifier.Constant(y))
    packed = np.arange(quality_classifier.WIDTH, dtype=np.float32)
    rows = spark.createDataFrame([(i, (packed + i).tobytes()) for i in range(3_000) for _ in range(1 + (i < 100))], "doc_id bigint, features binary")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4_000)], "doc_id bigint, quality int")
    for parts, limit in ((1, 500), (40, 500), (8, 5_000)):
        quality_classifier.fit(rows.repartition(parts), labels, F.lit(True), limit=limit)
    assert [len(x) for x in seen] == [500, 500, 3_000] and np.array_equal(seen[0], seen[1])


def test_pooling_equals_a_loop():
    vectors = np.random.default_rng(1).normal(size=(quality_classifier.BUCKETS, quality_classifier.DIM)).astype(np.float32)
    texts = pa.array(["Ab, cd  12", "", None, "x"])
    got = quality_classifier.pooled(vectors, texts)
    bucket, words = quality_classifier._buckets(texts)
    mine = vectors[bucket[words.first[0] : words.first[1]]]
    assert len(mine) == 4
    like = [np.mean([mine[i] @ mine[i + k] for i in range(4 - k)]) for k in (1, 2)]
    assert np.allclose(got[0], [*mine.mean(0), *mine.std(0), *like, np.log(5)], atol=1e-4) and not got[1].any() and not got[2].any()


def brute_unigram(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    tokens = [(i, [*word.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for (_, ws), h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, h, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for (i, ws), h in zip(tokens, held, strict=True)]


def test_base_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "HEAD_WORDS", 500)  # so that many words go through the join
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(i, t) for i, t in TEXTS if i is None or i < 3]
    got = by_id(maxent_lm.score_corpus(documents(spark, rows), fold("doc_id", 7) == 2))
    for i, held, n, known, train, base in brute_unigram(rows):
        assert any((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train) and math.isclose(r["base_score"], base, rel_tol=1e-9) for r in got[i])
    assert sum(map(len, got.values())) == len(rows)


def test_model_beats_unigrams_on_held_out_text(spark):
    got = queries.op6_maxent_lm(spark, SMALL).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.05 * got[2]


def test_scores_do_not_follow_the_layout(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "TASK_TOKENS", 1)  # so that tasks are not merged
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    runs = [by_id(maxent_lm.score_corpus(docs.repartition(n), fold("doc_id", 7) == 2)) for n in (1, 40, 200)]
    for other in runs[1:]:
        assert all(math.isclose(rows[0]["score"], other[i][0]["score"], rel_tol=1e-6) for i, rows in runs[0].items())


def test_updates_equal_a_loop_and_lower_the_loss():
    tokens = maxent_lm.Tokens(pa.array(["The cat sat on the mat " * 40, "", "un deux trois " * 30]))
    assert tokens.sizes.tolist() == [241, 1, 91] and tokens.groups[tokens.first[1:] - 1].tolist() == [0, 0, 0]
    rng = np.random.default_rng(0)
    size, classes = 64, maxent_lm.CLASSES
    weights, shares = rng.normal(size=(2 * size, classes)).astype(np.float32), rng.normal(size=(classes, classes)).astype(np.float32)

    def probabilities(index, context):
        z = np.exp(shares[context].astype(float) + sum(weights[i].astype(float) for i in index))
        return z / z.sum()

    expected, observed = np.zeros(weights.shape), np.zeros(weights.shape)
    for _, index, context, target in tokens.factors(size):
        for i in range(len(target)):
            features = [int(column[i]) for column in index]
            for f in features:
                expected[f] += probabilities(features, context[i])
                observed[f, target[i]] += 1
    got = np.zeros(weights.shape), np.zeros(weights.shape, np.int64)
    maxent_lm.add_counts(weights, shares, tokens, *got)
    assert np.allclose(got[0], expected, rtol=1e-4, atol=1e-3) and np.array_equal(got[1], observed)
    assert observed.sum() == 3 * (333 + 330) and math.isclose(expected.sum(), observed.sum(), rel_tol=1e-6)

    def loss():
        return -sum(np.log(maxent_lm._probabilities(weights, shares, i, c)[np.arange(len(t)), t]).sum() for _, i, c, t in tokens.factors(size))

    before = loss()
    for _ in range(5):
        counts = np.zeros(weights.shape), np.zeros(weights.shape, np.int64)
        maxent_lm.add_counts(weights, shares, tokens, *counts)
        weights = maxent_lm.moved(weights, *counts)
    assert loss() < 0.7 * before


def test_shares_sum_to_one(spark):
    """All words of a group and one unknown word share its mass; so do the outcomes of both factors."""
    train = spark.createDataFrame(list(enumerate(["a b a c", "b a", "ab ba b"])), "doc_id bigint, text string")
    model = maxent_lm.LanguageModel(train, Scratch(spark, "test"))
    mass = Counter()
    for r in model.counts.collect():
        mass[r["word_group"]] += r["n"] + 1
    assert model.tokens == 12 and all(math.isclose(10 ** model.group_log[g], total + 1, rel_tol=1e-9) for g, total in mass.items())
    tokens = maxent_lm.Tokens(pa.array(["a b", "ba unknown c"]))
    for _, index, context, _ in tokens.factors(len(model.weights) // 2):
        assert np.allclose(maxent_lm._probabilities(model.weights, model.shares, index, context).sum(axis=1), 1, atol=1e-5)


def test_language_model_on_empty_tables(spark):
    docs = documents(spark)
    assert maxent_lm.score_corpus(docs.limit(0), F.lit(False)).count() == 0
    nothing = maxent_lm.score_corpus(docs, F.lit(True)).collect()
    assert len(nothing) == len(TEXTS) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in nothing)
