import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import topk


def brute(rows, every=5, k=5):
    good = {i: [int(np.floor(256 * x)) for x in np.array(v, np.float64)] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(good):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


def answer(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score double")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("bucket", [8, 64])
def test_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET_VECTORS", bucket)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] * rng.uniform(0.05, 4) + rng.normal(size=8) * 0.1 * (i % 3)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[i - 400][1]) for i in range(400, 440)] + [(440, None), (441, [float("nan")] * 8), (442, [1.0, None] + [0.0] * 6), (443, [float("inf")] * 8), (445, [0.0] * 8), (450, [1.0, 2.0]), (451, [2.0, 1.0])]
    # search() runs in other processes, so the bucket size is also tried here
    assert answer(spark, rows) == brute(rows)
    good = [(i, [np.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    ids, vecs = np.array([i for i, _ in good]), np.array([v for _, v in good])
    asks = ids % 5 == 0
    got = topk.search(ids, vecs, ids[asks], vecs[asks], 5)
    ranked = []
    for q in ids[asks].tolist():
        ranked += [(q, r, i, s) for r, (_, i, s) in enumerate((x for x in got if x[0] == q), 1)]
    assert sorted(ranked) == [x for x in brute(rows) if x[0] not in (450,)]


def test_large_components_and_few_rows(spark):
    rows = [(0, [3e9, -1.0]), (1, [2e9, 5.0]), (5, [1.0, 1.0])]
    assert answer(spark, rows) == [(q, r, i, min(s, 2**63 - 1)) for q, r, i, s in brute(rows)]
    assert answer(spark, [(0, [1.0])]) == [] and answer(spark, []) == []
