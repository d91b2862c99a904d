"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt over groups by hash and queries travel to every group in blocks. Inside a group the vectors are
sorted by length and cut into buckets. For a query and a bucket the k-th best score so far, divided by the lengths
of query and bucket, is the cosine that a vector must reach: over 1 the bucket and all shorter ones are passed
over; a high threshold prunes by coordinates (the range that the query's largest coordinates allow a unit vector);
else only vectors that are long enough are taken. What is left is verified by exact products. The k best of each
group meet in one more top-k per query.

Components become floor(scale * x). Vectors that are null or hold null or non-finite components take no part, nor
do pairs of different dimension. A row is its id: rows that share a query's id aren't its candidates; repeated
queries are answered once. Ties go to the smaller id; null ids are no queries and rank last. Products beyond 64
bits are cut to the largest long. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a group, of a block that travels, and of a bucket.
GROUP_VECTORS, BLOCK_VECTORS, BUCKET_VECTORS = 65_536, 512, 2_048
#: Queries that meet a group at once.
GROUP_QUERIES = 16_384
#: Local cosine from which coordinates prune better than lengths, and coordinates looked at.
COORDINATE_COSINE, COORDINATES = 0.7, 4
#: Products below this are exact in float64.
EXACT = 2.0**53
_LONG = 2**63 - 1

BLOCK_SCHEMA = "side int, dim int, grp long, qgrp long, ids binary, vectors binary"
RESULT_SCHEMA = "query_id long, vec_id long, score long"


def quantized(vector: Column, scale: float) -> Column:
    """floor(scale * x) as doubles; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


def _blocks(side: int):
    """Gather rows (dim, grp, id, vec) of one task into blocks; rows come sorted by dim and grp."""

    def run(frames):
        for frame in frames:
            for (dim, grp), part in frame.groupby(["dim", "grp"], sort=False):
                for at in range(0, len(part), BLOCK_VECTORS):
                    rows = part.iloc[at : at + BLOCK_VECTORS]
                    ids = rows["id"].to_numpy().astype("<i8").tobytes()
                    yield pd.DataFrame({"side": [side], "dim": [dim], "grp": [grp], "qgrp": [0], "ids": [ids], "vectors": [np.concatenate([*rows["vec"], np.zeros(0)]).astype("<f8").tobytes()]})

    return run


def _unpack(frame: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(b, "<i8") for b in frame["ids"]])
    return ids, np.concatenate([np.frombuffer(b, "<f8") for b in frame["vectors"]]).reshape(len(ids), dim)


def _merge(best_s, best_i, scores, ids, k):
    """k best of two lists by score, then smaller id."""
    s, i = np.concatenate([best_s, scores]), np.concatenate([best_i, ids])
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]


def search(vec_ids: np.ndarray, vecs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of the k best vectors of this group for each query."""
    lengths, q_lengths = np.linalg.norm(vecs, axis=1), np.linalg.norm(queries, axis=1)
    if len(vecs) and len(queries) and lengths.max() * q_lengths.max() >= EXACT:
        return _search_big(vec_ids, vecs, query_ids, queries, k)
    order = np.lexsort((vec_ids, -lengths))
    vec_ids, vecs, lengths = vec_ids[order], vecs[order], lengths[order]
    best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf)  # k-th best score so far
    for at in range(0, len(vecs), BUCKET_VECTORS):
        ids, block, size = (x[at : at + BUCKET_VECTORS] for x in (vec_ids, vecs, lengths))
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(np.isinf(floor), -1.0, floor / (q_lengths * size[0]))
        local = np.nan_to_num(local, nan=-1.0, posinf=2.0, neginf=-1.0)
        local = np.where(q_lengths * size[0] == 0, np.where(floor > 0, 2.0, -1.0), local)
        by_length = np.flatnonzero(local < COORDINATE_COSINE)
        by_coordinate = np.flatnonzero((local >= COORDINATE_COSINE) & (local <= 1 + 1e-9))
        if len(by_length):
            for part in np.array_split(by_length, -(-len(by_length) // 512)):
                # the longest prefix that any of these queries needs
                need = np.where(floor[part] > 0, floor[part] / np.maximum(q_lengths[part], 1e-300), 0.0).min()
                top = int(np.searchsorted(-size, -need * (1 - 1e-9), side="right")) if need > 0 else len(size)
                scores = queries[part] @ block[:top].T
                for row, q in enumerate(part):
                    hit = np.flatnonzero((scores[row] >= floor[q]) & (ids[:top] != query_ids[q]))
                    _take(best, floor, q, scores[row][hit], ids[hit], k)
        if len(by_coordinate):
            unit = block / np.maximum(size, 1e-300)[:, None]
            for q in by_coordinate:
                direction = queries[q] / q_lengths[q]
                keep = ids != query_ids[q]
                for c in np.argsort(-np.abs(direction))[:COORDINATES]:
                    # a unit vector with cosine >= t has coordinate within d * t -+ sqrt((1 - d^2)(1 - t^2))
                    t, d = min(local[q], 1.0), direction[c]
                    slack = np.sqrt(max(0.0, (1 - d * d) * (1 - t * t))) + 1e-9
                    low, high = (-1.0 if d <= -t else d * t - slack), (1.0 if d >= t else d * t + slack)
                    keep &= (unit[:, c] >= low) & (unit[:, c] <= high)
                hit = np.flatnonzero(keep)
                if len(hit):
                    scores = block[hit] @ queries[q]
                    good = scores >= floor[q]
                    _take(best, floor, q, scores[good], ids[hit][good], k)
    return [(int(q), int(i), int(s)) for q, (ss, ii) in zip(query_ids, best, strict=True) for s, i in zip(ss, ii, strict=True)]


def _take(best, floor, q, scores, ids, k) -> None:
    if len(ids):
        if len(ids) > 8 * k:  # all that can be among the k best: ties with the k-th score stay
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        best[q] = _merge(*best[q], scores, ids, k)
        if len(best[q][0]) == k:
            floor[q] = best[q][0][-1]


def _search_big(vec_ids, vecs, query_ids, queries, k):
    """The same with Python's integers, for components so large that float64 isn't exact."""
    whole = [[int(x) for x in v] for v in vecs]
    out = []
    for q, query in zip(query_ids.tolist(), queries, strict=True):
        mine = [int(x) for x in query]
        scored = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in zip(vec_ids.tolist(), whole, strict=True) if i != q)
        out += [(q, i, max(-_LONG - 1, min(_LONG, -s))) for s, i in scored[:k]]
    return out


def _answer(k: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        vectors, queries = frame[frame["side"] == 0], frame[frame["side"] == 1]
        rows = []
        if len(vectors) and len(queries):
            rows = search(*_unpack(vectors, int(key[0])), *_unpack(queries, int(key[0])), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def top_k(df: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """The ``k`` best rows for each row where ``is_query``: query_id, rank, vec_id, score."""
    rows = df.select(F.col(key).cast("long").alias("raw"), F.coalesce(is_query, F.lit(False)).alias("asks"), quantized(F.col(vector), scale).alias("vec")).filter("vec is not null").select(
        "raw", F.coalesce("raw", F.lit(_LONG)).alias("id"), (F.col("asks") & F.col("raw").isNotNull()).alias("asks"), "vec", F.size("vec").alias("dim"))
    sizes = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).first()
    spark = df.sparkSession
    groups = max(-(-sizes["n"] // GROUP_VECTORS), min(2 * spark.sparkContext.defaultParallelism, -(-sizes["n"] // BUCKET_VECTORS)), 1)
    q_groups = max(1, -(-(sizes["q"] or 0) // GROUP_QUERIES))

    def blocks(side: int, chosen: DataFrame, n: int) -> DataFrame:
        dealt = chosen.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(n))).repartition("dim", "grp").sortWithinPartitions("dim", "grp", "id")
        return dealt.select("dim", "grp", "id", "vec").mapInPandas(_blocks(side), BLOCK_SCHEMA)

    vectors = blocks(0, rows, groups).withColumn("qgrp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_groups - 1).cast("long"))))
    asked = blocks(1, rows.filter("asks").dropDuplicates(["id"]), q_groups).withColumn("qgrp", F.col("grp")).withColumn(
        "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = vectors.unionByName(asked).groupBy("dim", "grp", "qgrp").applyInPandas(_answer(k), RESULT_SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") < _LONG, F.col("vec_id")).alias("vec_id"), "score")
