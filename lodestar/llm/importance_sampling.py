"""Importance resampling towards a target distribution.

An untrained Split of the tokenizers library cuts the ASCII-lowered text into words with offsets. Windows of one to
``ngram`` consecutive words, each named by the offset of its first word's start and its last word's end, are features; a
feature's bucket is the CRC of its words joined by one space. Bucket histograms of the documents and of the target
texts give each bucket a gain, the log ratio of the smoothed shares. A document's weight is the mean gain of its
features; Gumbel noise from its id turns the highest scores into a draw without replacement.

Texts are cut once: buckets are written as packed numbers, from which both the histogram and the weights are read.
Histograms are summed in every task first, so ``buckets`` rows per task are shuffled. Gains are one array of ``buckets``
numbers. A score is a whole number in a range that doesn't depend on the input (a gain is at most 1000 times the
logarithm of a 64-bit ratio, the noise lies between -3,138 and 22,874), so the counts per score are a small table. It
gives every score the number of documents before it; only documents of drawn scores are then numbered.

Null texts have no features: weight 0. A null id counts as the empty text in the noise and comes first among equal
scores. Repeated rows are features, and candidates, as often as they are given; which of two equal rows comes first
isn't defined. Empty tables give empty histograms, so all gains are 0. Texts are cut whole; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import group_row_number
from .common import Scratch, array_column, map_arrow, texts_of

#: What stands between words: all ASCII characters but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Scores of one step of the coarse table, which has a few hundred rows at most.
STEP = 1024


@lru_cache(maxsize=1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(BETWEEN), "removed")


def words_of(text: str) -> tuple[list[bytes], np.ndarray]:
    """Words of the ASCII-lowered text as UTF-8, and their offsets (start, end) in code points."""
    found = _splitter().pre_tokenize_str(text.encode().lower().decode())
    words = [w.encode() for w, _ in found]
    return words, np.fromiter(chain.from_iterable(o for _, o in found), np.int32, 2 * len(found)).reshape(-1, 2)


def window_crcs(words: list[bytes], ngram: int) -> list[list[int]]:
    """CRC of every window of 1, 2, .. ``ngram`` words joined by one space: a window goes on from the one before."""
    spaced = [b" " + w for w in words]
    levels = [list(map(zlib.crc32, words))]
    for k in range(1, ngram):
        levels.append(list(map(zlib.crc32, spaced[k:], levels[-1])))
    return levels


def features(df: DataFrame, *, key: str = "doc_id", text: str = "text", ngram: int = 2, buckets: int = 10_000, offsets: bool = True) -> DataFrame:
    """Features of every text: ``key``, ``n_words``, ``covered`` (code points in words), ``buckets`` (packed numbers, see
    ``bucket_type``) and, with ``offsets``, ``starts`` and ``ends`` of the windows (code points, end exclusive)."""
    number = bucket_type(buckets)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, covered, packed, starts, ends, sizes = [], [], [], [], [], []
        for one in texts_of(batch):
            words, at = words_of(one)
            crcs = np.fromiter(chain.from_iterable(window_crcs(words, ngram)), np.int64)
            n_words.append(len(words))
            covered.append(int((at[:, 1] - at[:, 0]).sum()))
            packed.append((crcs % buckets).astype(number).tobytes())
            if offsets:
                spans = [(at[: len(at) - k, 0], at[k:, 1]) for k in range(min(ngram, len(at)))]
                starts += [s for s, _ in spans]
                ends += [e for _, e in spans]
                sizes.append(len(crcs))
        columns = {
            key: batch.column(key), "n_words": pa.array(n_words, pa.int64()), "covered": pa.array(covered, pa.int64()),
            "buckets": pa.array(packed, pa.binary()),
        }
        if offsets:
            for name, values in (("starts", starts), ("ends", ends)):
                columns[name] = array_column(np.concatenate([np.zeros(0, np.int32), *values]), sizes, pa.int32())
        return pa.RecordBatch.from_pydict(columns)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, covered bigint, buckets binary" + (", starts array<int>, ends array<int>" if offsets else "")
    return map_arrow(df.select(F.col(key), F.col(text).alias("text")), run, schema)


def bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def histogram(packed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all rows of packed features."""
    number = bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(row, number), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})

    return packed.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _gathered(counts: DataFrame, buckets: int) -> list[int]:
    """The histogram as a list; it has at most ``buckets`` rows."""
    out = [0] * buckets
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * log ratio of the bucket's smoothed shares in target and source)."""
    b, in_source, in_target = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (in_source + b) / ((s + 1) * (in_target + b)))) for s, t in zip(source, target, strict=True)]


def weighted(packed: DataFrame, gain: list[int], key: str = "doc_id") -> DataFrame:
    """``key``, n_words, covered, n_features and weight, the floored mean gain, of packed features."""
    number, shared = bucket_type(len(gain)), packed.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [np.frombuffer(r, number) for r in batch.column("buckets").to_pylist()]
        weight = [int(shared.value[r].sum()) // len(r) if len(r) else 0 for r in rows]
        return pa.RecordBatch.from_pydict({
            **{c: batch.column(c) for c in (key, "n_words", "covered")},
            "n_features": pa.array([len(r) for r in rows], pa.int64()), "weight": pa.array(weight, pa.int64()),
        })

    kind = packed.schema[key].dataType.simpleString()
    return map_arrow(packed.select(key, "n_words", "covered", "buckets"), run, f"`{key}` {kind}, n_words bigint, covered bigint, n_features bigint, weight bigint")


def gumbel(key: str, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from the id and a seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, eligible: Column, percent: int, *, key: str = "doc_id") -> DataFrame:
    """``scored`` (``key``, score and more; read more than once) with ``rank``: 1, 2, 3.. for the floor(percent / 100) of the eligible
    rows that score highest, ties to the smaller id; null for all others."""
    rows = scored.withColumn("_row", F.monotonically_increasing_id()).withColumn("_may", F.coalesce(eligible, F.lit(False)))
    fine = rows.filter("_may").groupBy("score").agg(F.count("*").alias("_n")).withColumn("_step", F.floor(F.col("score") / STEP))
    coarse = fine.groupBy("_step").agg(F.sum("_n").alias("_n")).collect()  # a few hundred rows, whatever the input
    take = sum(r["_n"] for r in coarse) * percent // 100
    before, above = {}, 0
    for r in sorted(coarse, key=lambda r: -r["_step"]):
        before[r["_step"]] = above
        above += r["_n"]
    steps = scored.sparkSession.createDataFrame(sorted(before.items()) or [(0, 0)], "_step bigint, _above bigint")
    higher = Window.partitionBy("_step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    place = fine.withColumn("_within", F.coalesce(F.sum("_n").over(higher), F.lit(0))).join(F.broadcast(steps), "_step")
    place = place.select("score", (F.col("_above") + F.col("_within")).alias("_before")).filter(F.col("_before") < take)
    # one row per drawn score, so its size is bounded like the range of scores
    found = rows.join(F.broadcast(place), "score", "left")
    drawn = F.col("_may") & F.col("_before").isNotNull()
    block = F.struct(F.col(key), F.shiftright("_row", 33))
    ranked = group_row_number(found.filter(drawn), ["score"], block, ["_row"], "_seq")
    rank = F.col("_before") + F.col("_seq")
    columns = list(scored.columns)
    first = ranked.select(*columns, F.when(rank <= take, rank).cast("long").alias("rank"))
    return first.unionByName(found.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_key: str = "item_id", ngram: int = 2,
    buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7,
) -> DataFrame:
    """``key``, n_words, covered, n_features, weight, score and rank (null: not drawn) of every document."""
    scratch = Scratch(docs.sparkSession, "resample")
    cut = dict(text=text, ngram=ngram, buckets=buckets, offsets=False)
    packed = scratch.keep(features(docs, key=key, **cut), "features")
    wanted = features(target, key=target_key, **cut)
    gain = gains(_gathered(histogram(packed, buckets), buckets), _gathered(histogram(wanted, buckets), buckets))
    scored = weighted(packed, gain, key).withColumn("score", F.col("weight") + gumbel(key, seed))
    scored = scratch.keep(scored, "scored")
    scratch.release("scored")
    return draw(scored, F.col("n_words") >= least_words, percent, key=key)
