"""Entity resolution: incoming titles against the catalogue.

Equal canonical titles meet in an equi-join. The others are compared inside tasks: the incoming
titles are spread over the cluster, the catalogue travels as size-checked blocks of arrays, and a
task keeps only the best candidate per title. Pairs are never written as rows, so a word or
phrase shared by very many titles costs arithmetic, not shuffle. Upper bounds (shared tokens,
shared letters) leave few pairs for the sequence ratio; they never exclude a possible winner.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import titles as tt
from ..session import materialize, spread

BLOCK_TITLES = 50_000
BEST_SCHEMA = "canonical string, best_id bigint, best_title string, score double, shared int, containment double, anchor string"
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def sequence_ratio(left: str, right: str) -> float:
    return SequenceMatcher(None, left, right).ratio()


def common_subsequence(left: str, masks: dict[str, int], right: str) -> int:
    """Length of the longest common subsequence; ``masks`` are the letter positions of ``left``.

    The blocks of the sequence ratio are a common subsequence, so this bounds it from above.
    """
    full = (1 << len(left)) - 1
    row = full
    for c in right:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


def _letter_counts(value: str) -> np.ndarray:
    return np.array([value.count(c) for c in _LETTERS], np.int16)


def _codes(values: list[str]) -> np.ndarray:
    """Letters of the values as numbers, one row each; other characters count as one letter, the end as another."""
    of = {c: i for i, c in enumerate(_LETTERS)}
    out = np.full((len(values), max((len(v) for v in values), default=0)), len(_LETTERS) + 1, np.uint8)
    for i, v in enumerate(values):
        out[i, : len(v)] = [of.get(c, len(_LETTERS)) for c in v]
    return out


def common_subsequences(left: str, codes: np.ndarray) -> np.ndarray:
    """``common_subsequence`` of ``left``, at most 64 letters, with many values at once."""
    masks = np.zeros(len(_LETTERS) + 2, np.uint64)
    for at, code in enumerate(_codes([left])[0]):
        masks[code] |= np.uint64(1 << at)
    full = np.uint64((1 << len(left)) - 1)
    row = np.full(len(codes), full)
    for column in codes.T:
        hit = row & masks[column]
        row = ((row + hit) | (row - hit)) & full
    return len(left) - np.bitwise_count(row).astype(np.int64)


class TitleBlock:
    """Canonical catalogue titles of one block, in catalogue order."""

    def __init__(self, ids, shown, canonical):
        self.ids, self.shown, self.canonical = list(ids), list(shown), list(canonical)
        self.size = np.array([len(c) for c in self.canonical], np.int64)
        self.letters = np.array([_letter_counts(c) for c in self.canonical], np.int16).reshape(-1, len(_LETTERS))
        self.codes = _codes(self.canonical)
        postings: dict[str, list[int]] = {}
        words = [set(c.split()) for c in self.canonical]
        for i, tokens in enumerate(words):
            for token in tokens:
                postings.setdefault(token, []).append(i)
        self.matchers: dict[int, SequenceMatcher] = {}
        self.postings = {t: np.array(p, np.int64) for t, p in postings.items()}
        self.n_words = np.array([len(w) for w in words], np.int64)
        self.phrases = {p: np.array([p in c for c in self.canonical]) for p, _ in tt.PHRASE_FLOORS}
        self.private = np.array([all(x in c for x in tt.PRIVATE_REGISTRATION[0]) for c in self.canonical])

    def _shared(self, tokens) -> np.ndarray:
        hit = [self.postings[t] for t in tokens if t in self.postings]
        return np.bincount(np.concatenate(hit), minlength=len(self.ids)) if hit else np.zeros(len(self.ids), np.int64)

    def _ratio(self, left: str, i: int) -> float:
        """Sequence ratio with the catalogue side's index kept for the next title."""
        matcher = self.matchers.get(i)
        if matcher is None:
            matcher = self.matchers[i] = SequenceMatcher(None, "", self.canonical[i])
        matcher.set_seq1(left)
        return matcher.ratio()

    def best(self, left: str):
        """(row, score, distinctive shared words, containment, anchor) of the best candidate."""
        tokens = set(left.split())
        shared, distinct = self._shared(tokens), self._shared(tokens - tt.GENERIC_TITLE_WORDS)
        smaller = np.minimum(len(tokens), self.n_words)
        contained = shared / smaller
        fixed = tt.CONTAINMENT_WEIGHT * contained + tt.JACCARD_WEIGHT * shared / (len(tokens) + self.n_words - shared)
        anchor = np.full(len(self.ids), -1)
        for i, (phrase, floor) in enumerate(tt.PHRASE_FLOORS):
            if phrase in left:
                new = self.phrases[phrase] & (anchor < 0)
                fixed[new] = np.maximum(fixed[new], floor)
                anchor[new] = i
        if all(x in left for x in tt.PRIVATE_REGISTRATION[0]):
            fixed[self.private] = np.maximum(fixed[self.private], tt.PRIVATE_REGISTRATION[1])
            anchor[self.private] = len(tt.PHRASE_FLOORS)
        inside = (smaller >= 2) & (shared == smaller) & (distinct > 0)
        fixed[inside] = np.maximum(fixed[inside], tt.CONTAINED_FLOOR)
        bound = 2 * np.minimum(self.letters, _letter_counts(left)).sum(axis=1) / (self.size + len(left))
        score = np.minimum(np.round(fixed, 4), 1)
        top = score.max()
        near = np.flatnonzero((bound + 1e-4 >= top) & (bound > fixed))
        if len(left) <= 64:
            common = common_subsequences(left, self.codes[near, : self.size[near].max(initial=0)])
        else:
            masks: dict[str, int] = {}
            for at, c in enumerate(left):
                masks[c] = masks.get(c, 0) | (1 << at)
            common = np.array([common_subsequence(left, masks, self.canonical[i]) for i in near], np.int64)
        tight = 2 * common / (self.size[near] + len(left))
        for at in np.argsort(-tight, kind="stable"):
            i = near[at]
            if tight[at] + 1e-4 < top:
                break
            if tight[at] > fixed[i]:
                score[i] = min(round(max(self._ratio(left, i), fixed[i]), 4), 1)
                top = max(top, score[i])
        row = int(np.lexsort((np.arange(len(score)), -contained, -distinct, -score))[0])
        names = [p for p, _ in tt.PHRASE_FLOORS] + [tt.PRIVATE_REGISTRATION[2], None]
        return row, float(score[row]), int(distinct[row]), float(contained[row]), names[anchor[row]]


def _best_in_block(left: DataFrame, block: DataFrame) -> DataFrame:
    rows = block.orderBy("title", "id").toPandas()  # at most one block of titles
    shared = left.sparkSession.sparkContext.broadcast(TitleBlock(rows["id"], rows["title"], rows["canonical"]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        titles = shared.value
        for batch in batches:
            out = []
            for c in batch["canonical"]:
                row, points, words, cont, anchor = titles.best(c)
                out.append((c, titles.ids[row], titles.shown[row], points, words, cont, anchor))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in BEST_SCHEMA.split(", ")])

    return left.mapInPandas(score, BEST_SCHEMA)


def resolve_titles(incoming: DataFrame, catalogue: DataFrame, block_titles: int = BLOCK_TITLES) -> DataFrame:
    """Match every distinct ``title`` of ``incoming`` with ``catalogue(id, title)``.

    Result: ``(title, action, matched_service_id, score, method, matched_title)``.
    """
    named = incoming.select("title").distinct().withColumn("canonical", tt.canonical_title("title"))
    known = (
        catalogue.withColumn("canonical", tt.canonical_title("title")).where("canonical <> ''")
        .groupBy("canonical").agg(F.min(F.struct("title", "id")).alias("s"))
        .select("canonical", F.col("s.id").alias("id"), F.col("s.title").alias("title"))
    )
    known = materialize(known)
    exact = known.select("canonical", F.col("id").alias("exact_id"), F.col("title").alias("exact_title"))
    joined = named.join(exact, "canonical", "left")
    rest = joined.where("exact_id IS NULL AND canonical <> ''").select("canonical").distinct()
    # dealt by a hash of its own: a repartition by the key of ``distinct`` is dropped, and few tasks would do all the work
    rest = spread(rest.withColumn("deal", F.xxhash64("canonical")), "deal").drop("deal")
    blocks = -(-known.count() // block_titles)
    best = None
    for number in range(blocks):
        block = known if blocks == 1 else known.where(F.pmod(F.xxhash64("canonical"), F.lit(blocks)) == number)
        part = _best_in_block(rest, block)
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = incoming.sparkSession.createDataFrame([], BEST_SCHEMA)
    w = Window.partitionBy("canonical").orderBy(F.desc("score"), F.desc("shared"), F.desc("containment"), "best_title", "best_id")
    best = best.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    out = joined.join(best, "canonical", "left")
    is_exact = F.col("exact_id").isNotNull()
    d = tt.decide(is_exact, F.col("score"), F.col("shared"), F.col("anchor").isNotNull(), F.col("canonical") == "")
    matched = F.col("d.action").isin("UPDATE", "MERGE_REVIEW")
    return out.withColumn("d", d).select(
        "title", F.col("d.action").alias("action"),
        F.when(is_exact, F.col("exact_id")).when(matched, F.col("best_id")).alias("matched_service_id"),
        F.when(is_exact, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.col("d.method").alias("method"),
        F.when(is_exact, F.col("exact_title")).when(matched, F.col("best_title")).alias("matched_title"),
    )


@F.pandas_udf(DoubleType())
def sequence_ratio_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two canonical titles; no built-in function equals it."""
    return pd.Series([sequence_ratio(a, b) for a, b in zip(left, right)])


def title_metrics(pairs: DataFrame) -> DataFrame:
    """Token measures of ``(left, right)`` title pairs as plain Columns."""
    a, b = tt.title_tokens(tt.canonical_title("left")), tt.title_tokens(tt.canonical_title("right"))
    generic = F.array(*[F.lit(w) for w in sorted(tt.GENERIC_TITLE_WORDS)])
    step = pairs.withColumns({"a": a, "b": b})
    shared = F.array_intersect("a", "b")
    return step.withColumns({
        "containment": F.round(F.size(shared) / F.least(F.size("a"), F.size("b")), 4),
        "jaccard": F.round(F.size(shared) / F.size(F.array_union("a", "b")), 4),
        "distinctive_shared": F.size(F.array_except(shared, generic)).cast("bigint"),
    }).drop("a", "b")
