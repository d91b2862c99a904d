"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: how likely the visible text is in each language (hashed byte trigrams,
counted by a grouped aggregation over all documents with a known language), the language that the markup declares,
the language code in the address, and what is usual on the host. Host priors are smoothed over a hierarchy: host ->
address suffix -> all pages, each level adding ``STRENGTH`` pages' worth of its parent. They and the reliability of
declared languages and codes are soft counts of the text posteriors of all pages; a page's own share is taken out of
its host's before it is used.

Null or empty html leaves the text likelihoods flat, a missing declaration or URL is a value of its own, so every page
gets the most probable language; ties go to the first in alphabetical order. Documents without a language teach
nothing; without any language at all ``lang`` is null. Repeated rows are judged alike; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, slices, string_bytes

#: Hashed trigrams, and the smoothing of their counts.
GRAMS, SMOOTH = 1 << 14, 0.5
#: Trigrams of a text aren't independent: their log likelihoods count by this share. Their sum grows with the text, so
#: that a long text outweighs a prior or a declaration, however many pages these were learned from.
TEMPER = 0.0625
#: Pages that a parent's prior counts as, and counts added to each value of a declaration.
STRENGTH, DECLARED_SMOOTH = 5.0, 0.5
#: Parts that the pages of a host are dealt over to meet the host's prior.
SALTS = 64

#: Comments, scripts and styles that aren't closed run to the end.
_MARKUP = re.compile(r"<!--.*?(?:-->|(?P<comment>\Z))|<(script|style)\b.*?(?:</\2\s*>|(?P<code>\Z))|<[^>]*>", re.S | re.I)
_HIDDEN = re.compile(r"<!--|<(?:script|style)\b", re.I)


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the lower-cased texts and n + 1 bounds."""
    raw, bounds = string_bytes(column)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    grams = (mix(low[:-2] * np.uint64(65536) + low[1:-1] * np.uint64(256) + low[2:]) % np.uint64(GRAMS)).astype(np.int64)
    sizes = np.maximum(np.diff(bounds) - 2, 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + np.repeat(bounds[:-1], sizes)
    return grams[at], ends


def _counted(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch):
            grams, bounds = _grams(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            rows = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            for lang in set(langs):
                chosen = (langs == lang)[rows]
                counts[lang] = counts.get(lang, 0) + np.bincount(grams[chosen], minlength=GRAMS)
    for lang, n in counts.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "gram": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64())})


def trigram_model(docs: DataFrame, *, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and log probabilities of every trigram in each."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    summed = rows.mapInArrow(_counted, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(summed["lang"]))
    table = np.full((GRAMS, len(langs)), SMOOTH)
    table[summed["gram"].to_numpy(dtype=np.int64), [langs.index(x) for x in summed["lang"]]] += summed["n"].to_numpy(dtype=np.float64)
    return langs, np.log(table / table.sum(axis=0))


def visible(source: str) -> str:
    """Text outside of markup. Behind the last ``>`` no tag can end, so none is looked for: the time is linear in the source."""
    cut = source.rfind(">") + 1
    parts, at, rest = [], 0, _HIDDEN.split(source[cut:], 1)[0]
    for m in _MARKUP.finditer(source, 0, cut):
        parts.append(source[at : m.start()])
        at = m.end()
        if m["comment"] is not None or m["code"] is not None:
            rest = ""
    return html.unescape(" ".join([*parts, source[at:cut] + rest]))


def text_evidence(pages: DataFrame, langs: list[str], logs: np.ndarray, *, key: str, url: str, source: str) -> DataFrame:
    """page columns and ``logs``: tempered log likelihood of the visible text in every language."""
    shared = pages.sparkSession.sparkContext.broadcast(logs)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                grams, bounds = _grams(pa.array([visible(t or "") for t in part.column("text").to_pylist()], pa.string()))
                rows = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                columns = [np.bincount(rows, weights=shared.value[grams, k], minlength=part.num_rows) for k in range(len(langs))]
                total = np.stack(columns, axis=1) * TEMPER
                total -= total.max(axis=1, keepdims=True)
                yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in ("key", "host", "suffix", "code", "declared")}, "logs": pa.array(list(total), pa.list_(pa.float64()))})

    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]+)", 1))
    rows = pages.select(
        F.col(key).alias("key"), host.alias("host"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"),
        _known(F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2,3})(?:[-_/?#]|$)", 1)), langs).alias("code"),
        _known(declared, langs).alias("declared"), F.col(source).alias("text"),
    )
    kind = pages.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, host string, suffix string, code string, declared string, logs array<double>")


def _known(value: Column, langs: list[str]) -> Column:
    """The value if it names one of the languages; else whether there is any."""
    return F.when(value.isin(langs), value).when(value == "", F.lit("none")).otherwise(F.lit("other"))


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    summed = rows.groupBy(*keys).agg(*(F.sum(F.get("text_share", F.lit(i))).alias(f"s{i}") for i in range(n)))
    return summed.select(*keys, F.array(*(f"s{i}" for i in range(n))).alias(name))


def smoothed(counts: Column, prior: Column, strength: float = STRENGTH) -> Column:
    """Shares of counts after ``strength`` counts are added in the prior's shares."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda c, p: (c + strength * p) / (total + strength))


def _reliability(rows: DataFrame, column: str, langs: list[str]) -> Column:
    """log P(value of ``column`` | language) as a column of arrays, from soft counts (a fixed number of values)."""
    values = [*langs, "none", "other"]
    found = {r[column]: r["n"] for r in _sums(rows, [column], len(langs), "n").collect()}
    table = np.array([found.get(v) or [0.0] * len(langs) for v in values]) + DECLARED_SMOOTH
    logs = np.log(table / table.sum(axis=0))
    cases = F.when(F.lit(False), F.array(*map(F.lit, [0.0] * len(langs))))
    for value, row in zip(values, logs.tolist(), strict=True):
        cases = cases.when(F.col(column) == value, F.array(*map(F.lit, row)))
    return cases


def identify(pages: DataFrame, docs: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``key``, ``lang``, ``confidence`` (posterior), ``text_lang`` (by the text alone), ``declared`` and ``host``."""
    scratch = Scratch(pages.sparkSession, "language")
    langs, logs = trigram_model(docs)
    if not langs:
        return pages.select(F.col(key), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    n = len(langs)
    rows = text_evidence(pages, langs, logs, key=key, url=url, source=source).withColumn("text_share", softmax(F.col("logs")))
    rows = scratch.keep(rows, "text")
    whole = _sums(rows, [], n, "whole").first()["whole"]
    uniform = F.array(*[F.lit(1.0 / n)] * n)
    everywhere = smoothed(F.array(*(F.lit(float(x or 0.0)) for x in whole)), uniform)
    hosts = _sums(rows, ["suffix", "host"], n, "host_counts")
    suffixes = _sums(rows, ["suffix"], n, "suffix_counts").withColumn("suffix_prior", smoothed(F.col("suffix_counts"), everywhere)).drop("suffix_counts")
    # a host has one suffix, and there are few suffixes to many hosts
    priors = hosts.join(suffixes, "suffix").select("host", "host_counts", "suffix_prior").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "logs"), F.lit(SALTS)).cast("int"))
    met = salted.join(priors, ["host", "salt"])
    others = F.zip_with("host_counts", "text_share", lambda c, s: F.greatest(c - s, F.lit(0.0)))
    parts = [F.transform(smoothed(others, F.col("suffix_prior")), lambda x: F.log(x)), F.col("logs"), _reliability(rows, "declared", langs), _reliability(rows, "code", langs)]
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)
    names = F.array(*map(F.lit, langs))
    best = lambda shares: F.get(names, (F.array_position(shares, F.array_max(shares)) - 1).cast("int"))
    out = met.withColumn("posterior", softmax(total))
    return out.select(F.col("key").alias(key), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"), best(F.col("text_share")).alias("text_lang"), "declared", "host")
