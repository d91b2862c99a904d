"""Comparison texts: the same form as before, computed once a row and at the pace of a plain pattern."""

import time

from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import delta as dl
from lodestar.session import materialize


def test_form(spark):
    odd = ["".join(map(chr, range(256))), "₹5,000  Grant of – 1.5%/yr: a+b-c", "\U0001f600x\U0001f600\U0001f600y", " ,, ", "\tİ ß\n", None]

    def slow(column):
        kept = F.regexp_replace(F.regexp_replace(F.lower(text.blank(column)), " ", " "), "[₹,]", "")
        return text.squeeze(F.regexp_replace(kept, r"[^a-z0-9%./:+\- ]+", " "))

    rows = spark.createDataFrame([(x,) for x in odd], "t string").select(text.normalize_text("t").alias("a"), slow("t").alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
    assert rows[1]["a"] == "5000 grant of 1.5%/yr: a+b-c"


def test_texts_are_normalised_once(spark, monkeypatch):
    plans, plain = [], dl.materialize

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    def noted(df):
        plans.append(plan(df))
        return plain(df)

    raw = materialize(spark.createDataFrame(
        [(1, 1, "Rs 5,000 grant"), (2, 1, " \t"), (3, None, ""), (4, None, "rs 5000 grant"), (5, 1, None), (6, 2, "Rs 5000 grant"), (7, 1, "5000 GRANT for units")],
        "needle_id bigint, service_id bigint, t string"))
    inc = raw.select("needle_id", "service_id", text.normalize_text("t").alias("norm"))
    known = materialize(spark.createDataFrame([(1, "rs 5000 grant"), (1, "the 5000 grant for units, too"), (2, ""), (None, "x")], "service_id bigint, t string"))
    ex = known.select("service_id", text.normalize_text("t").alias("norm"))
    monkeypatch.setattr(dl, "materialize", noted)
    got = dl.existing_needles(inc, ex, ["service_id"])
    assert sorted(r["needle_id"] for r in got.collect()) == [1, 2, 3, 5, 7]
    once = plan(inc).count("regexp_replace(")
    assert sum(p.count("regexp_replace(") for p in [*plans, plan(got)]) == 2 * once


def test_pace(spark):
    words = F.concat_ws(" ", *[F.concat(F.lit("Grant of "), (F.col("id") % 97).cast("string"), F.lit(" lakh, women & dairy units")) for _ in range(30)])
    texts = materialize(spark.range(0, 20_000, 1, 4).select(words.alias("t")))

    def seconds(column):
        best = []
        for _ in range(3):
            start = time.perf_counter()
            texts.agg(F.sum(F.length(column))).collect()
            best.append(time.perf_counter() - start)
        return min(best)

    assert seconds(text.normalize_text("t")) < 8 * seconds(F.regexp_replace("t", r"\s+", " "))
