"""Text, money and URL builders against plain Python statements of the rules."""

import re

import pytest
from pyspark.sql import functions as F

from lodestar.functions import money, text, urls


def one(spark, value, builder):
    return spark.createDataFrame([(value,)], "v string").select(builder(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,want", [("Export & Import_Credit/Line", "export and import credit line"), (None, ""), ("  A--B ", "a b")])
def test_normalize_query(spark, value, want):
    assert one(spark, value, text.normalize_query) == want


@pytest.mark.parametrize("value,want", [("₹ 5,000 Grant!", "5000 grant"), ("A B", "a b"), ("50% (max)", "50% max")])
def test_normalize_text(spark, value, want):
    assert one(spark, value, text.normalize_text) == want


@pytest.mark.parametrize("value,want", [
    ("Artificial Intelligence for Women-led StartUps", "ai for woman led startup"),
    ("IoT & Internet of Things", "iot iot"),
])
def test_canonicalize(spark, value, want):
    assert one(spark, value, text.canonicalize) == want


def test_phrase_needs_borders(spark):
    rows = spark.createDataFrame([("a seed fund now",), ("seed funding",), ("xseed fund",)], "v string")
    got = [r[0] for r in rows.select(text.phrase_present("v", "seed fund")).collect()]
    assert got == [True, False, False]


@pytest.mark.parametrize("value,want", [("Rs 5 lakh or 25 lakhs", [5, 25]), ("1.5 crore", [150]), ("5 lakhs, 5 lakh", [5]), ("none", [])])
def test_amounts(spark, value, want):
    assert sorted(float(x) for x in one(spark, value, money.amounts_in_lakh)) == want


def test_amount_variants(spark):
    row = spark.range(1).select(money.amount_variants(F.lit("5"), F.lit("lakh")).alias("r")).first()["r"]
    assert len(row) == 2 * 4 * 5 and "₹5.00 lakh" in row and "rs. 5 lac" in row


@pytest.mark.parametrize("value,want", [
    ("HTTPS://User:pw@Example.COM:8080/A/b/?q=1#top", "https://example.com:8080/A/b?q=1"),
    ("http://example.com/", "http://example.com"),
    ("", ""),
])
def test_normalize_url(spark, value, want):
    assert one(spark, value, urls.normalize_url) == want


@pytest.mark.parametrize("value,want", [
    ("tdf.example.gov.in", "https://tdf.example.gov.in"), ("MEDTECH", ""), ("Some Foundation", ""), ("www.example.com/a", "https://www.example.com/a"),
])
def test_reference_url(spark, value, want):
    assert one(spark, value, urls.reference_url) == want


def test_splitters(spark):
    assert one(spark, "1. First\n2) Second\nplain", text.split_items) == ["First", "Second"]
    assert one(spark, "a | b|A", text.split_items) == ["a", "b"]
    assert one(spark, "just text", text.split_items) == ["just text"]
    assert one(spark, "just text", text.split_items_strict) == []
    assert one(spark, "x; y", text.split_items_strict) == ["x", "y"]


def test_list_layout(spark):
    assert one(spark, "Do: 1. this 2. that", text.list_layout) == "Do:\n1. this\n2. that"
    assert one(spark, "Only 1. this", text.list_layout) == "Only 1. this"


def test_row_fingerprint_ignores_column_order(spark):
    df = spark.createDataFrame([("x", 1, None)], "b string, a int, c string")
    row = df.select(text.row_fingerprint("a", "b", "c").alias("x"), text.row_fingerprint("c", "b", "a").alias("y")).first()
    assert row["x"] == row["y"] and re.fullmatch("[0-9a-f]{64}", row["x"])


def test_items_of_a_long_list_take_linear_time(spark):
    import time

    lines = "\n".join(f"- Item {i % 3000} of the list" for i in range(6000))
    start = time.time()
    got = one(spark, lines, text.split_items)
    assert got == [f"Item {i} of the list" for i in range(3000)]
    assert time.time() - start < 20


def test_unique_strings_keep_the_first_form_in_order(spark):
    assert one(spark, "b|A|B |a|none|c", lambda c: text.unique_strings(F.split(c, r"\|"))) == ["b", "A", "c"]
