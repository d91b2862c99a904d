"""No hidden caps: long cells, late rows, wide sheets, huge numbers, tables that are folders."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import eligibility as el
from lodestar.functions import money
from lodestar.functions.search_terms import TOKEN_TO_CONCEPT
from lodestar.operators import ingest
from lodestar.operators import merge as mg
from lodestar.plans.stream_queries import table_stream
from lodestar.sources.files import csv_rows
from lodestar.sources.snapshots import SnapshotStore

ROW = "file string, sheet string, row_no int, values array<string>, links array<string>"


def test_numbers_too_large_are_no_limit(spark):
    texts = ["incorporated within the last 99999999999 years", "incorporated within the last 1999999999 years", "incorporated within the last 5 years",
             "turnover not exceeding 123456789012345678 crore", "turnover not exceeding 3 crore", "1" * 24 + " lakh and 2 crore", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(el.max_age_months(F.col("t")).value.alias("age"), el.max_turnover_lakh(F.col("t")).value.cast("double").alias("turnover"),
                    F.transform(money.amounts_in_lakh(F.col("t")), lambda x: x.cast("double")).alias("amounts")).collect()
    assert [r["age"] for r in got] == [None, None, 60, None, None, None, None]
    assert [r["turnover"] for r in got] == [None, None, None, None, 300.0, None, None]
    assert got[5]["amounts"] == [200.0]


def test_header_in_a_late_row_and_marker_in_a_late_cell(spark):
    rows = [("f", "a", i, [f"x{i}", "y"], [None, None]) for i in range(1, 40)] + [("f", "a", 40, ["Scheme Name", "Benefits"], [None, None])]
    rows += [("f", "b", i, [f"plain {i}"], [None]) for i in range(1, 1_500)] + [("f", "b", 1_500, ["eligibility criteria and required documents and application process"], [None])]
    df = spark.createDataFrame(rows, ROW)
    headers = ingest.detect_headers(df)
    assert headers.where("sheet = 'a'").first()["header_row"] == 40
    assert ingest.detect_headers(df, first_rows=30).where("sheet = 'a'").count() == 0
    kinds = {r["sheet"]: r["kind"] for r in ingest.sheet_kinds(df, headers).collect()}
    assert kinds["b"] == ingest.sheet_kinds(df.where("sheet = 'b' AND row_no > 1400"), headers).first()["kind"]


def test_long_cells_and_wide_rows():
    cell = "z" * 140_000
    rows = list(csv_rows(("a;b\n" + cell + ";" + ";".join("1" for _ in range(300)) + "\n").encode()))
    assert rows[1][2][0] == cell and len(rows[1][2]) == 301


@pytest.mark.parametrize("parts", [None, 3])
def test_a_streamed_table_is_a_file_or_a_folder(spark, tmp_path, parts):
    spark.range(100).repartition(parts or 1).write.parquet(f"{tmp_path}/made")
    if parts:
        spark.read.parquet(f"{tmp_path}/made").write.parquet(f"{tmp_path}/events.parquet")
    else:
        (next((tmp_path / "made").glob("part-*.parquet"))).rename(tmp_path / "events.parquet")
    query = table_stream(spark, str(tmp_path), "events").writeStream.format("memory").queryName(f"t{parts}").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table(f"t{parts}").count() == 100


def test_long_candidate_ids_stay_apart(spark):
    keys = spark.createDataFrame([("P-1-" + "9" * 60 + x,) for x in "ab"] + [("P-1-7",)], "k string").select(mg._short_key(F.col("k")).alias("k"))
    got = [r["k"] for r in keys.collect()]
    assert len(set(got)) == 3 and max(map(len, got)) == 40 and got[2] == "P-1-7"


def test_status_of_a_batch(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.status(7) is None
    one = spark.range(1)
    store.commit({"service": one}, 7, "APPLY")
    assert store.status(7) == "IMPORTED" and store.status(8) is None
    store.commit({"service": one}, 7, "ROLLBACK")
    assert store.status(7) == "ROLLED_BACK"


def test_vocabulary_is_pinned():
    assert len(TOKEN_TO_CONCEPT) == 62 and TOKEN_TO_CONCEPT["kheti"] == "agriculture" and TOKEN_TO_CONCEPT["udyam"] == "msme"
    assert len(el.STATES) == 28 and dict(el.STATES)["West Bengal"] == (r"\bwest\s+bengal\b",) and dict(el.STATES)["Tamil Nadu"] == (r"\btamil\s*nadu\b",)
