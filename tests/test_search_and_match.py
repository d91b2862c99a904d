"""Search on a small published catalogue; matching against a brute-force statement."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import match as ma
from lodestar.operators import search as se
from lodestar.operators import suggest as sg

TITLES = [
    "Alpha Working Capital Credit Scheme", "Beta MSME Term Loan Programme",
    "Gamma Export Invoice Discounting", "Delta Supply Chain Finance Facility",
]
EMPTY = ("bde_summary overview benefits eligibility_summary applicable_for_raw funding_organisation funding_type subsidy_details "
         "sales_pitch restrictions important_notes application_deadline_raw").split()


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [(i, f"ITEM-{i:04d}", t) for i, t in enumerate(TITLES)]
    df = spark.createDataFrame(rows, "id bigint, service_id string, title string")
    for c in EMPTY:
        df = df.withColumn(c, F.lit(""))
    return df.withColumns({
        "service_kind": F.lit("REGISTRATION"), "domain_name": F.lit("Finance"), "category_name": F.lit("Bank"), "domain_order": F.lit(1),
        "industries": F.array().cast("array<string>"),
    })


def found(spark, catalogue, *queries):
    none = spark.createDataFrame([], "service_id bigint, category_id bigint")
    cats = spark.createDataFrame([], "id bigint, name string")
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    rows = se.search(q, catalogue, se.catalogue_text(catalogue, none, cats, [])).collect()
    out = {x: [] for x in queries}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r["query"]].append(r["service_id"])
    return out


def combined_before_shuffle(df):
    """Aggregations that run on what a task reads, below the lowest shuffle of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    last = max(i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line)
    return [line for line in plan[last:] if "HashAggregate" in line]


def test_rows_are_shuffled_before_they_are_combined(spark, catalogue):
    """No task may hold the keys of all it reads, or of all that a join with few rows makes of it."""
    sections = spark.createDataFrame([(0, "dairy loan"), (1, "dairy farm")], "service_id bigint, content string")
    assert combined_before_shuffle(sg.postings(catalogue, sections)) == []
    groups = spark.createDataFrame([("q", "g"), ("q", "h"), ("r", "g")], "query string, grp string")
    hits = spark.createDataFrame([("g", 1), ("h", 1), ("g", 2)], "grp string, service_id bigint")
    counts = se.group_counts(F.broadcast(groups), hits)
    assert combined_before_shuffle(counts) == []
    assert sorted(map(tuple, counts.collect())) == [("q", 1, 2), ("q", 2, 1), ("r", 1, 1), ("r", 2, 1)]
    texts = spark.createDataFrame([(1, False, "dairy loan loan-able"), (1, False, "dairy loan loan-able"), (2, True, "loan"), (3, False, "")], "service_id bigint, sector boolean, text string")
    wanted = spark.createDataFrame([("g", ["loan"]), ("h", ["dairy loan"])], "grp string, variants array<string>")
    found = se.group_hits(texts, wanted)
    assert combined_before_shuffle(found) == []
    assert sorted(map(tuple, found.collect())) == [("g", 1), ("g", 2), ("h", 1)]


def test_search(spark, catalogue):
    got = found(spark, catalogue, "credit", "working capital", "msme term loan", "export invoice discounting", "zzz nothing matches this zzz")
    assert set(got["credit"]) == {0, 1}  # credit and loan are one concept
    assert got["working capital"] == [0]
    assert got["msme term loan"][0] == 1
    assert got["export invoice discounting"] == [2]
    assert got["zzz nothing matches this zzz"] == []


@pytest.mark.parametrize("blocks", [(4_096, 1_000), (3, 2)])
def test_blocks_answer_as_pairs_do(spark, monkeypatch, blocks):
    """Ranked answers equal those from every (query, service) row, with ties, amounts, short terms, more matches than places."""
    monkeypatch.setattr(se, "BLOCK_SERVICES", blocks[0])
    monkeypatch.setattr(se, "BLOCK_QUERIES", blocks[1])
    rnd = random.Random(4)
    words = ["loan", "women", "dairy", "ai", "iot", "grant", "export", "5 lakh", "2 crore", "25 lakh", "start-up", "seed", "gst", "repair", "and", "of", "99999999999999999999 lakh"]
    rows = [(i, f"ITEM-{i:04d}", " ".join(rnd.choices(words, k=rnd.randint(1, 4))), " ".join(rnd.choices(words, k=rnd.randint(0, 5)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, service_id string, title string, benefits string")
    for c in EMPTY:
        if c != "benefits":
            df = df.withColumn(c, F.lit(""))
    df = df.withColumns({"service_kind": F.lit("REGISTRATION"), "domain_name": F.lit("Finance"), "category_name": F.lit("Bank"), "domain_order": (F.col("id") % 3).cast("int"),
                         "industries": F.array().cast("array<string>")})
    asked = [" ".join(rnd.choices(words, k=rnd.randint(1, 5))) for _ in range(40)] + ["ai", "loan for women in dairy with 5 lakh", "zzz", "", "of", "99999999999999999998 lakh grant"]
    q = spark.createDataFrame([(x,) for x in asked], "query string")
    none, cats = spark.createDataFrame([], "service_id bigint, category_id bigint"), spark.createDataFrame([], "id bigint, name string")
    texts = se.catalogue_text(df, none, cats, [])
    titles = {r[0]: (r[2], r[0] % 3) for r in rows}
    pairs = {}
    for r in se.search_candidates(q, df, texts).withColumn("t", F.col("service_id")).collect():
        pairs.setdefault(r["query"], []).append((r["service_id"], r["score"]))
    boosts = {(r["query"], r["id"]): r["b"] for r in df.crossJoin(q).select("id", "query", se.title_boost("query", "title").alias("b")).collect()}
    norm = {r["id"]: r["t"] for r in df.select("id", text.normalize_query("title").alias("t")).collect()}
    want = []
    for query, found in pairs.items():
        ranked = sorted((-(score + boosts[query, i]), titles[i][1], norm[i], i) for i, score in found)
        want += [(query, i, -score, rank, len(found)) for rank, (score, _, _, i) in enumerate(ranked[:4], 1)]
    got = [(r["query"], r["service_id"], r["score"], r["rank"], r["result_count"]) for r in se.search(q, df, texts, 4).collect()]
    assert sorted(got) == sorted(want) and len(want) > 60


def test_new_row_is_found_at_once(spark, catalogue):
    more = catalogue.union(catalogue.where("id = 0").withColumns({"id": F.lit(9).cast("bigint"), "title": F.lit("New Credit Line")}))
    assert 9 in found(spark, more, "credit")["credit"]


def test_query_groups(spark):
    q = spark.createDataFrame([(x,) for x in ("seed funding for women", "5 lakh grant funding", "FCRA help", "the of")], "query string")
    got = {}
    for r in se.query_groups(q).collect():
        got.setdefault(r["query"], set()).add(r["grp"])
    assert got["seed funding for women"] == {"seed", "women"}
    assert got["5 lakh grant funding"] == {"amount:5:lakh", "grant"}
    assert got["FCRA help"] == {"literal:fcra"}
    assert "the of" not in got


SERVICE = "id bigint, title string, priority string, status string, effective_from date, pitch_until date, application_deadline date, business_types array<string>, business_stages array<string>, industries array<string>, applicable_states array<string>, founder_categories array<string>, min_business_age_months int, max_business_age_months int, min_turnover decimal(16,2), max_turnover decimal(16,2)"
CLIENT = "client_id bigint, business_type string, business_stage string, industry string, state string, founder_category string, business_age_months int, annual_turnover decimal(16,2)"


def test_blocks_equal_pairwise_evaluation(spark):
    from decimal import Decimal as D

    today = dt.date(2024, 6, 15)
    services = []
    for i in range(60):
        services.append((
            i, f"Service {i % 7}", ["HIGH", "LOW", ""][i % 3], "PUBLISHED" if i % 9 else "DRAFT", None, None, None,
            [None, ["LLP"], ["All Businesses"], ["Trust", " llp "]][i % 4], None, [["Tech"], None, ["any"]][i % 3],
            [["Pan India"], ["Goa"], None][i % 3], None, [None, 12][i % 2], [None, 60, 24][i % 3], [None, D("10")][i % 2], [None, D("100.5")][i % 2],
        ))
    clients = [
        (1, "LLP", None, "Tech", "Goa", "Women", 18, D("50")), (2, None, "Idea", None, None, None, None, None),
        (3, "Trust", "x", "Food", "Goa", "", 200, D("5")), (4, "LLP", None, "Tech", "Goa", "Women", 18, D("50")),
    ]
    s, c = spark.createDataFrame(services, SERVICE), spark.createDataFrame(clients, CLIENT)
    pairs = ma.prepare_clients(c).crossJoin(ma.prepare_services(s.where(ma.pitch.pitchable(today))).withColumnRenamed("id", "service_id"))
    columns = ["client_id", "classification", "service_id", "rank", "bucket_count", "matched_count", "mismatch_count", "unknown_count"]
    for block, lakh in ((200_000, False), (7, True)):
        want = ma.rank_buckets(ma.evaluate(pairs, today, lakh).withColumn("relevance", F.lit(0)), ["client_id"], 5)
        got = ma.match_all(c, s, today, k=5, block_rows=block, limits_in_lakh=lakh)
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_need_equals_pairwise_evaluation(spark):
    """Queries of many services with equal rules, equal texts and ties; clients that come twice with other needs; several blocks."""
    rnd = random.Random(3)
    services = [(i, f"Service {i % 11}", rnd.choice(["HIGH", "LOW", ""]), "PUBLISHED", None, None, None, rnd.choice([None, ["LLP"], ["Trust", " llp "]]), None, None,
                 rnd.choice([["Pan India"], ["Goa"], None]), None, rnd.choice([None, 12]), rnd.choice([None, 60, 24]), None, None) for i in range(150)]
    clients = [(i % 40, rnd.choice(["LLP", "trust ", None]), None, None, rnd.choice(["Goa", "Assam", None]), None, rnd.choice([12, 18, 24, 24, 25, 90, None]), None, rnd.choice(["loan", "", "grant"])) for i in range(50)]
    s, c = spark.createDataFrame(services, SERVICE), spark.createDataFrame(clients, CLIENT + ", need_query string")
    found = spark.createDataFrame([(q, i, rnd.choice([-3, 5, 10])) for q in ("loan", "grant", "other") for i in range(150) if rnd.random() < 0.8], "query string, service_id bigint, score int")
    today = dt.date(2024, 6, 15)
    pairs = ma.prepare_clients(c).withColumnRenamed("need_query", "query").join(found, "query").join(ma.prepare_services(s).withColumnRenamed("id", "service_id"), "service_id")
    want = ma.rank_buckets(ma.evaluate(pairs, today).withColumn("relevance", F.greatest(F.lit(0), "score")), ["client_id"], 4)
    columns = ["client_id", "classification", "service_id", "rank", "relevance", "bucket_count", "matched_count", "mismatch_count", "unknown_count"]
    expected = sorted(map(tuple, want.select(columns).collect()))
    for block in (200_000, 40):
        got = ma.match_need(c, s, found, today, k=4, block_rows=block)
        assert sorted(map(tuple, got.select(columns).collect())) == expected


def test_work_grows_with_distinct_rules_and_classes(spark):
    """3,000 services of two rules and 2,000 clients of as many turnovers are scored as a few services and classes."""
    s = spark.createDataFrame([(i, f"Service {i}", "", "PUBLISHED", None, None, None, None, None, None, None, None, None, None, 100, 200 + i % 2) for i in range(3_000)],
                              SERVICE.replace("decimal(16,2)", "int"))
    c = spark.createDataFrame([(i, "LLP", None, None, None, None, 5, i) for i in range(2_000)], CLIENT.replace("decimal(16,2)", "int"))
    rules = s.withColumnRenamed("id", "service_id").withColumns({"scope": F.lit(""), "relevance": F.lit(0)})
    tagged, parts, picked = ma._match(c.withColumn("scope", F.lit("")), rules, 5, 200_000, False)
    assert tagged.count() == 2_000 and tagged.select("pid").distinct().count() == 6 and picked.count() <= 2 * 2 * 5
    assert {r["bucket_count"] for r in parts.collect()} == {1_500, 3_000}


def test_reasons(spark):
    s = spark.createDataFrame([(1, "T", "LOW", "PUBLISHED", None, None, dt.date(2024, 1, 1), ["LLP"], None, None, None, None, None, 12, None, None)], SERVICE)
    c = spark.createDataFrame([(1, "Trust", None, None, None, None, 24, None)], CLIENT)
    row = ma.evaluate(ma.prepare_clients(c).crossJoin(ma.prepare_services(s).withColumnRenamed("id", "service_id")), "2024-06-15").first()
    assert row["classification"] == "NOT_ELIGIBLE" and row["mismatch_count"] == 3
    assert "mismatch" in row["checks"][0]["reason"]


def suggestions(df):
    return sorted((r["query"], r["rank"], r["service_id"], r["title"], r["tier"]) for r in df.collect())


def test_index_equals_the_catalogue_and_follows_it(spark, catalogue, tmp_path):
    asked = spark.createDataFrame([(x,) for x in ("credit", "loan term", "expo", "msme", "supply chain", "zzz", "b", "fin", "delta new", "working cap", "ban")], "query string")
    notes = spark.createDataFrame([(0, "msme units welcome"), (3, "chain of shops"), (9, "brand new note")], "service_id bigint, content string")
    index = sg.SuggestIndex(spark, str(tmp_path / "index"), rows_per_bucket=5)
    assert index.build(catalogue, notes) == 1
    assert suggestions(index.suggest(asked)) == suggestions(sg.typeahead(asked, catalogue, notes.where("service_id < 9")))
    # one title changes, one service goes, one comes
    other = catalogue.where("id <> 2").withColumn("title", F.when(F.col("id") == 3, "Delta New Facility").otherwise(F.col("title")))
    other = other.unionByName(catalogue.where("id = 1").withColumns({"id": F.lit(9).cast("bigint"), "title": F.lit("Epsilon Loan Term Bank")}))
    notes = notes.where("service_id <> 3")
    before = {p for p in (tmp_path / "index").rglob("*.parquet")}
    assert index.update(other, notes, spark.createDataFrame([(2,), (3,), (9,)], "service_id bigint")) == 2
    assert before <= {p for p in (tmp_path / "index").rglob("*.parquet")}
    got = suggestions(index.suggest(asked))
    assert got == suggestions(sg.typeahead(asked, other, notes)) and {r[2] for r in got} == {0, 1, 3, 9}
    # a call reads the index, not the catalogue's text
    plan = index.suggest(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "benefits" not in plan and "overview" not in plan


def test_rows_by_service_are_not_sent_through_the_driver(spark):
    from pyspark.sql import functions as F

    from lodestar.operators import search as se

    names = ["title", *[c for c in se.RANK_TEXT if c != "title"], "category_name", "domain_name"]
    services = spark.range(50).select("id", *[F.concat(F.lit(f"{n} loan "), F.col("id").cast("string")).alias(n) for n in names])
    groups = spark.createDataFrame([("dairy loan", "literal:loan", ["loan"])], "query string, grp string, variants array<string>")
    hits = spark.range(50).select(F.lit("literal:loan").alias("grp"), F.col("id").alias("service_id"))
    for made in (se._group_points(services, groups, hits), se.rank_scores(services, groups, hits)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [service_id" not in plan and "SortMergeJoin [service_id" in plan
    assert se.rank_scores(services, groups, hits).count() == 50
