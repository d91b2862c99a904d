"""Delta classification, gated merge into snapshots, ledger and rollback."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar import import_batch
from lodestar.functions import text
from lodestar.operators import delta as dl
from lodestar.operators import merge as mg
from lodestar.operators import review as rv
from lodestar.sources.snapshots import MAX_WRITES, CommitConflict, Files, SnapshotStore


def exists(needle, bodies):
    if not needle:
        return True
    return any(
        needle == b or (len(needle) >= 12 and needle in b) or (len(b) >= 12 and b in needle and len(b) / len(needle) >= 0.8) for b in bodies
    )


def test_containment_join_equals_pairwise(spark):
    rnd = random.Random(7)
    words = ["loan", "seed", "grant", "registration", "a", "ofthe", "compliance", "x"]
    bodies = [(k % 3, " ".join(rnd.choices(words, k=rnd.randint(1, 9)))) for k in range(60)]
    needles = [(i, i % 3, rnd.choice(["", " ".join(rnd.choices(words, k=rnd.randint(1, 6))), rnd.choice(bodies)[1][2:-1], rnd.choice(bodies)[1] + " extra"])) for i in range(200)]
    inc = spark.createDataFrame(needles, "needle_id bigint, service_id bigint, norm string").withColumn("norm", text.normalize_text("norm"))
    ex = spark.createDataFrame(bodies, "service_id bigint, norm string")
    got = {r[0] for r in dl.existing_needles(inc, ex, ["service_id"]).collect()}
    want = {i for i, s, n in needles if exists(" ".join(n.split()), [b for k, b in bodies if k == s])}
    assert got == want


def random_text(rnd, words, n):
    return " ".join(rnd.choices(words, k=n))


@pytest.mark.parametrize("heavy,few", [(20_000, 4), (3, 0), (20_000, 1_000)])
def test_containment_in_one_large_service(spark, monkeypatch, heavy, few):
    """One service holds four fifths of all texts; most share their words; contained texts start and end within words."""
    monkeypatch.setattr(dl, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(dl, "FEW_TEXTS", few)
    rnd = random.Random(3)
    words = ["the", "of", "loan", "registration", "ab", "incorporation", "unternehmensgruendung", "a", "x1", "compliance/check"]
    own = lambda i: 0 if i % 5 else 1 + i % 7
    bodies = [(own(i), random_text(rnd, words, rnd.randint(1, 14))) for i in range(300)]
    needles = []
    for i in range(900):
        s, b = bodies[rnd.randrange(len(bodies))]
        start = rnd.randrange(len(b))
        piece = b[start : start + rnd.randint(8, 60)]
        text_ = rnd.choice([piece, piece.strip() + " " + rnd.choice(words), random_text(rnd, words, rnd.randint(1, 5)), b, b + " x1"]).strip()
        needles.append((i, s, text_))
    inc = spark.createDataFrame([*needles, (9_000, None, "the loan of the loan"), (9_001, 0, None), (9_002, None, "")], "needle_id bigint, service_id bigint, norm string")
    ex = spark.createDataFrame([*bodies, (None, "the loan of the loan"), (0, None)], "service_id bigint, norm string").repartition(5)
    got = {r[0] for r in dl.existing_needles(inc, ex, ["service_id"]).collect()}
    assert got == {i for i, s, n in needles if exists(n, [b for k, b in bodies if k == s])} | {9_002}


def test_a_text_is_looked_up_by_its_rarest_feature(spark):
    """A thousand texts share all words but one; the pairs to compare are as many as the texts that hold it."""
    body = spark.range(1_000).selectExpr("id", "1L AS key", "'the same long text with number n' || id || ' in it and more words' AS norm")
    small = spark.range(1_000).selectExpr("id", "1L AS key", "'ext with number n' || id || ' in i' AS norm")
    small, body = (x.selectExpr("id", "key", "length(norm) AS size", "split(norm, ' ') AS words") for x in (small, body))
    assert dl._containing_pairs(small, body, F.lit(True)).count() == 1_000
    assert dl._containing_pairs(small.where("id < 0"), body, F.lit(True)).count() == 0


def test_structured_differences(spark):
    texts = spark.createDataFrame([(1, "benefits", "grant of 5 lakh"), (1, "content", "long existing content about benefits")], "service_id bigint, bucket string, norm string")
    known = spark.createDataFrame([(1, "https://a.b/c", "FLYER")], "service_id bigint, url string, source_kind string")
    fields = spark.createDataFrame([
        (1, 1, "benefits", "Grant of ₹5 lakh"), (2, 1, "benefits", "Something new"), (3, 1, "minimum_charge", "100"), (4, 1, "flyer", "https://x.y/z"),
        (5, 1, "portal_link", "https://x.y/z"), (6, 1, "portal_link", "Apply here"), (7, 1, "flyer", "HTTPS://A.B/c/"), (8, 1, "unknown", "grant of 5 lakh"), (9, 1, "title", "T"),
    ], "cand_id bigint, service_id bigint, field string, value string")
    links = spark.createDataFrame([(6, 1, "portal_link", "https://new.link/")], "cand_id bigint, service_id bigint, field string, url string")
    got = {(r["cand_id"], r["change_type"]) for r in dl.structured_differences(fields, links, texts, known).collect()}
    assert got == {(2, "CHANGED_INFORMATION"), (3, "SAFE_ADDITION"), (4, "CHANGED_INFORMATION"), (5, "SAFE_ADDITION"), (6, "SAFE_ADDITION")}


def test_narrative_differences(spark):
    texts = spark.createDataFrame([(1, "content", "existing wording of this service")], "service_id bigint, bucket string, norm string")
    known = spark.createDataFrame([], "service_id bigint, url string, source_kind string")
    rows = [
        (1, 1, 1, 1, "BENEFITS", "Benefits", True, None), (1, 1, 2, 1, "BENEFITS", "Existing wording of this service", False, None),
        (1, 1, 3, 1, "BENEFITS", "A new benefit", False, "https://n.ew"), (2, 2, 1, 1, "NOTES", "Anything", False, None),
    ]
    s = spark.createDataFrame(rows, "cand_id bigint, service_id bigint, source_row int, source_column int, section_type string, content string, is_heading boolean, url string")
    got = {(r["cand_id"], r["field"], r["change_type"]) for r in dl.narrative_differences(s, texts, known).collect()}
    assert got == {(1, "section:BENEFITS", "CHANGED_INFORMATION"), (1, "link:BENEFITS", "SAFE_ADDITION"), (2, "section:NOTES", "SAFE_ADDITION")}


SERVICE = ("id bigint, service_id string, title string, slug string, category_id bigint, domain_id bigint, service_kind string, status string, benefits string, "
           "eligibility_summary string, applicable_for_raw string, funding_organisation string, funding_type string, application_deadline_raw string, important_notes string")
ROWS = "batch_id bigint, cand_id bigint, ord bigint, candidate_action string, decision string, delta_status string, matched_service_id bigint, title string, category_id bigint, service_kind string, provenance string, confidence double"


@pytest.fixture
def store(spark, tmp_path):
    st = SnapshotStore(spark, str(tmp_path / "store"))
    st.commit({
        "service": spark.createDataFrame([(1, "S1", "Old", "old", 1, 1, "GRANT", "PUBLISHED", "", "have", "", "", "", "", "")], SERVICE),
        "content": spark.createDataFrame([], mg.CONTENT_SCHEMA), "source": spark.createDataFrame([], mg.SOURCE_SCHEMA),
        "commercial": spark.createDataFrame([], mg.COMMERCIAL_SCHEMA), "ledger": spark.createDataFrame([], mg.LEDGER_SCHEMA),
    }, 0, "LOAD")
    return st


def world(spark, rows, diffs, status="PREVIEWED", sha="s", other=()):
    batch = {"id": 7, "status": status, "file_sha256": sha}
    batches = spark.createDataFrame([(7, status, sha), *other], "id bigint, status string, file_sha256 string")
    r = spark.createDataFrame([(7, *x, "Sheet row", 0.9) for x in rows], ROWS)
    d = spark.createDataFrame(diffs, "cand_id bigint, field string, incoming string")
    cats = spark.createDataFrame([(1, 3)], "id bigint, domain_id bigint")
    return batch, batches, r, d, cats


UPDATE = (10, 1, "UPDATE", "APPROVED", "SAFE_ADDITION", 1, None, None, None)
CREATE = (11, 2, "CREATE", "APPROVED", "NEW_SERVICE", None, "Old", 1, "LOAN")
DIFFS = [(10, "benefits", "Five lakh"), (10, "portal_link", "https://p.q/"), (10, "minimum_charge", "Rs 5"), (10, "section:NOTES", "Remember this"), (11, "eligibility", "Anyone")]


def test_apply_and_rollback(spark, store):
    out = mg.apply_batch(store, *world(spark, [UPDATE, CREATE], DIFFS))
    assert out["version"] == 2 and store.current() == 2
    svc = {r["id"]: r for r in store.read("service").collect()}
    assert svc[1]["benefits"] == "Five lakh" and svc[1]["eligibility_summary"] == "have"
    assert svc[2]["slug"] == "old-2" and svc[2]["domain_id"] == 3 and svc[2]["status"] == "PUBLISHED" and svc[2]["eligibility_summary"] == "Anyone"
    assert store.read("content").first()["section_type"] == "NOTES"
    assert store.read("source").first()["source_kind"] == "OFFICIAL_PORTAL"
    assert store.read("commercial").first()["minimum_charge_raw"] == "Rs 5"
    log = store.read("ledger")
    assert {r["action"] for r in log.collect()} == {"SERVICE_CREATE", "SERVICE_UPDATE", "CONTENT_CREATE", "SOURCE_ADD", "COMMERCIAL_CREATE"}
    mg.rollback_batch(store, 7)
    assert [r["benefits"] for r in store.read("service").collect()] == [""]
    assert store.read("content").count() == store.read("source").count() == 0
    assert store.read("ledger").where("NOT is_reversed").count() == 0
    with pytest.raises(mg.MergeRefused):
        mg.rollback_batch(store, 7)


def test_occupied_core_field_goes_to_content(spark, store):
    mg.apply_batch(store, *world(spark, [UPDATE], [(10, "eligibility", "Other wording")]))
    assert store.read("service").first()["eligibility_summary"] == "have"
    row = store.read("content").first()
    assert (row["section_type"], row["content"], row["visibility"]) == ("ELIGIBILITY", "Other wording", "BDE")


@pytest.mark.parametrize("rows,kwargs", [
    ([UPDATE], {"status": "IMPORTED"}),
    ([UPDATE], {"other": [(3, "IMPORTED", "s")]}),
    ([(10, 1, "UPDATE", "PENDING", "SAFE_ADDITION", 1, None, None, None)], {}),
    ([(10, 1, "UPDATE", "APPROVED", "CHANGED_INFORMATION", 1, None, None, None)], {}),
    ([(11, 2, "CREATE", "APPROVED", "NEW_SERVICE", None, "Old", 99, "LOAN")], {}),
    ([(11, 2, "CREATE", "APPROVED", "NEW_SERVICE", None, "Old", 1, "NONSENSE")], {}),
    ([UPDATE, (12, 3, "UPDATE", "APPROVED", "SAFE_ADDITION", 1, None, None, None)], {"more": [(12, "benefits", "Quite another text")]}),
])
def test_refusals_leave_nothing(spark, store, rows, kwargs):
    diffs = DIFFS[:4] + kwargs.pop("more", [])
    with pytest.raises(mg.MergeRefused):
        mg.apply_batch(store, *world(spark, rows, diffs, **kwargs))
    assert store.current() == 1 and store.read("ledger").count() == 0


def test_skip_creates_nothing_and_dry_run_writes_nothing(spark, store):
    skip = (11, 2, "SKIP", None, "NEW_SERVICE", None, "New", 1, "LOAN")
    mg.apply_batch(store, *world(spark, [skip], [(11, "benefits", "x")]))
    assert store.read("service").count() == 1
    before = store.current()
    mg.apply_batch(store, *world(spark, [UPDATE], DIFFS[:1]), dry_run=True)
    assert store.current() == before


def test_reconcile_mode(spark, store):
    again = [(3, "IMPORTED", "s")]
    mg.apply_batch(store, *world(spark, [UPDATE], DIFFS[:1], other=again), reconcile=True)
    with pytest.raises(mg.MergeRefused):
        mg.apply_batch(store, *world(spark, [CREATE], [], other=again), reconcile=True)


def test_reconciliation_counts(spark):
    rows = spark.createDataFrame([(1, "UPDATE", "NO_CHANGE"), (2, "UPDATE", "SAFE_ADDITION")], "id bigint, candidate_action string, delta_status string")
    got = {r["id"]: r["rec_decision"] for r in rv.reconciliation_rows(rows, {"NO_CHANGE": 1}).collect()}
    assert got == {1: "SKIPPED", 2: "PENDING"}
    with pytest.raises(ValueError):
        rv.reconciliation_rows(rows, {"NO_CHANGE": 2})


# -- commits, buckets, later changes --------------------------------------------------------------


def many(spark, n):
    return spark.range(n).selectExpr("id", "'S' || id AS service_id", "'T' || id AS title", "'t-' || id AS slug", "1L AS category_id", "1L AS domain_id", "'GRANT' AS service_kind", "'PUBLISHED' AS status",
                                     "'' AS benefits", "'have' AS eligibility_summary", *(f"'' AS {c}" for c in ("applicable_for_raw", "funding_organisation", "funding_type", "application_deadline_raw", "important_notes")))


def big_store(spark, tmp_path, n=4_000, per=50):
    st = SnapshotStore(spark, str(tmp_path / "big"), rows_per_bucket=per)
    content = spark.range(n).selectExpr("'c' || id AS child_key", "id AS service_id", "'NOTES' AS section_type", "'h' AS heading", "'text ' || id AS content", "'BDE' AS visibility", "'load' AS provenance")
    st.commit({"service": many(spark, n), "content": content, "source": spark.createDataFrame([], mg.SOURCE_SCHEMA), "commercial": spark.createDataFrame([], mg.COMMERCIAL_SCHEMA)}, 0, "LOAD")
    return st


def sizes(path):
    return {p: p.stat().st_size for p in path.rglob("*.parquet")}


def test_a_batch_writes_its_buckets_only(spark, tmp_path):
    st = big_store(spark, tmp_path)
    before = sizes(tmp_path / "big")
    mg.apply_batch(st, *world(spark, [UPDATE], DIFFS[:4]))
    after = sizes(tmp_path / "big")
    assert before.items() <= after.items()  # no folder of the old version was touched
    new = [p for p in after if p not in before]
    assert sum(after[p] for p in new) < 0.1 * sum(before.values())
    assert len({p.parent for p in new if "/service/" in str(p)}) == 1  # one bucket of eighty
    assert st.read("service").count() == 4_000 and st.read("content").count() == 4_001
    assert st.read("service").where("id = 1").first()["benefits"] == "Five lakh" and st.read("service", 1).where("id = 1").first()["benefits"] == ""
    mg.rollback_batch(st, 7)
    assert st.read("service").where("benefits <> ''").count() == 0 and st.read("content").count() == 4_000
    assert st.read("ledger").where("NOT is_reversed").count() == 0 and st.read("ledger").count() == 4


def test_two_writers_from_one_version(spark, store):
    rows = store.read("service")
    with store.begin() as a, store.begin() as b:
        for change, title in ((a, "A"), (b, "B")):
            new = rows.withColumn("title", F.lit(title))
            change.rewrite("service", "id", change.buckets("service", rows.select("id")), new, rows.select("id"))
            change.note("touched", rows.select(F.col("id").alias("service_id")))
        assert b.commit(8, "APPLY") == 2
        with pytest.raises(CommitConflict):
            a.commit(9, "APPLY")
    assert [r["title"] for r in store.read("service").collect()] == ["B"] and store.current() == 2
    assert store.status(9) is None and store.read("touched").count() == 1
    assert all(not store.files.names(p) for p in a.written)


def test_many_writers_at_once(spark, store):
    """Threads that add a row each and begin again after a conflict: every row is there once, every version has one writer."""
    from concurrent.futures import ThreadPoolExecutor

    def add(k):
        for _ in range(50):
            with store.begin() as change:
                change.insert("source", spark.createDataFrame([(f"k{k}", 1, "FLYER", f"https://{k}/", "p")], mg.SOURCE_SCHEMA))
                try:
                    return change.commit(100 + k, "APPLY")
                except CommitConflict:
                    continue

    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(add, range(12)))
    assert sorted(versions) == list(range(2, 14))
    assert sorted(r["child_key"] for r in store.read("source").collect()) == sorted(f"k{k}" for k in range(12))
    # one bucket got twelve rows; it is folded before it has more folders than allowed
    live = store.manifest(store.current())["tables"]["source"]["live"]
    assert len(live) <= MAX_WRITES
    at_five = [r["child_key"] for r in store.read("source", 5).collect()]
    assert len(at_five) == 4
    assert store.expire(store.current()) > 0 and store.read("source").count() == 12


def test_a_manifest_is_created_once(spark, tmp_path):
    files = Files(spark)
    (tmp_path / "m").mkdir()
    name = str(tmp_path / "m" / "1.json")
    assert files.create_once(name, "first") and not files.create_once(name, "second") and files.read(name) == "first"
    for text in ("a", "b"):  # the way of file systems whose rename never replaces
        (tmp_path / "m" / f"draft-{text}").write_text(text)
    other = str(tmp_path / "m" / "2.json")
    assert files._move(str(tmp_path / "m" / "draft-a"), other) and not files._move(str(tmp_path / "m" / "draft-b"), other)
    assert files.read(other) == "a"


def later(spark, st, benefits="Changed meanwhile"):
    """Another batch that fills the benefits of service 1."""
    batch, batches, r, d, cats = world(spark, [(20, 1, "UPDATE", "APPROVED", "SAFE_ADDITION", 1, None, None, None)], [(20, "benefits", benefits)], sha="t")
    mg.apply_batch(st, {**batch, "id": 8}, batches, r, d, cats)


def test_rows_are_checked_again_after_later_changes(spark, store):
    later(spark, store)
    staged = world(spark, [UPDATE], [(10, "benefits", "Five lakh")])
    staged[0]["staged_version"] = 1
    fields = spark.createDataFrame([(10, "benefits", "Five lakh")], "cand_id bigint, field string, value string")
    with pytest.raises(mg.MergeRefused, match="give its fields"):
        mg.apply_batch(store, *staged)
    with pytest.raises(mg.MergeRefused, match="may not be applied"):
        mg.apply_batch(store, *staged, fields=fields)
    staged[0]["staged_version"] = 2  # compared with the changed catalogue, so nothing is stale
    assert mg.apply_batch(store, *staged, fields=fields)["version"] == 3


def test_a_text_that_came_meanwhile_is_no_change(spark, store):
    later(spark, store, "Five lakh")
    staged = world(spark, [UPDATE], DIFFS[:2])
    fields = spark.createDataFrame([(10, "benefits", "Five lakh"), (10, "portal_link", "https://p.q/")], "cand_id bigint, field string, value string")
    mg.apply_batch(store, *staged, fields=fields)
    assert store.read("content").count() == 0 and store.read("source").count() == 1
    mg.rollback_batch(store, 7)
    staged[0]["id"] = 9
    sections = spark.createDataFrame([(10, 1, 1, "NOTES", "five  LAKH", False, None)], "cand_id bigint, source_row int, source_column int, section_type string, content string, is_heading boolean, url string")
    assert mg.apply_batch(store, *staged, sections=sections, dry_run=True)["no_change"] == 1  # a rollback counts as a change too


def test_a_row_of_a_missing_service_is_refused(spark, store):
    gone = (10, 1, "UPDATE", "APPROVED", "SAFE_ADDITION", 77, None, None, None)
    with pytest.raises(mg.MergeRefused, match="does not exist"):
        mg.apply_batch(store, *world(spark, [gone], DIFFS[:1]))
    assert store.current() == 1


def test_commands(spark, store, tmp_path, capsys):
    batch, batches, r, d, cats = world(spark, [UPDATE, CREATE], DIFFS)
    folder = str(tmp_path / "staged")
    for name, df in (("batches", batches), ("rows", r), ("differences", d), ("categories", cats)):
        df.write.parquet(f"{folder}/{name}")
    staged = import_batch.Staged.read(spark, folder)
    assert staged.fields is None
    outcomes = []
    for flags in ({}, {"dry_run": True}, {"confirm": True}, {"confirm": True}, {"rollback": True}):
        done = import_batch.run(store, staged, 7, **flags)
        outcomes.append((done["outcome"], done["version"], done["candidate_rows"], done["approved"]))
    assert outcomes == [("PREVIEWED", None, 2, 2), ("DRY_RUN", None, 2, 2), ("IMPORTED", 2, 2, 2), ("REFUSED", None, 2, 2), ("ROLLED_BACK", 3, 2, 2)]
    assert import_batch.main([store.root, folder, "7", "--rollback"]) == 1 and '"REFUSED"' in capsys.readouterr().out
    with pytest.raises(mg.MergeRefused, match="no batch"):
        import_batch.run(store, staged, 5)


def test_existing_texts_are_not_copied_for_each_field(spark, monkeypatch):
    """A text is compared once per bucket, whatever the number of fields or section types that read it."""
    from lodestar.operators import delta as dl

    seen, plain = [], dl.existing_needles

    def counted(incoming, existing, keys):
        seen.append(existing.count())
        return plain(incoming, existing, keys)

    monkeypatch.setattr(dl, "existing_needles", counted)
    texts = spark.createDataFrame([(1, "content", "grant for small dairy farms"), (1, "rules", "only for women"), (2, "benefits", "tax holiday")], "service_id bigint, bucket string, norm string")
    urls = spark.createDataFrame([], "service_id bigint, url string, source_kind string")
    rows = [(10, 1, "benefits", "Grant for small dairy farms"), (10, 1, "eligibility", "Only for women"), (10, 1, "deadline", "Only for women"), (10, 1, "odd", "only for WOMEN"),
            (10, 1, "benefits2", "new text"), (20, 2, "deadline", "31 March"), (30, 3, "odd", "-*-,"), (30, 3, "other", "x"), (40, None, "benefits", "Grant")]
    fields = spark.createDataFrame(rows, "cand_id bigint, service_id bigint, field string, value string")
    links = spark.createDataFrame([], "cand_id bigint, service_id bigint, field string, url string")
    got = {(r["cand_id"], r["field"], r["change_type"]) for r in dl.structured_differences(fields, links, texts, urls).collect()}
    assert got == {(10, "deadline", "CHANGED_INFORMATION"), (10, "benefits2", "CHANGED_INFORMATION"), (20, "deadline", "SAFE_ADDITION"),
                   (30, "odd", "SAFE_ADDITION"), (30, "other", "SAFE_ADDITION"), (40, "benefits", "SAFE_ADDITION")}
    sections = spark.createDataFrame([(1, 1, i, 1, kind, body, False, "") for i, (kind, body) in enumerate([("ELIGIBILITY", "Only for women"), ("NOTES", "Only for women"), ("GLOSSARY", "grant")])],
                                     "cand_id bigint, service_id bigint, source_row int, source_column int, section_type string, content string, is_heading boolean, url string")
    got = {(r["field"], r["change_type"]) for r in dl.narrative_differences(sections, texts, urls).collect()}
    assert got == {("section:GLOSSARY", "CHANGED_INFORMATION")}
    assert max(seen) <= 3
