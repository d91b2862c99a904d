"""Title resolution against brute force; files, sheets and candidates."""

import io
import random
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestar.functions import titles as tt
from lodestar.operators import ingest as ing
from lodestar.operators import resolve as rs
from lodestar.sources import files as fs

CATALOGUE = [
    (1, "Startup India Recognition"), (2, "Startup India Seed Fund Scheme"), (3, "LLP Incorporation"), (4, "Private Limited Company Registration"),
    (5, "80-IAC Tax Exemption"), (6, "GST Registration"), (7, "Trademark Filing"), (8, "Annual Compliance Private Limited"), (9, "Export Credit Guarantee"),
]
INCOMING = [
    "startup india recognition", "Start-up India", "Seed Funding", "LLP registration", "Pvt Ltd Incorporation", "80 IAC", "GST Registraton",
    "Trade mark filing", "Completely different matter", "Export Credit Guaranty Plan", "", "Compliance annual", "Tax Exemption 80IAC certificate",
]


def model(title, rows):
    """Best candidate by the stated rules, comparing with every catalogue title."""
    best = None
    for sid, shown, left, right in rows:
        if not left:
            return ("INVALID", None, 0.0)
        if left == right:
            key, entry = (2, 99, 1, -sid), ("UPDATE", sid, 1.0)
        else:
            a, b = set(left.split()), set(right.split())
            shared, distinct = a & b, (a & b) - tt.GENERIC_TITLE_WORDS
            cont, jac = len(shared) / min(len(a), len(b)), len(shared) / len(a | b)
            score = max(SequenceMatcher(None, left, right).ratio(), 0.55 * cont + 0.45 * jac)
            for phrase, floor in tt.PHRASE_FLOORS:
                if phrase in left and phrase in right:
                    score = max(score, floor)
                    break
            if all(x in left and x in right for x in ("private limited", "registration")):
                score = max(score, 0.95)
            if min(len(a), len(b)) >= 2 and cont == 1 and distinct:
                score = max(score, 0.88)
            score = min(round(score, 4), 1)
            if score >= 0.90 or (score >= 0.82 and len(distinct) >= 2):
                action = "UPDATE"
            elif score >= 0.72:
                action = "MERGE_REVIEW"
            else:
                action = "CREATE"
            key, entry = (score, len(distinct), cont, 0), (action, sid if action != "CREATE" else None, score)
        if best is None or key > best[0]:
            best = (key, entry)
    return best[1]


@pytest.mark.parametrize("block", [50_000, 3])
def test_resolution_equals_brute_force(spark, block):
    cat = spark.createDataFrame(CATALOGUE, "id bigint, title string")
    inc = spark.createDataFrame([(t,) for t in INCOMING], "title string")
    canon = {r["title"]: r["c"] for r in inc.union(cat.select("title")).select("title", tt.canonical_title("title").alias("c")).collect()}
    order = sorted(CATALOGUE, key=lambda x: (x[1], x[0]))
    got = {r["title"]: (r["action"], r["matched_service_id"], round(r["score"], 4)) for r in rs.resolve_titles(inc, cat, block).collect()}
    for title in INCOMING:
        assert got[title] == model(title, [(i, t, canon[title], canon[t]) for i, t in order]), title


def sheet(spark, rows, name="S"):
    data = [("f", name, i, r, [None] * len(r)) for i, r in enumerate(rows, 1) if any(r)]
    return spark.createDataFrame(data, "file string, sheet string, row_no int, values array<string>, links array<string>")


KINDS = [
    ("STRUCTURED_TABLE", [["List", "", ""], ["Scheme Name", "Benefits", "Last Date"], ["A", "b", "c"]]),
    ("COMMERCIAL_SERVICE_TABLE", [["Service", "Vendor Cost", "Our fee"]] + [[f"S{i}", "10", ""] for i in range(6)]),
    ("COMMUNICATION", [["Subject: offer"], ["Dear sir"], ["please see the attached email"], ["Regards"]]),
    ("REFERENCE_TABLE", [["Sr No", "Benefit"], ["1", "x"], ["2", "y"]]),
    ("COMPARISON_MATRIX", [["Programme", "Alpha", "Beta", "Gamma"], ["a", "b", "c", "d"]]),
    ("NARRATIVE_KNOWLEDGE", [["Something about documents required for an applicant of the plan"], ["how to file in a very long sentence about nothing"], ["objectives"]]),
    ("UNKNOWN", [["zzz"], ["yyy"]]),
]


def test_unmatched_titles_are_dealt_over_tasks(spark, monkeypatch):
    """The titles that are compared with the catalogue must not be merged into one task, however small they are."""
    best = rs._best_in_block
    monkeypatch.setattr(rs, "_best_in_block", lambda left, block: parts.append(left.select(F.spark_partition_id()).distinct().count()) or best(left, block))
    parts, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        incoming = spark.createDataFrame([(f"matter {i}",) for i in range(200)], "title string")
        catalogue = spark.createDataFrame([(1, "Matter 300"), (2, "Seed fund")], "id bigint, title string")
        assert rs.resolve_titles(incoming, catalogue).count() == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert parts[0] > 4


def test_many_common_subsequences():
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abc 1") for _ in range(n))
    values = ["", "a", "a" * 70, *(word(rnd.randint(1, 80)) for _ in range(60))]
    for left in ["a", "b" * 64, *(word(rnd.randint(1, 64)) for _ in range(30))]:
        masks = {c: sum(1 << i for i, x in enumerate(left) if x == c) for c in left}
        want = [rs.common_subsequence(left, masks, v) for v in values]
        assert rs.common_subsequences(left, rs._codes(values)).tolist() == want
    # letters beyond the alphabet may only raise the bound
    assert rs.common_subsequences("\u00e4\u00f6", rs._codes(["\u00e4\u00f6"])).tolist() == [2]


@pytest.mark.parametrize("kind,rows", KINDS, ids=[k for k, _ in KINDS])
def test_sheet_kinds(spark, kind, rows):
    df = sheet(spark, rows)
    assert ing.sheet_kinds(df, ing.detect_headers(df)).first()["kind"] == kind


def test_candidates_of_a_table(spark):
    rows = sheet(spark, [["Scheme Name", "Benefits", "Portal Link"], ["GST Registration", "Income tax relief", "https://a.b/c"], ["", "no title", ""], ["Brand new loan scheme", "", ""]])
    cat = spark.createDataFrame(CATALOGUE, "id bigint, title string")
    cats = spark.createDataFrame([("gst-and-tax-compliance",), ("credit-and-guarantee-schemes",)], "slug string")
    got = {r["title"]: r for r in ing.analyse(rows, cat, cats)["candidates"].collect()}
    assert set(got) == {"GST Registration", "Brand new loan scheme"}
    assert got["GST Registration"]["match"]["action"] == "UPDATE" and got["GST Registration"]["match"]["matched_service_id"] == 6
    assert got["GST Registration"]["proposal"]["category_slug"] == "gst-and-tax-compliance"
    assert got["Brand new loan scheme"]["match"]["action"] == "CREATE"


def test_headerless_row(spark):
    rows = sheet(spark, [["1", "GST Registration", "Grant of 5 lakh", "Applicant must have a license", "more\nlines"]])
    cat = spark.createDataFrame(CATALOGUE, "id bigint, title string")
    row = ing.headerless_candidates(rows, cat, []).first()
    assert row["title"] == "GST Registration"
    assert row["fields"]["benefits"] == "Grant of 5 lakh" and row["fields"]["eligibility"] == "Applicant must have a license"
    assert row["fields"]["additional_info"] == "1\nmore\nlines"


def test_narrative_sections_and_subject(spark):
    rows = sheet(spark, [["LLP Incorporation"], ["Benefits:"], ["Low cost"], ["*Documents required*"], ["PAN card"]], "LLP")
    sec = {r["content"]: r["section_type"] for r in ing.narrative_sections(rows, 2).collect()}
    assert sec["Low cost"] == "BENEFITS" and sec["PAN card"] == "DOCUMENTS"
    cat = spark.createDataFrame(CATALOGUE, "id bigint, title string")
    c = ing.narrative_candidates(ing.narrative_sections(rows), cat, []).first()
    assert c["match"]["action"] == "UPDATE" and c["match"]["matched_service_id"] == 3


def test_staging_keeps_every_row_and_rejects_twins(spark):
    rows = sheet(spark, [["a"], ["b"]])
    cand = spark.createDataFrame([("f", "S", 2, "T", ("UPDATE", 77))], "file string, sheet string, source_row int, title string, match struct<action:string,matched_service_id:bigint>").withColumn("proposal", F.lit("x"))
    svc = spark.createDataFrame([(1,)], "id bigint")
    got = {r["row_no"]: (r["candidate_action"], r["validation_status"]) for r in ing.stage_rows(rows, cand, svc, 5).collect()}
    assert got == {1: ("UNDECIDED", "PENDING"), 2: ("MERGE_REVIEW", "WARNING")}
    with pytest.raises(ValueError):
        ing.stage_rows(rows, cand.union(cand), svc, 5)


# --- files ------------------------------------------------------------------------------------
@pytest.mark.parametrize("raw,want", [
    ("\ufeffName;Fee\nÄ;1\nB;2\n;\n".encode("utf-8"), [["Name", "Fee"], ["Ä", "1"], ["B", "2"]]),
    ("Name\tFee\nÄ\t1\n".encode("cp1252"), [["Name", "Fee"], ["Ä", "1"]]),
    (b"a|b\n1|2\n", [["a", "b"], ["1", "2"]]),
    (b'a,b\n"x, y",2\n', [["a", "b"], ["x, y", "2"]]),
])
def test_csv_dialects(raw, want):
    assert [v for _, _, v, _ in fs.csv_rows(raw)] == want


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook(extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PKG}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Scheme Name</t></si><si><r><t>Two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'<Relationships xmlns="{PKG}"><Relationship Id="rId9" Target="https://a.b/c" TargetMode="External"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'''<worksheet {NS}><sheetData>
          <row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Fee</t></is></c></row><row r="2"/>
          <row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>45458</v></c><c r="C3"><v>12.5</v></c><c r="D3"><f>A1</f></c><c r="E3" t="b"><v>1</v></c></row>
          </sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells><hyperlinks><hyperlink ref="A3" r:id="rId9"/></hyperlinks></worksheet>''')
        for name in extra:
            z.writestr(name, "x")
    return out.getvalue()


def test_workbook_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.xlsx").write_bytes(workbook(["xl/vbaProject.bin"]))
    (tmp_path / "c.xlsx").write_bytes(workbook(["../evil.txt"]))
    (tmp_path / "d.xlsx").write_bytes(b"no archive")
    files = fs.binary_files(spark, str(tmp_path), "*.xlsx")
    verdicts = {r["file"][-6:]: r["verdict"] for r in fs.workbook_audit(files).collect()}
    assert verdicts == {"a.xlsx": "ok", "b.xlsx": "contains macros", "c.xlsx": "unsafe path", "d.xlsx": "not a workbook archive"}
    rows = {r["row_no"]: r for r in fs.sheet_rows(files.where("path LIKE '%a.xlsx'")).collect()}
    assert list(rows[1]["values"]) == ["Scheme Name", "", "Fee"] and set(rows) == {1, 3}
    assert list(rows[3]["values"]) == ["Two runs", "2024-06-15T00:00:00", "12.5", "=A1", "True"]
    assert rows[3]["links"][0] == "https://a.b/c" and rows[3]["merged"] == 1
    total = [r for r in ing.census(fs.sheet_rows(files.where("path LIKE '%a.xlsx'"))).collect() if r["file"] is None][0]
    assert (total["cells"], total["links"], total["formulas"]) == (7, 1, 1)


def test_flyers(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"junk%PDF-1.7 ...")
    (tmp_path / "bad.png").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "pic.JPG").write_bytes(b"\xff\xd8\xff\xe0")
    got = {r["clean_name"]: (r["kind"], r["signature_ok"]) for r in fs.flyer_inventory(fs.binary_files(spark, str(tmp_path))).collect()}
    assert got == {"good.pdf": ("PDF", True), "bad.png": ("IMAGE", False), "pic.jpg": ("IMAGE", True)}


def test_sheet_rows_are_numbered_block_by_block(spark, tmp_path, monkeypatch):
    import re

    from lodestar.plans import views

    spark.createDataFrame([(i, f"part {i}", i % 7, "brand") for i in range(40)], "p_partkey bigint, p_name string, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, f"text {i}", f"s{i % 2}") for i in range(30)] + [(None, "no id", "s1")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(views, "SHEET_IDS", 3)
    got = views.view(spark, str(tmp_path), "v_sheet")
    sql, tables = views.VIEW_SQL["v_sheet"]
    want = spark.sql(views._dialect(sql, True), **{t: views.table(spark, str(tmp_path), t) for t in tables})
    assert got.schema.simpleString() == want.schema.simpleString()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want)
    # no task sorts all rows of a sheet
    whole = r"windowspecdefinition\(sheet#\d+, ord#"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(whole, plan(want)) and not re.search(whole, plan(got))
