"""Bulk file sources: every file of a folder is one task row, parsed where it is read."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import sys
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_SCHEMA = "file string, sha256 string, sheet string, row_no int, values array<string>, links array<string>, merged int"
_BATCH = 2_000
DELIMITERS = ",;\t|"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )


def fingerprints(files: DataFrame) -> DataFrame:
    """SHA-256 of each file's bytes."""
    return files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), "length")


# --- CSV --------------------------------------------------------------------------------------
def delimiter_of(body: str) -> str:
    """The delimiter that most lines of the whole file hold, then the most frequent one; a comma if there is none."""
    lines = dict.fromkeys(DELIMITERS, 0)
    for line in io.StringIO(body):
        for d in DELIMITERS:
            lines[d] += d in line
    return max(DELIMITERS, key=lambda d: (lines[d], body.count(d)))


def csv_rows(raw: bytes) -> Iterator[tuple[str, int, list[str], list[None]]]:
    """Non-blank rows of one delimited file of unknown encoding and delimiter."""
    try:
        body = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        body = raw.decode("cp1252")
    csv.field_size_limit(sys.maxsize)  # a cell may be as long as the file
    for number, row in enumerate(csv.reader(io.StringIO(body), delimiter=delimiter_of(body)), 1):
        if any(v.strip() for v in row):
            yield "CSV", number, row, [None] * len(row)


# --- XLSX ---------------------------------------------------------------------------------------
def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n


def _rels(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in book.namelist():
        return {}
    found = {}
    for node in ElementTree.fromstring(book.read(path)):
        target = node.get("Target", "")
        if node.get("TargetMode") != "External":
            target = posixpath.normpath(posixpath.join("/" + folder, target)).lstrip("/")
        found[node.get("Id")] = target
    return found


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.findall(f"{_MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell style numbers that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(n.get("numFmtId")) for n in root.iter(f"{_MAIN}numFmt")
        if re.search(r"[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", n.get("formatCode", "")), re.I)
    }
    dates = custom | set(range(14, 23)) | {45, 46, 47}
    formats = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in dates}


def _cell_text(cell, shared: list[str], dates: set[int]) -> str:
    formula = cell.find(f"{_MAIN}f")
    if formula is not None:
        return "=" + (formula.text or "")
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    node = cell.find(f"{_MAIN}v")
    raw = "" if node is None else node.text or ""
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if raw and kind in (None, "n"):
        if int(cell.get("s", 0)) in dates:
            return (datetime(1899, 12, 30) + timedelta(days=float(raw))).isoformat()
        number = float(raw)
        return str(int(number)) if number.is_integer() and "." not in raw and "E" not in raw.upper() else str(number)
    return raw


def xlsx_rows(raw: bytes) -> Iterator[tuple[str, int, list[str], list[str | None]]]:
    """Non-empty rows of every sheet: values without trailing blanks, and cell hyperlinks."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared, dates = _shared_strings(book), _date_styles(book)
        targets = _rels(book, "xl/workbook.xml")
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            part = targets[sheet.get(f"{_REL}id")]
            outside = _rels(book, part)
            root = ElementTree.fromstring(book.read(part))
            links = {}
            for h in root.iter(f"{_MAIN}hyperlink"):
                links[h.get("ref", "").split(":")[0]] = outside.get(h.get(f"{_REL}id")) or h.get("location")
            linked: dict[int, list[int]] = {}
            for ref in links:
                linked.setdefault(int(re.search(r"\d+", ref).group()), []).append(_column(ref))
            merged = len(list(root.iter(f"{_MAIN}mergeCell")))
            for row in root.iter(f"{_MAIN}row"):
                number = int(row.get("r"))
                values: dict[int, str] = {}
                for cell in row.findall(f"{_MAIN}c"):
                    values[_column(cell.get("r"))] = _cell_text(cell, shared, dates)
                filled = [c for c, v in values.items() if v.strip()] + [c for c in linked.get(number, ())]
                if filled:
                    width = max(filled)
                    yield (
                        sheet.get("name"), number, [values.get(c, "") for c in range(1, width + 1)],
                        [links.get(f"{_letters(c)}{number}") for c in range(1, width + 1)], merged,
                    )


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_rows(files: DataFrame) -> DataFrame:
    """Rows of all ``.csv`` and ``.xlsx`` files with the file's path and fingerprint."""
    named = files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "sha256", "sheet", "row_no", "values", "links", "merged"]
        for batch in batches:
            for file, sha, raw in batch.itertuples(index=False, name=None):
                reader = xlsx_rows if file.lower().endswith(".xlsx") else csv_rows
                out = []
                for sheet, number, values, links, *merged in reader(bytes(raw)):
                    out.append((file, sha, sheet, number, values, links, merged[0] if merged else 0))
                    if len(out) == _BATCH:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=columns)

    return named.mapInPandas(parse, ROW_SCHEMA)


# --- audits -----------------------------------------------------------------------------------
#: fixed values: limits and required parts of a safe workbook archive
MAX_EXPANDED, MAX_RATIO = 250 * 1024 * 1024, 200
REQUIRED_PARTS = ("[Content_Types].xml", "xl/workbook.xml")
AUDIT_SCHEMA = "file string, verdict string"


def _archive_verdict(raw: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as book:
            entries = book.infolist()
    except zipfile.BadZipFile:
        return "not a workbook archive"
    names = {e.filename for e in entries}
    if any(p not in names for p in REQUIRED_PARTS):
        return "required part missing"
    if any("vbaproject" in n.lower() for n in names):
        return "contains macros"
    if any(n.startswith("/") or ".." in n.replace("\\", "/").split("/") for n in names):
        return "unsafe path"
    if any(e.flag_bits & 1 for e in entries):
        return "encrypted"
    expanded, packed = sum(e.file_size for e in entries), sum(e.compress_size for e in entries)
    if expanded > MAX_EXPANDED:
        return "expands too far"
    if packed and expanded / packed > MAX_RATIO:
        return "compression ratio too high"
    return "ok"


def workbook_audit(files: DataFrame) -> DataFrame:
    """One safety verdict per workbook file; only archive directories are read, nothing unpacks."""

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file": batch["path"], "verdict": [_archive_verdict(bytes(b)) for b in batch["content"]]})

    return files.select("path", "content").mapInPandas(audit, AUDIT_SCHEMA)


#: fixed values: flyer file types and the size limit
FLYER_TYPES = {
    "pdf": ("PDF", "application/pdf"),
    "png": ("IMAGE", "image/png"),
    "jpg": ("IMAGE", "image/jpeg"),
    "jpeg": ("IMAGE", "image/jpeg"),
}
MAX_FLYER = 20 * 1024 * 1024


def flyer_inventory(files: DataFrame) -> DataFrame:
    """Kind, type, signature check, size check, hash and clean name of every flyer file."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 1024))
    kinds = F.create_map(*[F.lit(x) for k, v in FLYER_TYPES.items() for x in (k, v[0])])
    mimes = F.create_map(*[F.lit(x) for k, v in FLYER_TYPES.items() for x in (k, v[1])])
    signed = (
        F.when(ext == "pdf", F.regexp_like(head, F.lit("^(..)*255044462D")))
        .when(ext == "png", head.startswith("89504E470D0A1A0A"))
        .when(ext.isin("jpg", "jpeg"), head.startswith("FFD8FF"))
        .otherwise(False)
    )
    bare = F.trim(F.regexp_replace(name, r"[\x00-\x1f\x7f]+", ""))
    stem = F.regexp_replace(F.substring(F.regexp_replace(bare, r"\.[^.]*$", ""), 1, 220), r"[ .]+$", "")
    clean = F.concat(F.when(stem == "", F.lit("scheme-flyer")).otherwise(stem), F.lit("."), ext)
    return files.select(
        F.col("path").alias("file"), clean.alias("clean_name"), F.try_element_at(kinds, ext).alias("kind"),
        F.try_element_at(mimes, ext).alias("mime"), signed.alias("signature_ok"),
        F.col("length").between(1, MAX_FLYER).alias("size_ok"), F.sha2("content", 256).alias("sha256"),
    )
