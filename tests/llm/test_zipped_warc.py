import gzip
import hashlib
import io
import zipfile
import zlib

import pytest

from lodestar.llm import zipped_warc as zw
from lodestar.llm.common import Scratch

from .hard import by_id

PAGES = "page_id bigint, url string, html string, row_key int, refers_to string, archive string, _same int"
BIG, OTHER = "<p>" + "é" * 600 + "</p>", "<p>" + "x" * 2_000 + "</p>"
ROWS = [
    (1, "https://a/1", BIG), (2, "https://a/2", BIG), (5, None, BIG), (3, "https://b/1\r\nX: y z", OTHER), (3, "https://b/1", OTHER), (4, "https://b/2", "short"),
    (6, "https://b/2", "short"), (7, "https://c", None), (8, "", ""), (None, "https://n", OTHER), (9, "https://q", "\x00\r\n\r\nWARC/1.1\r\n" * 300), (None, "u", "z" * 1_500),
    (None, "u", "z" * 1_500), (10, "https://é.example/ü?q=ä", "y" * 999), (11, "v", "y" * 999), (12, "long", "w" * 3_000_000),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "z", "a", 2) for r in rows], PAGES)


def expected(rows):
    """(page, bytes, digest, type, refers to) by comparing all payloads."""
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = [j for j, _, other in rows if (other or "").encode() == raw and j is not None]
        to = max(ids) if ids and i is not None and len(raw) >= 1000 and i < max(ids) else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def digests(df):
    return sorted(((r["row_key"] and int(r["row_key"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to_key"] and int(r["refers_to_key"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("share", [0, 2, 1_000])
def test_round_trip(spark, monkeypatch, share):
    monkeypatch.setattr(zw, "HOT_SHARE", share)  # no group, large groups, all groups are looked up in the task
    manifest = zw.write_pages(pages(spark).repartition(3), Scratch(spark, "warc"), archive_records=4)
    read = zw.read_records(manifest, payload=True)
    assert digests(read) == expected(ROWS)
    rows = read.collect()
    assert sum(r["n_records"] for r in manifest.collect()) == len(ROWS) and manifest.agg({"n_records": "max"}).first()[0] <= 4
    texts = by_id(read, "row_key")
    for i, _, html in ROWS:
        if i is not None:
            for r in texts[str(i)]:
                assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == (html or "").encode()
    assert all(r["verified"] is (None if r["record_type"] == "revisit" else True) for r in rows)
    uris = {r["target_uri"] for r in rows}
    assert None in uris and "https://b/1%0D%0AX:%20y%20z" in uris and "https://é.example/ü?q=ä" in uris


def test_empty_table(spark):
    manifest = zw.write_pages(pages(spark, ROWS[:1]).limit(0), Scratch(spark, "warc"))
    assert manifest.count() == 0 and zw.read_records(manifest).count() == 0


def test_archives_are_plain_zip_and_gzip(spark, tmp_path):
    row = zw.write_pages(pages(spark).coalesce(1), Scratch(spark, "warc")).first()
    path = zw.store(row["archive"])[1]
    with zipfile.ZipFile(path) as whole:
        assert whole.testzip() is None and whole.namelist() == [zw.RECORDS, zw.INDEX]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in whole.infolist())
        records = gzip.decompress(whole.read(zw.RECORDS))
        lines = whole.read(zw.INDEX).decode().splitlines()
    assert records.count(b"WARC-Type: re") == len(ROWS) == len(lines) and lines == sorted(lines)


def written(tmp_path, name, make):
    path = tmp_path / name
    with zipfile.ZipFile(path, "w") as out:
        make(out)
    return str(path)


def plain(n, pack=lambda x: x):
    raw = [zw.record("response", str(i), "u", "t" * i, "d", None, hashlib.sha1(b"t" * i).digest()) for i in range(n)]
    return b"".join(pack(r) for r in raw)


def test_other_archives(spark, tmp_path):
    """Archives of another writer: with ZIP64 fields, without an index, not packed by record, with other members and a note."""

    def wide(out):
        out.comment = b"PK\x05\x06 a note that looks like an end" * 3
        out.writestr("pages/pages.jsonl", "{}", compress_type=zipfile.ZIP_DEFLATED)
        for name, data in (("archive/one.warc", plain(7)), ("archive/two.warc.gz", plain(9, gzip.compress))):
            with out.open(name, "w", force_zip64=True) as member:
                member.write(data)

    uri = written(tmp_path, "other.wacz", wide)
    read = zw.read_records(spark.createDataFrame([(uri,)], "archive string"), payload=True)
    assert sorted(len(r["payload"]) for r in read.collect()) == sorted([*range(7), *range(9)])
    with open(uri, "rb") as source, open(tmp_path / "moved.wacz", "wb") as target:
        target.write(b"#!/bin/sh\n" + source.read())
    assert len(list(zw.places(str(tmp_path / "moved.wacz")))) == 16


@pytest.mark.parametrize("full", [(zw.FULL32, zw.FULL16), (40, zw.FULL16), (zw.FULL32, 2), (1, 1)])
def test_directories_with_wide_fields(full):
    out = io.BytesIO()
    archive = zw.StoredZip(out, *full)
    data = {"a": b"x" * 100, "b/ü": b"", "c": b"PK\x05\x06" * 40}
    for name, raw in data.items():
        archive.begin(name)
        archive.write(raw[:50])
        archive.write(raw[50:])
        archive.end()
    archive.close()
    raw = out.getvalue()
    read_at = lambda at, n: raw[at : at + n]
    found = {m.name: raw[m.begins(read_at) : m.begins(read_at) + m.size] for m in zw.members(read_at, len(raw))}
    assert found == data
    with zipfile.ZipFile(io.BytesIO(raw)) as whole:
        assert {n: whole.read(n) for n in whole.namelist()} == data


def test_sizes_beyond_32_bits():
    """A directory that lists 5 GiB of members and 70,000 entries; only the bytes around its ends exist."""
    archive = zw.StoredZip(io.BytesIO())
    at = 5 << 30
    archive.at = at
    archive.entries = [(b"m%d" % i, (i * 80_000), 0, 5 << 30 if i == 69_999 else 10) for i in range(70_000)]
    archive.close()
    raw = archive.out.getvalue()
    found = list(zw.members(lambda o, n: raw[o - at : o - at + n], at + len(raw)))
    assert len(found) == 70_000 and found[-1].size == 5 << 30 and found[-1].header == 69_999 * 80_000


def test_broken_archives_are_refused(spark, tmp_path):
    packed = written(tmp_path, "packed.wacz", lambda out: out.writestr("archive/a.warc", plain(3), compress_type=zipfile.ZIP_DEFLATED))
    with pytest.raises(ValueError, match="compressed"):
        list(zw.places(packed))
    good = written(tmp_path, "good.wacz", lambda out: out.writestr("archive/a.warc", plain(3)))
    whole = open(good, "rb").read()
    for cut in (0, 10, len(whole) // 2, len(whole) - 5):
        (tmp_path / "cut.wacz").write_bytes(whole[:cut])
        with pytest.raises(ValueError):
            list(zw.places(str(tmp_path / "cut.wacz")))
    with pytest.raises(ValueError, match="not a WARC"):
        zw.parse(b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(ValueError, match="cut"):
        zw.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")
    with pytest.raises(zlib.error):
        zlib.decompress(b"\x1f\x8bxx", 31)
