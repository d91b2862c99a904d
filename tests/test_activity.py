"""Retention limits, ordered operators in blocks, and lockout detection in batch and stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.operators import analytics as an
from lodestar.operators import windows as win
from lodestar.streaming import activity as ac

NOW = dt.datetime(2024, 6, 15, 12)


def test_retention_boundaries(spark):
    ages = [(1, "SEARCH", 364), (2, "SEARCH", 400), (3, "LOGIN_FAILED", 400), (4, "LOGIN_FAILED", 731), (5, "PERMISSION_DENIED", 729)]
    df = spark.createDataFrame([(i, a, NOW - dt.timedelta(days=d)) for i, a, d in ages], "id int, action string, created_at timestamp")
    gone = {r["id"] for r in df.where(an.retention_split(NOW, 365, 730, "created_at", "action")).collect()}
    assert gone == {2, 4}
    for days, secure in ((0, 730), (365, 100)):
        with pytest.raises(ValueError):
            an.retention_split(NOW, days, secure, "created_at")


def test_date_ranges():
    d = dt.date
    assert an.resolve_range(d(2024, 6, 15)) == (d(2024, 6, 9), d(2024, 6, 15))
    assert an.resolve_range(d(2024, 6, 15), preset="today") == (d(2024, 6, 15),) * 2
    assert an.resolve_range(d(2024, 6, 15), d(2024, 6, 10), d(2024, 6, 1)) == (d(2024, 6, 1), d(2024, 6, 10))
    assert an.resolve_range(d(2024, 6, 15), d(2020, 1, 1), d(2024, 6, 1))[0] == d(2024, 6, 1) - dt.timedelta(days=365)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_do_not_change_results(spark, block):
    rows = [(k, i, i if (i * 7 + k) % 5 == 0 else None) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    part = F.floor(F.col("i") / block)
    seq = {(r["k"], r["i"]): r["seq"] for r in win.group_row_number(df, ["k"], part, ["i"]).collect()}
    assert all(seq[k, i] == i + 1 for k, i, _ in rows)
    prev = {(r["k"], r["i"]): r["p"] for r in win.previous_in_group(df, ["k"], part, ["i"], "i", "p").collect()}
    assert all(prev[k, i] == (i - 1 if i else None) for k, i, _ in rows)
    got = {(r["k"], r["i"]): r["c"] for r in win.carry_forward(df, ["k"], part, ["i"], "v", "c").collect()}
    for k, i, _ in rows:
        past = [v for kk, j, v in rows if kk == k and j <= i and v is not None]
        assert got[k, i] == (past[-1] if past else None)


def attempts():
    t0 = dt.datetime(2024, 1, 1, 23, 50)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [("Bob ", None, at(100 * i), False) for i in range(5)]  # locks at 400
    rows += [("ann", None, at(s), False) for s in (0, 10, 20, 30)] + [("ann", None, at(40), True)] + [("ann", None, at(s), False) for s in (50, 60, 70, 80)]
    rows += [("eve", None, at(s), False) for s in (0, 300, 600, 899, 900, 1000, 1100, 1200, 1799)]  # the life time restarts at 900
    rows += [(f"u{i}", "1.2.3.4", at(2000 + i), False) for i in range(6)]  # one address, many accounts
    return rows, at


def test_lockouts_batch_and_stream(spark, tmp_path):
    rows, at = attempts()
    want = {("user:bob", at(400)), ("user:eve", at(1799)), ("ip:1.2.3.4", at(2004))}
    schema = "username string, ip_address string, created_at timestamp, success boolean"
    df = spark.createDataFrame(rows, schema)
    for block in ("day", "minute"):
        assert {(r["lock_key"], r["locked_at"]) for r in ac.detect_lockouts(df, block).collect()} == want
    src = str(tmp_path / "in")
    cut = at(950)
    df.where(F.col("created_at") < F.lit(cut)).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    ac.run_to_table(ac.stream_lockouts(stream), out, ckpt)
    df.where(F.col("created_at") >= F.lit(cut)).coalesce(1).write.mode("append").parquet(src)
    ac.run_to_table(ac.stream_lockouts(stream), out, ckpt)
    got = {(r["lock_key"], r["locked_at"]) for r in spark.read.schema(ac.LOCK_SCHEMA).parquet(out).collect()}
    assert got == want


def test_file_pickup_skips_known_content(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.csv").write_text("x,y\n1,2\n")
    staged, ckpt = str(tmp_path / "staged"), str(tmp_path / "ckpt")
    ac.pick_up_files(spark, str(inbox), staged, ckpt)
    (inbox / "copy.csv").write_text("x,y\n1,2\n")
    (inbox / "b.csv").write_text("x,y\n3,4\n")
    ac.pick_up_files(spark, str(inbox), staged, ckpt)
    got = sorted(tuple(r["values"]) for r in spark.read.parquet(staged).collect())
    assert got == [("1", "2"), ("3", "4"), ("x", "y"), ("x", "y")]


def test_pickup_knows_files_without_rows_and_reads_no_staged_rows(spark, tmp_path):
    inbox, staged, ckpt = tmp_path / "inbox", str(tmp_path / "staged"), str(tmp_path / "ckpt")
    inbox.mkdir()
    (inbox / "blank.csv").write_text(" \n")
    (inbox / "a.csv").write_text("x\n")
    ac.pick_up_files(spark, str(inbox), staged, ckpt)
    known = spark.read.parquet(f"{staged}-known")
    assert known.count() == known.select("sha256").distinct().count() == 2
    for path in (tmp_path / "staged").rglob("*.parquet"):  # staged rows may be moved on; what was taken in stays known
        path.unlink()
    (inbox / "again.csv").write_text("x\n")
    (inbox / "blank2.csv").write_text(" \n")
    ac.pick_up_files(spark, str(inbox), staged, ckpt)
    assert known.count() == 2 and not [p for p in (tmp_path / "staged").rglob("*.parquet") if spark.read.parquet(str(p)).count()]


def test_retention_replaces_only_days_with_expired_rows(spark, tmp_path):
    rows = [(i, "SEARCH" if i % 3 else "LOGIN_FAILED", NOW - dt.timedelta(days=i // 2, hours=i % 5)) for i in range(80)] + [(99, "SEARCH", None)]
    df = spark.createDataFrame(rows, "id int, action string, created_at timestamp")
    path = str(tmp_path / "log")
    ac.append_events(df, path)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*.parquet")}
    before = files()
    days = ac.retain(spark, path, NOW, 20, 30)
    kept = {r["id"] for r in spark.read.parquet(path).collect()}
    want = {i for i, a, t in rows if t is None or t >= NOW - dt.timedelta(days=20 if a == "SEARCH" else 30)}
    assert kept == want
    changed = {f"day={d}" for d in days}
    assert {p: t for p, t in before.items() if p.parent.name not in changed}.items() <= files().items()
    assert days and all(d <= (NOW - dt.timedelta(days=20)).date() for d in days)
    gone = {f"day={t.date()}" for _, _, t in rows if t} - {f"day={t.date()}" for i, _, t in rows if t and i in want}
    assert gone and not any((tmp_path / "log" / d).exists() for d in gone)
    assert ac.retain(spark, path, NOW, 20, 30) == []
