"""Side-by-side check: every registered query against its SQL on the same parquet files."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) if value != int(value) else int(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, key, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    secs = time.time() - start
    if sql is None:
        return secs, len(got[1]), None
    t1 = time.time()
    cur = con.execute(sql)
    want = canon([d[0] for d in cur.description], cur.fetchall())
    osecs = time.time() - t1
    if got[0] != want[0]:
        return secs, len(got[1]), f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        return secs, len(got[1]), f"rows {len(got[1])} vs {len(want[1])}; spark-only {extra}; sql-only {missing}"
    return secs, len(got[1]), f"ok (sql {osecs:.1f}s)"


def main(argv):
    import __spark_entry__ as entry
    from lodestar.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir = argv.pop(0)
    spark = build_session(master="local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = [k for k in queries if not argv or any(k == a or k.startswith(a + "_") or (a.endswith("*") and k.startswith(a[:-1])) for a in argv)]
    bad = 0
    for key in wanted:
        try:
            secs, n, verdict = compare(spark, con, key, queries[key], sqls.get(key), sf_dir)
        except Exception as exc:  # report and go on
            secs, n, verdict = 0.0, -1, f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        flag = "--" if verdict is None else ("OK" if verdict.startswith("ok") else "XX")
        bad += flag == "XX"
        print(f"{flag} {key:40s} rows={n:<7d} {secs:6.2f}s {verdict or 'rows only'}"[:1800], flush=True)
    print(f"{len(wanted)} run, {bad} bad, {sum(k not in sqls for k in wanted)} without sql")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(1 if main(sys.argv[1:]) else 0)
