"""Streaming twins of the log computations: windowed counts, lockout detection, file pickup."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.analytics import retention_split
from ..operators.windows import carry_forward, previous_in_group
from ..session import spread
from ..sources.files import sheet_rows
from ..sources.snapshots import Files

#: fixed values: failures that lock, and seconds from the first failure until they expire
MAX_FAILURES, LOCK_SECONDS = 5, 900


# --- R1: windowed counts -------------------------------------------------------------------------
def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per time window and action; rows later than the watermark are dropped."""
    return (
        events.withWatermark("created_at", late)
        .groupBy(F.window("created_at", size).alias("w"), "action")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "action", "n")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and stop; appends finished rows to a parquet table."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


# --- R2: lockout detection -----------------------------------------------------------------------
LOCK_SCHEMA = "lock_key string, locked_at timestamp, expires_at timestamp"


def login_keys(logins: DataFrame) -> DataFrame:
    """One row per counter an attempt touches: the account and the address.

    ``logins`` is ``(username, ip_address, created_at, success)``.
    """
    name = F.lower(F.trim(F.coalesce("username", F.lit(""))))
    keys = F.array_compact(F.array(
        F.when(name != "", F.concat(F.lit("user:"), name)),
        F.when(F.coalesce("ip_address", F.lit("")) != "", F.concat(F.lit("ip:"), "ip_address")),
    ))
    return logins.select(F.explode(keys).alias("lock_key"), F.col("created_at").cast("timestamp").alias("ts"), "success")


def _step(start, count, ts, success):
    """Counter after one attempt: ``(start, count, locked_now)``. Success clears the counter,
    the first failure starts its life time, later ones do not prolong it."""
    if success:
        return None, 0, False
    if start is None or (ts - start).total_seconds() >= LOCK_SECONDS:
        return ts, 1, MAX_FAILURES == 1
    return start, count + 1, count + 1 == MAX_FAILURES


def _lock_row(key, ts, start):
    return key, ts, start + pd.Timedelta(seconds=LOCK_SECONDS)


def detect_lockouts(logins: DataFrame, block: str = "day") -> DataFrame:
    """Batch detection of the moments a counter reaches its limit.

    Attempts after a success, or after a pause as long as a counter lives, depend on nothing
    earlier. Such stretches are split over tasks and read in order as a stream of batches, so
    even one very busy key is not gathered in memory.
    """
    rows = login_keys(logins).withColumn("stamp", F.struct("ts", (~F.col("success")).alias("failed")))
    part = F.date_trunc(block, "ts")
    rows = previous_in_group(rows, ["lock_key"], part, ["ts", "success"], "stamp", "before")
    gap = F.col("ts").cast("double") - F.col("before.ts").cast("double")
    fresh = F.col("before").isNull() | ~F.col("before.failed") | (gap >= LOCK_SECONDS)
    rows = rows.withColumn("opens", F.when(fresh, F.col("ts")))
    rows = carry_forward(rows, ["lock_key"], part, ["ts", "success"], "opens", "stretch")
    parted = spread(rows.select("lock_key", "stretch", "ts", "success"), "lock_key", "stretch")
    ordered = parted.sortWithinPartitions("lock_key", "stretch", "ts", "success")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, count = None, None, 0
        for batch in batches:
            found = []
            for key, stretch, ts, success in batch.itertuples(index=False, name=None):
                if (key, stretch) != current:
                    current, start, count = (key, stretch), None, 0
                start, count, locked = _step(start, count, ts, success)
                if locked:
                    found.append(_lock_row(key, ts, start))
            yield pd.DataFrame(found, columns=["lock_key", "locked_at", "expires_at"])

    return ordered.mapInPandas(scan, LOCK_SCHEMA)


def stream_lockouts(logins: DataFrame, late: str = "15 minutes") -> DataFrame:
    """Streaming detection: one counter per key as state, dropped when its life time is over.

    Attempts inside one micro-batch are taken in time order.
    """
    rows = login_keys(logins).withWatermark("ts", late)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = (None, 0)
        if state.exists:
            micros, count = state.get
            start = pd.Timestamp(micros, unit="us") if micros >= 0 else None
        found = []
        attempts = pd.concat(list(batches)).sort_values(["ts", "success"])
        for ts, success in attempts[["ts", "success"]].itertuples(index=False, name=None):
            start, count, locked = _step(start, count, ts, success)
            if locked:
                found.append(_lock_row(key[0], ts, start))
        if start is None:
            state.remove()
        else:
            state.update((int(start.value // 1000), count))
            expiry = int(start.timestamp() * 1000) + LOCK_SECONDS * 1000
            state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=["lock_key", "locked_at", "expires_at"])

    return rows.groupBy("lock_key").applyInPandasWithState(
        update, LOCK_SCHEMA, "start_us bigint, failures int", "append", GroupStateTimeout.EventTimeTimeout
    )


# --- R3: file pickup -------------------------------------------------------------------------------
def pick_up_files(spark: SparkSession, folder: str, staged: str, checkpoint: str, pattern: str = "*") -> None:
    """Stage the rows of files that are new by content; safe to run again over the same folder.

    Contents taken in are remembered by their hash, one small folder per micro-batch below ``staged``-known, so a batch never reads
    staged rows and a file without rows is known too. A batch that runs again after a failure replaces its own folders.
    """
    known = f"{staged.rstrip('/')}-known"
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", pattern).load(folder)
    )

    def stage(batch: DataFrame, number: int) -> None:
        hashed = batch.withColumn("sha256", F.sha2("content", 256))
        one = hashed.groupBy("sha256").agg(F.min("path").alias("path")).join(hashed, ["sha256", "path"])
        try:
            seen = spark.read.schema("sha256 string, pickup bigint").parquet(known).where(F.col("pickup") != number).select("sha256")
            one = one.join(seen, "sha256", "left_anti")
        except Exception as exc:  # nothing staged yet
            if "PATH_NOT_FOUND" not in str(exc):
                raise

        def put(rows: DataFrame, path: str) -> None:
            rows.withColumn("pickup", F.lit(number).cast("bigint")).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("pickup").parquet(path)

        # rows first: if the second write is lost, the batch runs again and finds its own contents unknown
        put(sheet_rows(one.select("path", "content")), staged)
        put(one.select("sha256"), known)

    query = files.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# --- S12: append to the logs ------------------------------------------------------------------------
def append_events(events: DataFrame, path: str, ts: str = "created_at") -> None:
    """Append log rows, partitioned by day so that reports and retention prune whole days."""
    events.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def retain(spark: SparkSession, path: str, now: dt.datetime, days: int, security_days: int, ts: str = "created_at", action: str | None = "action") -> list:
    """Delete expired rows of a log that lies in days; returns the days that were written anew.

    Days after the shorter window are not read. Of the others only those that hold expired rows are replaced, each as a whole, and
    days without a row left are deleted; all other files stay as they are. A run that was cut short is finished by the next. Rows
    without a time stay.
    """
    log = spark.read.parquet(path)
    expired = F.coalesce(retention_split(now, days, security_days, ts, action), F.lit(False))
    old = log.where(F.col("day") <= F.lit((now - dt.timedelta(days=days)).date()))
    counts = old.groupBy("day").agg(F.count_if(expired).alias("gone"), F.count(F.lit(1)).alias("n")).where("gone > 0").collect()
    changed = [r["day"] for r in counts]
    part = [r["day"] for r in counts if r["gone"] < r["n"]]
    if part:
        old.where(F.col("day").isin(part) & ~expired).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    files = Files(spark)
    for day in set(changed) - set(part):
        files.delete(f"{path.rstrip('/')}/day={day}")
    return sorted(changed)
