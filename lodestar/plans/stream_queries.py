"""Streaming operators run to completion over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources import files as fs
from ..streaming import activity as ac
from .registry import Registry


def _folder(v, name: str) -> str:
    return f"{scratch_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def table_stream(spark, sf_dir: str, name: str):
    """A supplied table as a file stream, whether it is one file or a folder of part files."""
    path = f"{sf_dir}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getFileStatus(place).isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def event_stream(v):
    """The events table as a file stream."""
    raw = table_stream(v.spark, v.sf_dir, "events")
    return raw.select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("action"), "user_id", "event_id")


def logins(events):
    """Login attempts: errors are failures, sign-ups succeed. Few accounts and time run sixty
    times faster bring the attempts close enough together to lock."""
    events = events.withColumn("created_at", F.timestamp_micros(F.floor(F.unix_micros("created_at") / 60).cast("bigint")))
    return events.where("action IN ('error', 'signup')").select(
        F.concat(F.lit("user"), (F.col("user_id") % 3).cast("string")).alias("username"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 5).cast("string")).alias("ip_address"), "created_at",
        (F.col("action") == "signup").alias("success"),
    )


LOGIN_SQL = """WITH RECURSIVE lg0 AS (SELECT unnest(['user:user' || (user_id % 3), 'ip:10.0.0.' || (user_id % 5)]) AS lock_key, make_timestamp(epoch_us(ts) // 60) AS ts, event_type = 'signup' AS success FROM events WHERE event_type IN ('error', 'signup')),
  lg AS (SELECT *, row_number() OVER (PARTITION BY lock_key ORDER BY ts, success) AS rn FROM lg0),
  r AS (SELECT DISTINCT lock_key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS start, 0 AS cnt, CAST(NULL AS TIMESTAMP) AS ts FROM lg0
   UNION ALL SELECT l.lock_key, l.rn, CASE WHEN l.success THEN NULL WHEN r.start IS NULL OR l.ts >= r.start + INTERVAL 900 SECOND THEN l.ts ELSE r.start END,
     CASE WHEN l.success THEN 0 WHEN r.start IS NULL OR l.ts >= r.start + INTERVAL 900 SECOND THEN 1 ELSE r.cnt + 1 END, l.ts FROM r JOIN lg l ON l.lock_key = r.lock_key AND l.rn = r.rn + 1)
  SELECT lock_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS locked_at FROM r WHERE cnt = 5"""


def shown(locks):
    return locks.select("lock_key", F.date_format("locked_at", "yyyy-MM-dd HH:mm:ss").alias("locked_at"))


def register(reg: Registry) -> None:
    @reg.add("R1_windowed_counts", "", """WITH m AS (SELECT max(ts) AS top FROM events) SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS action, count(*) AS n FROM events, m
      WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= top - INTERVAL 1 HOUR GROUP BY 1, 2""")
    def _(v):
        out = _folder(v, "r1")
        ac.run_to_table(ac.windowed_counts(event_stream(v)), out, _folder(v, "r1-checkpoint"))
        return v.spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "action", "n")

    @reg.add("R2_lockouts_batch", "", LOGIN_SQL)
    def _(v):
        ev = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("action"), "user_id")
        return shown(ac.detect_lockouts(logins(ev)))

    @reg.add("R2_lockouts_stream", "", LOGIN_SQL)
    def _(v):
        out = _folder(v, "r2")
        ac.run_to_table(ac.stream_lockouts(logins(event_stream(v))), out, _folder(v, "r2-checkpoint"))
        return shown(v.spark.read.schema(ac.LOCK_SCHEMA).parquet(out))

    @reg.add("R3_file_pickup", "v_service", "SELECT id || '' AS id, title FROM v_service")
    def _(v):
        inbox, staged = _folder(v, "inbox"), _folder(v, "staged")
        v.service.select(F.col("id").cast("string").alias("id"), "title").repartition(4).write.option("quoteAll", "true").csv(inbox)
        ac.pick_up_files(v.spark, inbox, staged, _folder(v, "r3-checkpoint"), "*.csv")
        return v.spark.read.parquet(staged).select(F.get("values", F.lit(0)).alias("id"), F.get("values", F.lit(1)).alias("title"))

    @reg.add("S12_event_append", "v_activity", "SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM v_activity GROUP BY 1")
    def _(v):
        path = _folder(v, "activity")
        ac.append_events(v.activity.drop("day"), path)
        return v.spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))

    #: files of fifty sections each, then one flyer for each section under names and starts of several kinds
    @reg.add("S13_flyer_inventory", "v_section", """, f AS (SELECT id - id % 50 AS k, string_agg('%PDF-1.4 ' || content || chr(10), '' ORDER BY id) AS body FROM v_section GROUP BY 1),
      g AS (SELECT id, CASE id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'JPG' WHEN 3 THEN 'jpeg' ELSE 'txt' END AS ext, CASE WHEN id % 2 = 0 THEN '%PDF-1.4 ' ELSE '' END || content AS body FROM v_section)
      SELECT NULL AS clean_name, NULL AS kind, NULL AS mime, false AS signature_ok, octet_length(encode(body)) BETWEEN 1 AND 20971520 AS size_ok, sha256(body) AS sha256 FROM f
      UNION ALL SELECT 'Flyer ' || id || '.' || lower(ext), CASE id % 5 WHEN 0 THEN 'PDF' WHEN 4 THEN NULL ELSE 'IMAGE' END, CASE id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 4 THEN NULL ELSE 'image/jpeg' END,
        ext = 'pdf' AND (starts_with(body, '%PDF-') OR false), octet_length(encode(body)) BETWEEN 1 AND 20971520, sha256(body) FROM g""")
    def _(v):
        folder, i = _folder(v, "flyers"), F.col("id")
        lines = v.section.select(F.concat(F.lit("%PDF-1.4 "), "content").alias("value"), (i - i % 50).alias("k"), "id")
        lines.repartition("k").sortWithinPartitions("k", "id").drop("id").write.partitionBy("k").text(folder)
        found = fs.flyer_inventory(fs.binary_files(v.spark, folder, "*.txt")).withColumn("clean_name", F.lit(None).cast("string"))
        ext = F.when(i % 5 == 0, "pdf").when(i % 5 == 1, "png").when(i % 5 == 2, "JPG").when(i % 5 == 3, "jpeg").otherwise("txt")
        body = F.concat(F.when(i % 2 == 0, "%PDF-1.4 ").otherwise(""), "content").cast("binary")
        named = v.section.select(F.concat(F.lit("s3://flyers/Flyer "), i.cast("string"), F.lit(" .."), F.lit("."), ext).alias("path"), body.alias("content")).withColumn("length", F.octet_length("content"))
        return found.unionByName(fs.flyer_inventory(named)).select("clean_name", "kind", "mime", "signature_ok", "size_ok", "sha256")
