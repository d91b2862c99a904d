"""Session factory and the few settings the jobs depend on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only when its measured row count stays below this bound.
BROADCAST_ROWS = 200_000


def build_session(
    app: str = "lodestar",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create a session: UTC days, ANSI errors, adaptive execution.

    On a cluster pass neither ``master`` nor ``shuffle_partitions``: the submit
    command chooses the first, and adaptive execution coalesces the second.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names in
    ``spark.checkpoint.dir``. Only a local session without that setting gets its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_SCRATCH:
        _OWN_SCRATCH[app] = tempfile.mkdtemp(prefix="lodestar-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _OWN_SCRATCH[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut.

    Survives lost executors, and its file sizes let Catalyst choose the join by itself.
    """
    path = f"{scratch_dir(df.sparkSession)}/part-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """Enough tasks for every core; more when the session asks for more shuffle partitions."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def gather(df: DataFrame, *columns: str) -> DataFrame:
    """Shuffle rows by the keys they are aggregated by, before any is aggregated.

    A task then holds the keys of one shuffle partition, which adaptive execution sizes. Combined before the shuffle it would
    hold those of all it reads: a whole file, or what its rows grow to in a join.
    """
    return df.repartition(*columns)


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: sorted by its key on both sides, never sent through the driver.

    Catalyst sizes such rows by their files, which are packed, and by a fixed length for every text that is made.
    """
    return df.hint("merge")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition rows of little size but much work; adaptive execution keeps the number."""
    return df.repartition(task_count(df.sparkSession), *columns)
