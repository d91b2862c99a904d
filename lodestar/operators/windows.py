"""Ordering operators that stay parallel when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group, with their rank.

    Spark limits each input partition to ``k`` rows per group before the shuffle
    (window group limit), so a hot key never moves more than ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def best_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group under ``order``."""
    return top_per_group(df, keys, order, 1, "__rn").drop("__rn")


def group_row_number(
    df: DataFrame, keys: list[str], block: Column, order: list, name: str = "seq"
) -> DataFrame:
    """``row_number`` per group, computed block by block.

    ``block`` must grow with ``order`` (a day of a timestamp, a range of row numbers). Only a
    block of a group is sorted in one task; blocks are chained by a prefix sum of their sizes.
    """
    tagged = df.withColumn("__block", block)
    sizes = tagged.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    local = tagged.withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(*order))
    )
    return (
        _join_null_safe(local, offsets, [*keys, "__block"])
        .withColumn(name, (F.col("__rn") + F.col("__offset")).cast("bigint"))
        .drop("__rn", "__offset", "__block")
    )


def carry_forward(
    df: DataFrame, keys: list[str], block: Column, order: list, value: str, name: str
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row of its group, block by block."""
    tagged = df.withColumn("__block", block)
    here = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("__here", F.last(value, ignorenulls=True).over(here))
    ends = (
        tagged.where(F.col(value).isNotNull())
        .groupBy(*keys, "__block")
        .agg(F.max_by(value, F.struct(*order)).alias("__end"))
    )
    blocks = tagged.select(*keys, "__block").distinct()
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = _join_null_safe(blocks, ends, [*keys, "__block"], "left").select(
        *keys, "__block", F.last("__end", ignorenulls=True).over(before).alias("__carry")
    )
    return (
        _join_null_safe(local, carried, [*keys, "__block"])
        .withColumn(name, F.coalesce("__here", "__carry"))
        .drop("__here", "__carry", "__block")
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        pair = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = pair if i == 0 else cond & pair
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def previous_in_group(
    df: DataFrame, keys: list[str], block: Column, order: list, value: str, name: str
) -> DataFrame:
    """``value`` of the row just before each row of its group, block by block."""
    tagged = df.withColumn("__block", block)
    local = tagged.withColumn(
        "__here", F.lag(value).over(Window.partitionBy(*keys, "__block").orderBy(*order))
    )
    ends = tagged.groupBy(*keys, "__block").agg(F.max_by(value, F.struct(*order)).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__block")
    carried = ends.select(*keys, "__block", F.lag("__end").over(before).alias("__carry"))
    return (
        _join_null_safe(local, carried, [*keys, "__block"])
        .withColumn(name, F.coalesce("__here", "__carry"))
        .drop("__here", "__carry", "__block")
    )
