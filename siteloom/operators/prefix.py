"""Running values over long ordered groups.

A window orders its whole group in one task. Where a single group may hold a large part
of all rows, the group is cut into buckets that follow its order: every bucket is worked
on by itself, and only one row per bucket is ordered over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def _bucketed(df: DataFrame, bucket: Column) -> DataFrame:
    return df.withColumn(BUCKET, bucket)


def _attach(df: DataFrame, per_bucket: DataFrame, keys: list[str]) -> DataFrame:
    # One row per bucket against many, on the bucket key: balanced, however hot the group.
    return df.join(per_bucket, [*keys, BUCKET])


def running_rank(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, earlier: DataFrame | None = None
) -> DataFrame:
    """Add ``running_rank``, the row number within ``keys`` in the order ``order``.
    ``bucket`` must not decrease along that order. ``earlier`` (the keys and ``n``) tells how many rows
    of a group went before; numbers then, not below zero, are the buckets."""
    rows = _bucketed(df, bucket)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, BUCKET).agg(F.count("*").alias("n"))
    if earlier is not None:
        sizes = sizes.unionByName(earlier.select(*keys, F.lit(-1).cast("bigint").alias(BUCKET), "n"))
    offsets = (
        sizes.withColumn("_offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    ranked = rows.withColumn("_inside", F.row_number().over(inside))
    return (
        _attach(ranked, offsets, keys)
        .withColumn("running_rank", F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", BUCKET)
    )


def running_max(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, bucket: Column
) -> DataFrame:
    """Add ``running_max``, the largest ``value`` so far within ``keys``."""
    rows = _bucketed(df, bucket).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        rows.groupBy(*keys, BUCKET)
        .agg(F.max("_value").alias("m"))
        .withColumn("_earlier", F.max("m").over(before))
        .drop("m")
    )
    inside = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = rows.withColumn("_inside", F.max("_value").over(inside))
    return (
        _attach(running, earlier, keys)
        .withColumn("running_max", F.greatest("_inside", "_earlier"))
        .drop("_inside", "_earlier", "_value", BUCKET)
    )
