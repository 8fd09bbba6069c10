"""Prefix sums and ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_buckets(largest: int, per_bucket: int = 100_000) -> int:
    """Buckets that keep every (group, bucket) near ``per_bucket`` rows when the largest group has ``largest``."""
    return max(1, -(-largest // per_bucket))


def bucketed_prefix_sum(df: DataFrame, group: list[str], tie: str, value: str, out: str, buckets: int) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before it in its group (exclusive prefix sum).

    Rows of a group are ordered by (hash bucket of ``tie``, ``tie``): a fixed order that lets one group be spread over
    ``buckets`` tasks. Bucket totals (at most ``buckets`` rows a group) are summed first and joined back, so no task
    holds a whole group. ``tie`` must be unique within the group. NULL values count as 0.
    """
    v = F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    if buckets <= 1:
        w = Window.partitionBy(*group).orderBy(tie).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(v).over(w), F.lit(0).cast("bigint")))
    marked = df.withColumn("__b", F.pmod(F.xxhash64(tie), F.lit(buckets)))
    totals = marked.groupBy(*group, "__b").agg(F.sum(v).alias("__t"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__b").alias("__ob"),
                            F.coalesce(F.sum("__t").over(before), F.lit(0).cast("bigint")).alias("__o"))
    inner = Window.partitionBy(*group, "__b").orderBy(tie).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("__l", F.coalesce(F.sum(v).over(inner), F.lit(0).cast("bigint")))
    on: Column = F.col("__b") == F.col("__ob")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = local.join(offsets, on, "inner").withColumn(out, F.col("__l") + F.col("__o"))
    return joined.drop("__b", "__ob", "__l", "__o", *[f"__g{i}" for i in range(len(group))])
