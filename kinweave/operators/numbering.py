"""Gapless numbers within groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gapless(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int = 64) -> DataFrame:
    """Add `out`: 0, 1, 2, ... within each group of `keys`, with no gaps.

    Keys must not be null. Rows of a group are dealt into `buckets` by a hash of `order`, numbered inside each (key, bucket) and shifted by the
    rows in the buckets before, which come from a count of keys x buckets rows. `order` should tell rows apart; rows that
    are equal in it get different numbers in an arbitrary order. Only the numbers inside a group matter, not which row
    has which. Choose `buckets` so that rows / buckets fits a task comfortably.
    """
    b, n = "__bucket", "__before"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select(*keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(n))
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    joined = dealt.withColumn(out, F.row_number().over(inside)).join(sizes, [*keys, b])
    return joined.withColumn(out, (F.col(out) - 1 + F.col(n)).cast("long")).select(*df.columns, out)
