"""Ranks within groups of any size, and the first rows in an order, without a task that holds a group.

Rows are counted by (group, bucket), where the bucket never falls along the order; running sums over
the buckets of a group (a few thousand rows) give every bucket its offset, and only rows of one
bucket are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 1 << 16


def ranked(rows: DataFrame, group: list, bucket: Column, order: list) -> DataFrame:
    """Adds _rank (from 1) in ``order`` within the group (null groups are one group), and _size, the rows of the group."""
    keyed = rows.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"_o_{c}") for c in group], F.col("_bucket").alias("_o_bucket"), before.alias("_before"), F.sum("_n").over(w).alias("_size"))
    inside = keyed.withColumn("_row", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)))
    same = F.col("_bucket").eqNullSafe(F.col("_o_bucket"))
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return inside.join(offsets, same).select(*rows.columns, (F.col("_before") + F.col("_row")).alias("_rank"), "_size")


def first_rows(rows: DataFrame, n: int, bucket: Column, order: list) -> DataFrame:
    """The first n rows in ``order``; exactly n if there are so many. ``bucket``: 0 .. BUCKETS - 1, never falling along the order."""
    keyed = rows.withColumn("_bucket", bucket)
    held, border = 0, None
    for r in keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("_bucket").collect():  # at most BUCKETS rows
        if held + r.n > n:
            border = r["_bucket"]
            break
        held += r.n
    if border is None:
        return rows
    rest = keyed.where(F.col("_bucket") == border).orderBy(*order).limit(n - held)
    return keyed.where(F.col("_bucket") < border).unionByName(rest).select(*rows.columns)


def hex_bucket(hexed: Column) -> Column:
    """Bucket of a hexadecimal digest."""
    return F.conv(F.substring(hexed, 1, 4), 16, 10).cast("int")


def hash_bucket(h: Column) -> Column:
    """Bucket of a signed 64-bit hash."""
    return (F.shiftright(h, 48) + BUCKETS // 2).cast("int")
