"""Dense numbers in a given order without one task holding all rows (WI-1, WI-2, WI-3, WI-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

ROWS = 100_000  # of a range that one task numbers
RANGES = 100_000  # more would make the sums of ranges themselves long


def running_total(df: DataFrame, order: list[str | Column], value: str | None, name: str, within: str | None = None) -> DataFrame:
    """df with name: the sum of a column, or the number of rows without one, up to each row in the order of the columns, which is total; within each value of a column if one is given.

    df is kept, so that it is computed once. Rows are dealt into ranges of all the columns; ranges are summed side by side
    and shifted by what stands before them: a row for each range, and value of the column within.
    """
    df = kept(df, "unnumbered")
    one = F.col(value) if value else F.lit(1).cast("long")
    ranges = min(RANGES, -(-df.count() // ROWS))
    groups = [within] if within else []
    upto = lambda *by: F.sum(one).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if ranges <= 1:
        return df.withColumn(name, upto(*groups))
    dealt = kept(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range", *groups).agg(F.sum(one).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*groups).orderBy("_range")) - F.col("n")
    before = sums.select(F.col("_range").alias("_r"), *(F.col(g).alias("_g") for g in groups), before.alias("_before"))
    rows = dealt.withColumn("_nth", upto("_range", *groups))
    same = F.col("_range") == F.col("_r")
    same = same & F.col(within).eqNullSafe(F.col("_g")) if within else same
    return rows.join(before, same).withColumn(name, F.col("_nth") + F.col("_before")).drop("_range", "_r", "_g", "_nth", "_before")


def numbered(df: DataFrame, order: list[str | Column], name: str, within: str | None = None) -> DataFrame:
    """df with name: 1, 2, ... in the order of the columns, which is total; within each value of a column if one is given."""
    return running_total(df, order, None, name, within)


def first_seen(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(key, first, name): the keys numbered by where they first appear (WI-1). Ties go by key."""
    return numbered(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first")), ["first", key], name)
