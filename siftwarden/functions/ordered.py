"""Looking at the row before, without sorting a whole hot key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, slice_of: Column, name: str
) -> DataFrame:
    """Add ``name``: the ``value`` of the row before, per key and in order.

    ``slice_of`` must not decrease along the order (a coarser time is typical).
    Rows are ordered within (key, slice) only; the last value of each slice is
    carried to the next slice that has rows.
    """
    rows = df.withColumn("_slice", slice_of)
    group = [*keys, "_slice"]
    tails = rows.groupBy(*group).agg(
        F.max(F.struct(*order, F.col(value).alias("_v")))["_v"].alias("_tail")
    )
    carried = tails.select(
        *group, F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carried")
    )
    inside = F.lag(value).over(Window.partitionBy(*group).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    return (
        rows.withColumn("_inside", inside)
        .withColumn("_first", first)
        .join(carried, group)
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_inside")))
        .drop("_slice", "_inside", "_first", "_carried")
    )


def hour_slice(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 3_600_000_000)
