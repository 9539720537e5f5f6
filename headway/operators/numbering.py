"""Dense numbers over sorted rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.sources.tables import checkpointed

#: Bits of a row's place in its partition in the ids that Spark gives.
_PLACE = 33


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """`df` with dense numbers from 0 in the given order, as bigint; rows equal in all of it are numbered in any order.

    Rows are sorted by range and kept so; their numbers are their places in their
    partitions after the rows of the partitions before. Ranges follow the whole order,
    so no value is too frequent for one; the sums are over a row per partition.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _PLACE)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << _PLACE) - 1))
    return placed.join(F.broadcast(starts), part == F.col("_part")).withColumn(name, number).drop("_place", "_part", "_start")
