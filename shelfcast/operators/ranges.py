"""Positions in a global order, without a task that orders all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.session import staged


def range_positions(df: DataFrame, order: list[Column], by: str | None = None) -> DataFrame:
    """Adds ``position``: the place of a row in the order, from 0, inside its value of ``by``.

    Rows are dealt out by ranges of the order and sorted inside them; a row's place in
    its range and the rows of the ranges before it give its position. The ranges come
    from a sample, so they are written before they are counted. ``order`` should tell
    all rows apart: equal rows stay in one range.
    """
    keys = [F.col(by).asc()] if by else []
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = staged(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_id", 33)
    groups = [by] if by else []
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    starts = (
        ranged.groupBy(part.alias("_part"), *groups)
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select("_part", *groups, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(starts), ["_part", *groups])
        .withColumn("position", F.col("_id") - F.col("_first") + F.col("_start"))
        .select(*df.columns, "position")
    )
