"""Row positions inside a store, and windows over them that never take a whole store.

A store holds all rows of all its families, and one store may hold a large part
of the panel. Positions are therefore counted per day first, and windows run on
blocks of consecutive rows that carry the few earlier rows they look back to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


def day_positions(panel: DataFrame) -> DataFrame:
    """Rows of each store and day, and the position of the first of them."""
    earlier = (
        W.partitionBy("store_nbr").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        panel.groupBy("store_nbr", "date")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("first_row", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    )


def with_positions(panel: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Adds ``row``: the position inside the store in order of date and family."""
    days = day_positions(panel) if days is None else days
    inside = W.partitionBy("store_nbr", "date").orderBy("family")
    return panel.join(days, ["store_nbr", "date"]).withColumn(
        "row", F.col("first_row") + F.row_number().over(inside) - 1
    )


def over_rows(
    df: DataFrame, columns: dict[str, tuple[Column, int, int]], lookback: int, block: int = BLOCK_ROWS
) -> DataFrame:
    """Aggregates over earlier rows of a store, given as (expression, first, last) offsets.

    The result is the same as with one window per store: a block holds every
    row that a frame of ``lookback`` rows can reach.
    """
    if lookback > block:
        raise ValueError("a block must be longer than the lookback")
    home = F.floor(F.col("row") / block)
    repeated = F.col("row") % block >= block - lookback
    blocks = F.when(repeated, F.array(home, home + 1)).otherwise(F.array(home))
    ordered = W.partitionBy("store_nbr", "_block").orderBy("row")
    return (
        df.withColumn("_block", F.explode(blocks))
        .withColumns(
            {
                name: expression.over(ordered.rowsBetween(first, last))
                for name, (expression, first, last) in columns.items()
            }
        )
        .where(F.col("_block") == home)
        .drop("_block")
    )
