"""Filling gaps: interpolation by position, edge fills and constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.config import NO_HOLIDAY
from shelfcast.operators.positions import day_positions, with_positions
from shelfcast.session import by_day


def _windows(keys: list[str], order: list[str]):
    ordered = W.partitionBy(*keys).orderBy(*order) if keys else W.orderBy(*order)
    return (
        ordered,
        ordered.rowsBetween(W.unboundedPreceding, W.currentRow),
        ordered.rowsBetween(W.currentRow, W.unboundedFollowing),
    )


def _between(value: Column, at: Column, left: Column, right: Column, edges: bool) -> Column:
    """Value on the line between two (position, value) points; flat after the last one.

    Before the first point the result is null, or that point with ``edges``.
    """
    line = left["v"] + (right["v"] - left["v"]) * (at - left["p"]) / (right["p"] - left["p"])
    start = right["v"] if edges else F.lit(None)
    return F.coalesce(value, F.when(left.isNotNull() & right.isNotNull(), line), left["v"], start)


def interpolate(
    df: DataFrame, value: str, keys: list[str], order: list[str], edges: bool = True
) -> DataFrame:
    """Linear interpolation by row position inside each group.

    Meant for groups with one row per day at most. Without keys the table as a
    whole must be that small.
    """
    ordered, before, after = _windows(keys, order)
    known = F.when(
        F.col(value).isNotNull(), F.struct(F.col("_at").alias("p"), F.col(value).alias("v"))
    )
    return (
        df.withColumn("_at", F.row_number().over(ordered))
        .withColumns(
            {
                "_left": F.last(known, ignorenulls=True).over(before),
                "_right": F.first(known, ignorenulls=True).over(after),
            }
        )
        .withColumn(
            value,
            _between(F.col(value), F.col("_at"), F.col("_left"), F.col("_right"), edges),
        )
        .drop("_at", "_left", "_right")
    )


def fill_edges(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Carry the last known value forward, then the first known one backward."""
    _, before, after = _windows(keys, order)
    return df.withColumn(
        value,
        F.coalesce(
            F.last(value, ignorenulls=True).over(before),
            F.first(value, ignorenulls=True).over(after),
        ),
    )


def prices(oil: DataFrame) -> DataFrame:
    """One row per day: of several prices of a day the highest counts."""
    return oil.groupBy("date").agg(F.max("dcoilwtico").alias("dcoilwtico"))


def oil_by_day(days: DataFrame, oil: DataFrame, edges: bool = True) -> DataFrame:
    """Interpolated price for each of the given days (one row per calendar day)."""
    return interpolate(days.join(by_day(prices(oil)), "date", "left"), "dcoilwtico", [], ["date"], edges)


def oil_by_row(panel: DataFrame, oil: DataFrame) -> DataFrame:
    """Interpolated price where every panel row counts as a step of its store.

    The price is known per day, so the neighbouring known rows follow from the
    day table of a store; only the position of a row is worked out per row.
    """
    days = day_positions(panel).join(by_day(prices(oil)), "date", "left")
    _, before, after = _windows(["store_nbr"], ["date"])
    price = F.col("dcoilwtico")

    def point(at: Column) -> Column:
        return F.when(price.isNotNull(), F.struct(at.alias("p"), price.alias("v")))

    last_row = F.col("first_row") + F.col("rows") - 1
    days = days.withColumns(
        {
            "_left": F.last(point(last_row), ignorenulls=True).over(before),
            "_right": F.first(point(F.col("first_row")), ignorenulls=True).over(after),
        }
    )
    value = _between(price, F.col("row"), F.col("_left"), F.col("_right"), True)
    return (
        with_positions(panel, days)
        .withColumn("dcoilwtico", value)
        .drop("_left", "_right", "first_row", "rows", "row")
    )


def impute_nulls(df: DataFrame) -> DataFrame:
    """No record means no transactions and no holiday; the locale stays null."""
    return df.fillna(
        {
            "transactions": 0,
            "holiday_type": NO_HOLIDAY,
            "holiday_description": NO_HOLIDAY,
            "transferred": False,
        }
    )
