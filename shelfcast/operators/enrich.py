"""Joining the dimension tables to the panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.config import SERIES
from shelfcast.operators.impute import prices
from shelfcast.session import by_day, is_small, sized

HOLIDAY_COLUMNS = ["holiday_type", "holiday_description", "holiday_locale", "transferred"]
_PLACE = {"National": None, "Regional": "state", "Local": "city"}


def split_holidays(holidays: DataFrame) -> dict[str, DataFrame]:
    """One table per locale, one row per date (and place).

    Of several rows the one that was not transferred wins, then type and
    description decide.
    """
    tables = {}
    for locale, place in _PLACE.items():
        keys = ["date"] + ([place] if place else [])
        first = W.partitionBy(*keys).orderBy("transferred", "holiday_type", "holiday_description")
        rows = holidays.where(F.col("locale") == locale).select(
            "date",
            F.col("type").alias("holiday_type"),
            F.col("description").alias("holiday_description"),
            F.col("locale").alias("holiday_locale"),
            "transferred",
            *([F.col("locale_name").alias(place)] if place else []),
        )
        if place:
            rows = rows.where(F.col(place).isNotNull())
        tables[locale] = (
            rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        )
    return tables


def join_holidays(panel: DataFrame, holidays: DataFrame) -> DataFrame:
    """Local over regional over national, column by column; the panel keeps its rows."""
    merged = panel
    hint = F.broadcast if is_small(holidays) else (lambda df: df)
    priority = {c: [] for c in HOLIDAY_COLUMNS}
    for locale, table in split_holidays(holidays).items():
        place = _PLACE[locale]
        renamed = table.withColumnsRenamed({c: f"{c}_{locale}" for c in HOLIDAY_COLUMNS})
        merged = merged.join(hint(renamed), ["date"] + ([place] if place else []), "left")
        for c in HOLIDAY_COLUMNS:
            priority[c].insert(0, f"{c}_{locale}")
    return merged.select(
        *panel.columns, *[F.coalesce(*names).alias(c) for c, names in priority.items()]
    )


def _for_series(panel: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of a table of stores, repeated for each series of the store."""
    return panel.select(*SERIES).distinct().join(table, "store_nbr")


def _join_stores(
    panel: DataFrame, table: DataFrame, days: list[str], name: str, alike: Callable[[str, DataFrame], DataFrame] | None
) -> DataFrame:
    """Adds the columns of a table of stores, or of stores and days.

    A small table is broadcast. A larger one is brought to the series and written by
    ``alike`` in the buckets of the panel, so that both sides meet bucket by bucket and the
    panel stays where it is; without ``alike`` Spark shuffles both and splits skewed
    partitions.
    """
    if alike is None or is_small(table):
        return panel.join(sized(table), [*days, "store_nbr"], "left")
    held = alike(name, _for_series(panel, table))
    return panel.join(held.hint("merge"), [*SERIES, *days], "left")


def enrich_panel(
    panel: DataFrame,
    stores: DataFrame,
    oil: DataFrame,
    transactions: DataFrame,
    holidays: DataFrame,
    alike: Callable[[str, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Store attributes, oil price, transactions and holidays for every panel row.

    All joins keep the panel where it is: dimensions are broadcast while they are
    small, and with ``alike`` (see ``_join_stores``) stores and transactions beyond that
    are bucketed like the panel.
    """
    merged = _join_stores(panel, stores, [], "stores_by_series", alike)
    merged = merged.join(by_day(prices(oil)), "date", "left")
    merged = _join_stores(merged, transactions, ["date"], "transactions_by_series", alike)
    columns = [
        *panel.columns,
        *[c for c in stores.columns if c != "store_nbr"],
        "dcoilwtico",
        "transactions",
    ]
    return join_holidays(merged.select(*columns), holidays)
