"""From raw tables to the processed panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from shelfcast.operators.enrich import enrich_panel
from shelfcast.operators.features import log_target
from shelfcast.operators.impute import impute_nulls, oil_by_day, oil_by_row
from shelfcast.operators.quality import require_unique


def process(
    panel: DataFrame,
    tables: dict[str, DataFrame],
    oil_grain: str = "day",
    check: bool = False,
    alike: Callable[[str, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Enrich and impute one panel. ``alike`` writes a table in the buckets of the panel.

    ``oil_grain="day"`` interpolates the price over days. ``"row"`` counts every
    panel row of a store as a step, so rows of one day differ.
    """
    oil = tables["oil"]
    if oil_grain == "day":
        oil = oil_by_day(panel.select("date").distinct(), oil)
    merged = enrich_panel(
        panel, tables["stores"], oil, tables["transactions"], tables["holidays_events"], alike
    )
    if oil_grain == "row":
        merged = oil_by_row(merged.drop("dcoilwtico"), tables["oil"])
    if check:
        require_unique(merged)
    return impute_nulls(merged)


def preprocess(
    tables: dict[str, DataFrame],
    predict: bool = False,
    oil_grain: str = "day",
    check: bool = False,
) -> dict[str, DataFrame]:
    """Processed train (log target) and test; predict mode processes test alone."""
    done = {"test": process(tables["test"], tables, oil_grain, check)}
    if not predict:
        done["train"] = log_target(process(tables["train"], tables, oil_grain, check))
    return done
