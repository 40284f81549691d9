"""Forecast rows, their features, the prediction and its interval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import PANEL_KEYS, SERIES, SETTINGS, TARGET, Settings
from shelfcast.operators.enrich import enrich_panel
from shelfcast.operators.features import series_std
from shelfcast.operators.folds import last_date, lookback
from shelfcast.operators.impute import impute_nulls, interpolate
from shelfcast.plans.features import build_features
from shelfcast.session import by_day, sized

Z_95 = 1.96
UPPER_STRETCH = 1.5


def future_grid(history: DataFrame, periods: int) -> DataFrame:
    """Every series on each of the days after the last one, with an empty target."""
    last = last_date(history)
    days = F.sequence(F.date_add(last, 1), F.date_add(last, periods))
    return (
        history.select(*SERIES)
        .distinct()
        .select(*SERIES, F.explode(days).alias("date"))
        .withColumn(TARGET, F.lit(0.0))
    )


def history_with_future(
    history: DataFrame, tables: dict[str, DataFrame], periods: int
) -> DataFrame:
    """Processed history and enriched future rows as one panel.

    Columns the future does not have are null, then imputed. The price is
    interpolated over both, so it carries from the history into the future.
    """
    future = enrich_panel(
        future_grid(history, periods),
        tables["stores"],
        tables["oil"],
        tables["transactions"],
        tables["holidays_events"],
    )
    both = history.unionByName(future, allowMissingColumns=True)
    days = both.groupBy("date").agg(F.max("dcoilwtico").alias("dcoilwtico"))
    price = interpolate(days, "dcoilwtico", [], ["date"])
    filled = both.drop("dcoilwtico").join(by_day(price), "date", "left")
    return impute_nulls(filled).fillna({"onpromotion": 0})


def prediction_input(
    processed: DataFrame,
    tables: dict[str, DataFrame],
    horizon: int,
    state: dict[str, DataFrame],
    periods: int | None = None,
    settings: Settings = SETTINGS,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Features of the future rows. History beyond the lookback is cut before the windows.

    ``stage`` may write the combined rows and read them back, since they are
    read several times.
    """
    periods = periods or horizon
    if periods > horizon:
        raise ValueError("lags of the horizon do not reach that far ahead")
    history = lookback(processed, settings)
    both = stage(history_with_future(history, tables, periods))
    features = build_features(both, horizon, state)
    return features.where(F.col("date") > last_date(processed))


def with_interval(predicted: DataFrame, spread: DataFrame) -> DataFrame:
    """Prediction on the sales scale and its bounds.

    ``predicted`` has ``y_pred`` on the log scale, ``spread`` a ``std_sales``
    per series. The upper side is wider.
    """
    sales = F.round(F.greatest(F.expm1("y_pred"), F.lit(0.0)), 2)
    reach = F.col("std_sales") * Z_95
    return (
        predicted.join(sized(spread), SERIES, "left")
        .withColumn("predicted_sales", sales)
        .select(
            *PANEL_KEYS,
            "predicted_sales",
            F.round(F.greatest(F.col("predicted_sales") - reach, F.lit(0.0)), 2).alias(
                "lower_bound"
            ),
            F.round(F.col("predicted_sales") + reach * UPPER_STRETCH, 2).alias("upper_bound"),
        )
    )


def forecast(
    processed: DataFrame,
    tables: dict[str, DataFrame],
    horizon: int,
    state: dict[str, DataFrame],
    predict: Callable[[DataFrame], DataFrame],
    periods: int | None = None,
    settings: Settings = SETTINGS,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Forecast of all stores. The spread comes from the whole history."""
    rows = predict(prediction_input(processed, tables, horizon, state, periods, settings, stage))
    codes = state["codes"].where("column_name = 'family'").select(
        F.col("value").alias("family"), F.col("code")
    )
    spread = (
        series_std(processed)
        .join(sized(codes), "family")
        .select("store_nbr", F.col("code").alias("family"), "std_sales")
    )
    return with_interval(rows, spread)


def naive(horizon: int) -> Callable[[DataFrame], DataFrame]:
    """The value one horizon ago as the prediction."""
    return lambda df: df.withColumn("y_pred", F.col(f"lag_{horizon}"))


def forecast_of_store(table: DataFrame, store: int, family: int | None = None) -> DataFrame:
    """Rows of one store, or one of its families; none at all is an error."""
    rows = table.where(F.col("store_nbr") == store)
    if rows.isEmpty():
        raise ValueError(f"store {store} not found")
    if family is not None:
        rows = rows.where(F.col("family") == family)
        if rows.isEmpty():
            raise LookupError(f"family {family} not found in store {store}")
    return rows


def monthly_view(table: DataFrame) -> DataFrame:
    month: Column = F.trunc("date", "month").alias("month")
    return table.groupBy("store_nbr", "family", month).agg(
        F.sum("predicted_sales").alias("predicted_sales")
    )
