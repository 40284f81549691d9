"""From the processed panel to the feature table of one horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import CATEGORICAL, LAGS, NOT_FEATURES, TARGET
from shelfcast.operators import features as X
from shelfcast.operators.encode import apply_codes, fit_codes
from shelfcast.session import sized

ENCODED = [*CATEGORICAL, "holiday_locale"]


def fit_state(processed: DataFrame, as_of: Column | None = None) -> dict[str, DataFrame]:
    """What a forecast must take from training: codes, ranking and series statistics."""
    return {
        "codes": fit_codes(X.holiday_flags(processed), ENCODED),
        "ranking": X.store_ranking(processed, as_of),
        "stats": X.series_stats(processed, as_of),
    }


def day_features(flagged: DataFrame, horizon: int) -> DataFrame:
    """Holiday distances and oil features: one pass over the panel, then one row per day."""
    days = flagged.groupBy("date").agg(
        F.max("es_festivo").alias("es_festivo"), F.max("dcoilwtico").alias("dcoilwtico")
    )
    return X.oil_day_features(X.holiday_distance(days), horizon).drop("es_festivo", "dcoilwtico")


def lag_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "lag_" in c]


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def store_features(
    df: DataFrame, ranking: DataFrame, stats: DataFrame | None = None, as_of: Column | None = None
) -> DataFrame:
    """Series statistics and the ranking of the store.

    Without ``stats`` the statistics come from the rows at hand, by the window
    the lags use; with it, from training.
    """
    if stats is None:
        df = df.withColumns(X.stats_columns(as_of))
    else:
        df = df.join(sized(stats), ["store_nbr", "family"], "left")
    return X.join_ranking(df, ranking)


def raw_features(
    processed: DataFrame,
    horizon: int,
    state: dict[str, DataFrame],
    grain: str = "day",
    as_of: Column | None = None,
) -> DataFrame:
    """All features before rows without history are dropped.

    Lags, rolling, promotion and transaction columns share one window over the
    series: one sort, and no shuffle when the panel is bucketed by series. Text
    becomes codes before that sort, to keep its rows short; only the family
    stays, because it is part of the bucketing. Columns of the date alone come
    after it. ``state["stats"]`` may be left out to compute the statistics here.
    """
    flagged = X.holiday_flags(processed)
    coded = apply_codes(flagged, state["codes"], [c for c in ENCODED if c != "family"])
    windows = {
        **X.lag_columns(TARGET, LAGS[horizon], "lag_"),
        **X.rolling_parts(horizon),
        **X.promo_columns(horizon),
        **(X.trans_columns(horizon) if grain == "day" else {}),
    }
    df = X.variation(X.rolling_statistics(coded.withColumns(windows), horizon), horizon)
    df = store_features(df, state["ranking"], state.get("stats"), as_of)
    if grain == "row":
        df = X.row_features(df, horizon)
        days = flagged.groupBy("date").agg(F.max("es_festivo").alias("es_festivo"))
        df = X.join_days(df, X.holiday_distance(days).drop("es_festivo"))
    else:
        df = X.join_days(df, day_features(flagged, horizon))
    df = apply_codes(X.calendar_features(df), state["codes"], ["family"])
    return df.withColumn("transferred", F.col("transferred").cast("int"))


def build_features(
    processed: DataFrame,
    horizon: int,
    state: dict[str, DataFrame],
    grain: str = "day",
    as_of: Column | None = None,
) -> DataFrame:
    """Feature table; rows whose lags reach before the first row of a series are dropped."""
    df = raw_features(processed, horizon, state, grain, as_of)
    return df.dropna(subset=lag_names(df))
