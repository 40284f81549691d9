"""Model features. All target features look back at least the horizon."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.config import (
    LAGS,
    NO_EVENT_DAYS,
    NO_HOLIDAY,
    ROLLING_WINDOWS,
    SERIES,
    TARGET,
)
from shelfcast.functions.calendar import calendar_columns, flag, impact_type
from shelfcast.operators.positions import over_rows, with_positions
from shelfcast.operators.ranges import range_positions
from shelfcast.session import by_day, sized


def by_series():
    """Window over a series: one row per day, so it is as long as the calendar."""
    return W.partitionBy(*SERIES).orderBy("date")


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(calendar_columns(date))


def log_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Target on the log1p scale; the original stays in ``<target>_raw``."""
    return df.withColumns({f"{target}_raw": F.col(target), target: F.log1p(target)})


def narrow_types(df: DataFrame) -> DataFrame:
    """Four-byte numbers for the written panel."""
    narrower = {"double": "float", "bigint": "int"}
    return df.select(
        *[F.col(c).cast(narrower[t]).alias(c) if t in narrower else F.col(c) for c, t in df.dtypes]
    )


# --- holidays -----------------------------------------------------------------


def holiday_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "es_festivo": flag(F.col("holiday_type") != NO_HOLIDAY),
            "holiday_impact_type": impact_type("holiday_description"),
        }
    )


def holiday_distance(days: DataFrame) -> DataFrame:
    """Days to the next and since the last holiday, for a table of days with ``es_festivo``."""
    ordered = W.orderBy("date")  # one row per day
    event = F.when(F.col("es_festivo") == 1, F.col("date"))
    following = F.min(event).over(ordered.rowsBetween(W.currentRow, W.unboundedFollowing))
    previous = F.max(event).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    return days.withColumns(
        {
            "dias_para_siguiente_festivo": F.coalesce(
                F.datediff(following, "date"), F.lit(NO_EVENT_DAYS)
            ),
            "dias_desde_ultimo_festivo": F.coalesce(
                F.datediff("date", previous), F.lit(NO_EVENT_DAYS)
            ),
        }
    )


# --- lags and rolling statistics ----------------------------------------------


def lag_columns(value: str, lags: list[int], prefix: str) -> dict:
    return {f"{prefix}{k}": F.lag(value, k).over(by_series()) for k in lags}


def frame(shift: int, width: int, window=None):
    """The ``width`` rows that end ``shift`` rows before the current one."""
    return (window or by_series()).rowsBetween(-(shift + width - 1), -shift)


def target_lags(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumns(lag_columns(TARGET, LAGS[horizon], "lag_"))


def rolling_parts(horizon: int) -> dict:
    """What the rows of one short frame add to any wider one: number, sum, squared deviations, maximum.

    The frame is as wide as the widths of the horizon have in common.
    """
    rows = frame(horizon, math.gcd(*ROLLING_WINDOWS[horizon]))
    return {
        "_n": F.count(TARGET).over(rows),
        "_sum": F.sum(TARGET).over(rows),
        "_spread": F.var_pop(TARGET).over(rows),
        "_top": F.max(TARGET).over(rows),
    }


def rolling_statistics(df: DataFrame, horizon: int) -> DataFrame:
    """Mean, deviation and maximum of each width, from ``rolling_parts`` of neighbouring frames.

    A wide frame is a few short ones, each a lag away in the same sort, so a row costs
    the same whatever the widths. Parts merge by their means and squared deviations from
    them: nothing is subtracted that cancels.
    """
    width = math.gcd(*ROLLING_WINDOWS[horizon])
    most = ROLLING_WINDOWS[horizon][-1] // width
    lags = {
        f"{c}{k}": (F.lag(c, k * width).over(by_series()) if k else F.col(c))
        for k in range(most)
        for c in ("_n", "_sum", "_spread", "_top")
    }
    filled = {c: F.coalesce(c, F.lit(0)) for c in lags if c[:2] == "_n"}
    filled |= {c: F.coalesce(c, F.lit(0.0)) for c in lags if c[:4] == "_sum"}
    filled |= {f"_mean{k}": F.try_divide(F.col(f"_sum{k}"), F.col(f"_n{k}")) for k in range(most)}
    means, deviations = {}, {}
    for w in ROLLING_WINDOWS[horizon]:
        parts = range(w // width)
        mean, n = F.col(f"rolling_mean_{w}d"), F.col(f"_count{w}")
        means[f"_count{w}"] = reduce(operator.add, [F.col(f"_n{k}") for k in parts])
        means[f"rolling_mean_{w}d"] = F.try_divide(reduce(operator.add, [F.col(f"_sum{k}") for k in parts]), means[f"_count{w}"])
        off = [F.col(f"_n{k}") * (F.col(f"_spread{k}") + (F.col(f"_mean{k}") - mean) * (F.col(f"_mean{k}") - mean)) for k in parts]
        total = reduce(operator.add, [F.coalesce(x, F.lit(0.0)) for x in off])
        deviations[f"rolling_std_{w}d"] = F.when(n > 1, F.sqrt(total / (n - 1)))
        tops = [F.col(f"_top{k}") for k in parts]
        deviations[f"rolling_max_{w}d"] = F.greatest(*tops) if len(tops) > 1 else tops[0]
    # step by step: each line reads columns of the one before, so no expression is written out twice
    made = df.withColumns(lags).withColumns(filled).withColumns(means).withColumns(deviations)
    order = [f"rolling_{s}_{w}d" for w in ROLLING_WINDOWS[horizon] for s in ("mean", "std", "max")]
    return made.select(*[c for c in df.columns if c not in ("_n", "_sum", "_spread", "_top")], *order)


def variation(df: DataFrame, horizon: int) -> DataFrame:
    """Coefficient of variation over the widest window."""
    w = ROLLING_WINDOWS[horizon][-1]
    return df.withColumn(
        "cv_ventas", F.col(f"rolling_std_{w}d") / (F.col(f"rolling_mean_{w}d") + 1e-6)
    )


def rolling_features(df: DataFrame, horizon: int) -> DataFrame:
    return variation(rolling_statistics(df.withColumns(rolling_parts(horizon)), horizon), horizon)


def promo_columns(horizon: int) -> dict:
    return {
        "tiene_promo": flag(F.col("onpromotion") > 0),
        f"promo_lag_{horizon}": F.lag("onpromotion", horizon).over(by_series()),
        f"rolling_promo_mean_{horizon * 2}": F.avg("onpromotion").over(frame(horizon, horizon * 2)),
    }


def promo_features(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumns(promo_columns(horizon))


# --- oil and transactions -----------------------------------------------------


def oil_columns(horizon: int, window) -> dict:
    columns = {f"oil_lag_{k}": F.lag("dcoilwtico", k).over(window) for k in LAGS[horizon]}
    for w in ROLLING_WINDOWS[horizon]:
        columns[f"oil_rolling_mean_{w}"] = F.avg("dcoilwtico").over(frame(horizon, w, window))
    return columns


def oil_day_features(days: DataFrame, horizon: int) -> DataFrame:
    """Lags and means of the price in days, on a table with one row per day."""
    return days.withColumns(oil_columns(horizon, W.orderBy("date")))


def trans_columns(horizon: int) -> dict:
    """Lag and mean of transactions in days.

    A store has the same count on all its series, and a dense panel has every
    day of each, so the window of the series gives the day grain.
    """
    return {
        f"trans_lag_{horizon}": F.lag("transactions", horizon).over(by_series()),
        f"trans_rolling_mean_{horizon}": F.avg("transactions").over(
            frame(horizon, horizon)
        ),
    }


def trans_day_features(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumns(trans_columns(horizon))


def _before(value: str, k: int) -> tuple:
    return F.first(value), -k, -k


def _oil_rows(horizon: int) -> dict:
    columns = {f"oil_lag_{k}": _before("dcoilwtico", k) for k in LAGS[horizon]}
    for w in ROLLING_WINDOWS[horizon]:
        columns[f"oil_rolling_mean_{w}"] = (
            F.avg("dcoilwtico"),
            -(horizon + w - 1),
            -horizon,
        )
    return columns


def _trans_rows(horizon: int) -> dict:
    return {
        f"trans_lag_{horizon}": _before("transactions", horizon),
        f"trans_rolling_mean_{horizon}": (F.avg("transactions"), -(2 * horizon - 1), -horizon),
    }


def _over_panel_rows(panel: DataFrame, columns: dict) -> DataFrame:
    """Columns over the rows of a store: positions are worked out once, whatever the columns."""
    lookback = max(-first for _, first, _ in columns.values())
    return over_rows(with_positions(panel), columns, lookback).drop("first_row", "rows", "row")


def oil_row_features(panel: DataFrame, horizon: int) -> DataFrame:
    """Lags and means of the price in panel rows of the store, whatever their day."""
    return _over_panel_rows(panel, _oil_rows(horizon))


def trans_row_features(panel: DataFrame, horizon: int) -> DataFrame:
    """Lag and mean of transactions in panel rows of the store."""
    return _over_panel_rows(panel, _trans_rows(horizon))


def row_features(panel: DataFrame, horizon: int) -> DataFrame:
    """Both of the above from one table of positions and one window."""
    return _over_panel_rows(panel, {**_oil_rows(horizon), **_trans_rows(horizon)})


# --- stores and series --------------------------------------------------------


def series_stats(df: DataFrame, as_of=None) -> DataFrame:
    """Mean and standard deviation of the log target per series, up to ``as_of``."""
    value = F.col(TARGET) if as_of is None else F.when(F.col("date") <= as_of, F.col(TARGET))
    return df.groupBy(*SERIES).agg(
        F.avg(value).alias("venta_media_historica"),
        F.stddev_samp(value).alias("venta_std_historica"),
    )


def stats_columns(as_of=None) -> dict:
    """The same statistics as columns, from the window the lags already use.

    ``as_of`` leaves later rows out of the statistics.
    """
    whole = W.partitionBy(*SERIES)
    value = F.col(TARGET) if as_of is None else F.when(F.col("date") <= as_of, F.col(TARGET))
    return {
        "venta_media_historica": F.avg(value).over(whole),
        "venta_std_historica": F.stddev_samp(value).over(whole),
    }


def store_ranking(df: DataFrame, as_of=None) -> DataFrame:
    """Stores by total log sales, largest first; ties share their average rank, truncated.

    Positions come from ranges of the totals: no task orders all stores, and stores of
    one total are told apart by their number, so they may fill several ranges.
    """
    rows = df if as_of is None else df.where(F.col("date") <= as_of)
    # Sums that differ only by the order of addition must not break a tie.
    total = F.round(F.coalesce(F.sum(TARGET), F.lit(0.0)), 6).alias("total")
    totals = rows.groupBy("store_nbr").agg(total)
    placed = range_positions(totals, [F.col("total").desc(), F.col("store_nbr").asc()])
    rank = F.floor(F.min("position") + (F.count(F.lit(1)) + 1) / 2).cast("int").alias("ranking_tienda")
    ranks = placed.groupBy("total").agg(rank)
    return placed.join(ranks, "total").select("store_nbr", "total", "ranking_tienda")


def series_std(df: DataFrame) -> DataFrame:
    """Standard deviation of the log target, brought to the scale of the sales."""
    return df.groupBy(*SERIES).agg(F.expm1(F.stddev_samp(TARGET)).alias("std_sales"))


def join_ranking(df: DataFrame, ranking: DataFrame) -> DataFrame:
    return df.join(sized(ranking.select("store_nbr", "ranking_tienda")), "store_nbr", "left")


def join_days(df: DataFrame, days: DataFrame) -> DataFrame:
    """Adds columns of a day table."""
    return df.join(by_day(days), "date", "left")
