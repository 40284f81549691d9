"""Errors of predictions by any grouping, and what is reported from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import METRICS, TARGET
from shelfcast.functions.metrics import mean_of_rounded, metric_columns


def evaluate(df: DataFrame, by: list[str], yhat: str = "y_pred", in_log_scale=True) -> DataFrame:
    """Metrics per group in one aggregation; partial sums combine before the shuffle."""
    metrics = metric_columns(TARGET, yhat, in_log_scale)
    return df.groupBy(*by).agg(*metrics, F.count(F.lit(1)).alias("n_rows"))


def evaluate_by_store(df: DataFrame, yhat: str = "y_pred") -> DataFrame:
    return df.groupBy("store_nbr").agg(
        *metric_columns(TARGET, yhat),
        F.min("city").alias("city"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def log_wape(df: DataFrame, by: list[str], yhat: str = "y_pred") -> DataFrame:
    """Sum of log errors relative to the sum of log actuals."""
    total = F.sum(TARGET)
    return df.groupBy(*by).agg(
        F.round(
            F.when(total != 0, F.sum(F.abs(F.col(TARGET) - F.col(yhat))) / total), 6
        ).alias("log_wape")
    )


def _absolute_error(yhat: str):
    return F.abs(F.expm1(TARGET) - F.expm1(yhat))


def error_by_date(df: DataFrame, yhat: str = "y_pred") -> DataFrame:
    error = _absolute_error(yhat)
    return df.groupBy("date").agg(
        F.round(F.avg(error), 6).alias("mae_diario"),
        F.round(F.stddev_samp(error), 6).alias("std_diario"),
    )


#: Report -> grouping column and the bits of its grouping id over (family, store_nbr, date).
REPORTS = {"global": (None, 7), "family": ("family", 3), "store": ("store_nbr", 5), "date": ("date", 6)}


def report_table(df: DataFrame, yhat: str = "y_pred") -> DataFrame:
    """The global, family, store and date reports in one pass over the scored rows.

    Grouping sets: a row is aggregated for each of the four groupings, and partial sums
    combine before the only shuffle. ``level`` is the grouping id, so a null family
    stays a group of its own.
    """
    error, total = _absolute_error(yhat), F.sum(TARGET)
    wape = F.when(total != 0, F.sum(F.abs(F.col(TARGET) - F.col(yhat))) / total)
    keys = ["family", "store_nbr", "date"]
    return df.groupingSets([[key] if key else [] for key, _ in REPORTS.values()], *keys).agg(
        F.grouping_id().cast("int").alias("level"),
        *metric_columns(TARGET, yhat),
        F.count(F.lit(1)).alias("n_rows"),
        F.round(wape, 6).alias("log_wape"),
        F.round(F.avg(error), 6).alias("mae_diario"),
        F.round(F.stddev_samp(error), 6).alias("std_diario"),
        F.min("city").alias("city"),
    )


def report_views(table: DataFrame) -> dict[str, DataFrame]:
    """The single reports out of ``report_table``."""

    def view(name: str, *columns: str) -> DataFrame:
        key, level = REPORTS[name]
        return table.where(F.col("level") == level).select(*([key] if key else []), *columns)

    return {
        "global": view("global", *METRICS, "n_rows"),
        "family": view("family", *METRICS, "n_rows"),
        "family_log_wape": view("family", "log_wape"),
        "store": view("store", *METRICS, "city", "n_rows"),
        "date": view("date", "mae_diario", "std_diario"),
    }


def worst(df: DataFrame, metric: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` largest rows by a metric. Spark keeps n rows per task, then merges."""
    return df.orderBy(F.desc_nulls_last(metric), *ties).limit(n)


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    means = [mean_of_rounded(m).alias(f"{m}_mean") for m in METRICS]
    deviations = [F.round(F.stddev_pop(m), 4).alias(f"{m}_std") for m in METRICS]
    return fold_metrics.agg(*means, *deviations)


def metrics_summary(family_metrics: DataFrame) -> DataFrame:
    """Unweighted mean of the family metrics."""
    return family_metrics.agg(*[mean_of_rounded(m).alias(m) for m in METRICS])


def series_compare(df: DataFrame, store: int, family, yhat: str = "y_pred") -> DataFrame:
    """Actual and predicted values of one series."""
    return df.where((F.col("store_nbr") == store) & (F.col("family") == family)).select(
        "date",
        F.round(F.expm1(TARGET), 6).alias("actual"),
        F.round(F.expm1(yhat), 6).alias("predicted"),
        F.round(_absolute_error(yhat), 6).alias("abs_error"),
    )


def family_flags(family_metrics: DataFrame) -> DataFrame:
    """Families whose RMSE lies above the mean RMSE."""
    mean = family_metrics.agg(mean_of_rounded("rmse")).scalar()
    return family_metrics.select(
        "family",
        "rmse",
        mean.alias("mean_rmse"),
        (F.col("rmse") > mean).alias("above_mean"),
    )


def champion_challenger(
    champion: DataFrame, challenger: DataFrame, metric: str = "rmse", gain: float = 1.0,
    force: bool = False,
) -> DataFrame:
    """Accept the challenger when it is better by ``gain`` percent, or when forced.

    Both inputs are one-row metric tables.
    """
    after = challenger.select(metric).scalar()
    gained = F.try_divide(F.col("before") - F.col("after"), F.col("before")) * 100
    return champion.select(F.col(metric).alias("before"), after.alias("after")).select(
        "before",
        "after",
        F.round(gained, 4).alias("gain_pct"),
        (F.lit(force) | F.coalesce(gained >= gain, F.lit(False))).alias("accepted"),
    )
