"""Time splits: walk-forward folds by date position, and the calendar holdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.config import SERIES, SETTINGS, Settings
from shelfcast.session import by_day


def date_positions(df: DataFrame) -> DataFrame:
    """Distinct dates with their position, the number of dates and of rows on each."""
    ordered = W.orderBy("date")  # one row per day
    return (
        df.groupBy("date")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumns(
            {
                "position": F.row_number().over(ordered) - 1,
                "n_dates": F.count(F.lit(1)).over(
                    ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
                ),
            }
        )
    )


def fold_days(df: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Date positions with the fold whose validation block holds them.

    Folds are consecutive blocks counted back from the holdout, so the number
    of a block follows from the position. A fold without training dates is
    left out and keeps its number.
    """
    width = settings.val_weeks * 7
    end = F.col("n_dates") - settings.test_weeks * 7
    back = F.floor((end - 1 - F.col("position")) / width)
    first = end - (back + 1) * width
    inside = (back >= 0) & (back < settings.n_folds) & (first > 0)
    return date_positions(df).withColumn(
        "fold", F.when(inside, (settings.n_folds - back).cast("int"))
    )


def walk_forward_folds(df: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One row per fold: date ranges and row counts. Works on the day table alone."""
    days = fold_days(df, settings)
    ordered = W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumns(
        {
            "rows_before": F.sum("n_rows").over(ordered),
            "first_date": F.min("date").over(ordered),
            "date_before": F.max("date").over(ordered),
        }
    )
    return (
        days.where(F.col("fold").isNotNull())
        .groupBy("fold")
        .agg(
            F.min("first_date").alias("train_start"),
            F.min("date_before").alias("train_end"),
            F.min("date").alias("val_start"),
            F.max("date").alias("val_end"),
            F.min("rows_before").alias("n_train"),
            F.sum("n_rows").alias("n_val"),
        )
    )


def describe_folds(folds: DataFrame) -> DataFrame:
    """The same folds with one row per role."""
    return folds.select(
        "fold",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(role).alias("role"),
                        F.col(f"{role}_start").alias("start_date"),
                        F.col(f"{role}_end").alias("end_date"),
                        F.col(f"n_{role}").alias("n_rows"),
                    )
                    for role in ("train", "val")
                ]
            )
        ).alias("r"),
    ).select("fold", "r.*")


def validation_rows(df: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """All validation rows with their fold; blocks do not overlap, so one join serves all."""
    days = fold_days(df, settings).where(F.col("fold").isNotNull()).select("date", "fold")
    return df.join(by_day(days), "date")


def last_date(df: DataFrame, days_back: int = 0) -> Column:
    """Last date, or a day before it. The difference is taken inside the subquery,
    so the scan gets a plain value to skip pages by."""
    return df.agg(F.date_sub(F.max("date"), days_back)).scalar()


def holdout_cutoff(df: DataFrame, settings: Settings = SETTINGS) -> Column:
    """Last training date: whole weeks back from the last date, by the calendar."""
    return last_date(df, settings.test_weeks * 7)


def holdout_split(df: DataFrame, settings: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    cutoff = holdout_cutoff(df, settings)
    return df.where(F.col("date") <= cutoff), df.where(F.col("date") > cutoff)


def last_days(df: DataFrame, days: int) -> DataFrame:
    """Rows of the last days that have rows.

    To be stated before windows that look back: Spark cannot move a filter below them.
    """
    found = df.select("date").distinct().orderBy(F.desc("date")).limit(days)
    return df.where(F.col("date") >= found.agg(F.min("date")).scalar())


def lookback(df: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """History a forecast needs: the last days that have rows, since lags count rows."""
    return last_days(df, settings.lookback_days + 1)


def rows_with_history(df: DataFrame, rows: int) -> DataFrame:
    """(date) of each row that ``rows`` earlier rows of its series precede: those whose lags are known.

    Reads the keys alone, in the order the panel is bucketed and sorted by.
    """
    place = F.row_number().over(W.partitionBy(*SERIES).orderBy("date"))
    return df.select("date", place.alias("place")).where(F.col("place") > rows).select("date")


def sample_weights(
    df: DataFrame, family_code: str = "family", settings: Settings = SETTINGS
) -> DataFrame:
    return df.withColumn(
        "weight",
        F.when(F.col(family_code).isin(settings.top_families), settings.weight).otherwise(1.0),
    )
