"""Checks and profiles of tables."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import PANEL_KEYS

log = logging.getLogger(__name__)


def check_columns(df: DataFrame, name: str, expected: list[str]) -> list[str]:
    """Raise on missing columns, warn about extra ones and return those."""
    missing = [c for c in expected if c not in df.columns]
    extra = [c for c in df.columns if c not in expected]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    if extra:
        log.warning("%s: extra columns %s", name, extra)
    return extra


def null_report(df: DataFrame) -> DataFrame:
    """Null count and percentage of the columns that have nulls: one pass over the table."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return unpivot(counts, df.columns, "column_name", "nulls", ["_rows"]).where("nulls > 0").select(
        "column_name",
        "nulls",
        F.round(F.col("nulls") / F.col("_rows") * 100, 2).alias("pct"),
    )


def unpivot(
    df: DataFrame, columns: list[str], label: str, value: str, ids: list[str] | None = None
) -> DataFrame:
    return df.unpivot(ids or [], columns, label, value)


def check_schema(df: DataFrame, name: str, expected: list[str]) -> DataFrame:
    """Column contract, then the null report."""
    check_columns(df, name, expected)
    return null_report(df)


def duplicate_keys(df: DataFrame, keys: list[str] = PANEL_KEYS) -> DataFrame:
    """Rows beyond the first of each key, in total."""
    per_key = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return per_key.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates"))


def require_unique(df: DataFrame, keys: list[str] = PANEL_KEYS) -> DataFrame:
    """Fail the job if a key repeats. Costs one aggregation, so it is asked for, not implied."""
    found = duplicate_keys(df, keys).first()["duplicates"]
    if found:
        raise ValueError(f"{found} unexpected duplicates of {keys}")
    return df


def check_features(df: DataFrame, features: list[str]) -> DataFrame:
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df


def column_difference(df: DataFrame, expected: list[str]) -> DataFrame:
    """(column_name, status, filled): each column that the table has, lacks or has besides, with its filled rows."""
    missing = [c for c in expected if c not in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).withColumns({c: F.lit(None).cast("long") for c in missing})
    status = F.when(F.col("column_name").isin(missing), "missing").when(F.col("column_name").isin(expected), "expected").otherwise("extra")
    return unpivot(counts, [*df.columns, *missing], "column_name", "filled").select("column_name", status.alias("status"), "filled")


def repeated_dates(holidays: DataFrame) -> DataFrame:
    """All holiday rows on dates that occur more than once."""
    counts = holidays.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return holidays.join(counts, "date")


def inspect_table(df: DataFrame, order: list[str], date: str = "date", edge: int = 3) -> DataFrame:
    """First and last rows of a table next to its row count and date range."""
    keys = [F.col(c) for c in order]
    shape = df.agg(
        F.struct(
            F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("d0"), F.max(date).alias("d1")
        )
    ).scalar()
    head = df.orderBy(*keys).limit(edge).withColumn("edge", F.lit("first"))
    tail = df.orderBy(*[k.desc() for k in keys]).limit(edge).withColumn("edge", F.lit("last"))
    return (
        head.unionByName(tail)
        .withColumn("_shape", shape)
        .withColumns(
            {
                "n_rows": F.col("_shape.n_rows"),
                "min_date": F.col("_shape.d0"),
                "max_date": F.col("_shape.d1"),
            }
        )
        .drop("_shape")
    )


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys on both sides and whether the two sets are equal."""
    both = (
        left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(key)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    return both.agg(
        F.sum("l").alias("n_left"),
        F.sum("r").alias("n_right"),
        (F.count_if(F.col("l") != F.col("r")) == 0).alias("equal_sets"),
    )


def panel_profile(panel: DataFrame) -> DataFrame:
    """Size of a panel. Series are reduced first, so no distinct count sees every row."""
    per_series = panel.groupBy("store_nbr", "family").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("d0"), F.max("date").alias("d1")
    )
    return per_series.agg(
        F.sum("n").alias("n_rows"),
        F.min("d0").alias("min_date"),
        F.max("d1").alias("max_date"),
        F.count_distinct("store_nbr").alias("n_stores"),
        F.count_distinct("family").alias("n_families"),
        F.count(F.lit(1)).alias("n_series"),
    )


def imputation_audit(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Null counts of the imputed columns on both sides, one pass each."""

    def nulls(df: DataFrame, stage: str) -> DataFrame:
        counts = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
        return unpivot(df.agg(*counts), columns, "column_name", "nulls").withColumn(
            "stage", F.lit(stage)
        )

    return nulls(before, "before").unionByName(nulls(after, "after"))


def target_range(processed: DataFrame) -> DataFrame:
    return processed.agg(
        F.round(F.min("sales_raw"), 2).alias("min_raw"),
        F.round(F.max("sales_raw"), 2).alias("max_raw"),
        F.round(F.min("sales"), 2).alias("min_log"),
        F.round(F.max("sales"), 2).alias("max_log"),
    )


def lag_nulls(df: DataFrame, lag_columns: list[str]) -> DataFrame:
    """Share of nulls per lag column and the rows that dropping them removes."""
    any_null = reduce(Column.__or__, [F.col(c).isNull() for c in lag_columns])
    shares = df.agg(
        F.count_if(any_null).alias("rows_dropped"),
        *[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 4).alias(c) for c in lag_columns],
    )
    return unpivot(shares, lag_columns, "column_name", "null_pct", ["rows_dropped"])


def days_without_quote(oil: DataFrame) -> DataFrame:
    return oil.where(F.col("dcoilwtico").isNull()).select("date")


def validate_requests(requests: DataFrame, n_stores: int, n_families: int) -> DataFrame:
    """Each request with its verdict and the first rule it breaks."""
    reason = (
        F.when(~F.coalesce(F.col("store_nbr").between(1, n_stores), F.lit(False)), "store_nbr")
        .when(~F.coalesce(F.col("horizon").isin(7, 30), F.lit(False)), "horizon")
        .when(~F.coalesce(F.col("family").between(0, n_families - 1), F.lit(True)), "family")
    )
    return requests.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
