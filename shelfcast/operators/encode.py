"""Label codes: the position of a value among the sorted values of its column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.ranges import range_positions
from shelfcast.session import sized


def fit_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tidy dictionary (column_name, value, code). Numbers sort as numbers, text by bytes.

    The combinations that occur are reduced first, so each row is hashed once
    and only the few combinations are unpivoted. Values are dealt out by ranges, so a
    column may have more of them than one task can order.
    """
    kinds = dict(df.dtypes)
    found = df.select(*columns).distinct()
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).cast("string").alias("value"),
                (F.lit(None) if kinds[c] == "string" else F.col(c)).cast("double").alias("number"),
            )
            for c in columns
        ]
    )
    values = (
        found.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .where(F.col("value").isNotNull())
        .distinct()
    )
    placed = range_positions(values, [F.col("number").asc(), F.col("value").asc()], by="column_name")
    return placed.select("column_name", "value", F.col("position").cast("int").alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """Replace values by their codes; a null or unknown value becomes -1."""
    names = df.columns
    codes = sized(codes)
    for c in columns:
        side = codes.where(F.col("column_name") == c).select(
            F.col("value").alias(f"_{c}"), F.col("code").alias(f"_{c}_code")
        )
        df = df.join(side, F.col(c).cast("string") == F.col(f"_{c}"), "left")
    return df.select(
        *[
            F.coalesce(f"_{n}_code", F.lit(-1)).alias(n) if n in columns else F.col(n)
            for n in names
        ]
    )


def decode(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """The inverse of ``apply_codes`` for one column."""
    side = codes.where(F.col("column_name") == column).select(
        F.col("code").alias(column), F.col("value").alias("_value")
    )
    return df.join(sized(side), column, "left").drop(column).withColumnRenamed("_value", column)
