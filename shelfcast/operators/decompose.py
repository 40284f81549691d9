"""Additive decomposition of a daily series into trend, season and rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seasonal_decompose(
    df: DataFrame, value: str, period: int = 365, keys: list[str] | None = None
) -> DataFrame:
    """Centred moving average, mean of each phase around it, and what is left.

    The trend is extended over both edges by the straight line through the
    ``period`` values nearest to them, the very last value not counted. Each series has one row per day; without keys
    the table is one such series.
    """
    keys = keys or []
    rows = W.partitionBy(*keys) if keys else W.partitionBy()
    ordered = rows.orderBy("date")
    half = period // 2
    frame = ordered.rowsBetween(-half, half)
    y, t = F.col(value), F.col("t")
    if period % 2:
        mean, full = F.avg(y).over(frame), F.count(y).over(frame) == period
    else:
        # An even period weighs the two outer days by half.
        ends = F.lag(y, half).over(ordered) + F.lead(y, half).over(ordered)
        mean = (F.sum(y).over(frame) - ends / 2) / period
        full = F.count(y).over(frame) == period + 1
    df = df.withColumn("t", F.row_number().over(ordered) - 1).withColumn(
        "centred", F.when(full, mean)
    )
    known = F.when(F.col("centred").isNotNull(), t)
    df = df.withColumns({"t0": F.min(known).over(rows), "t1": F.max(known).over(rows)})

    def line(inside):
        slope = F.regr_slope(F.when(inside, F.col("centred")), t).over(rows)
        start = F.regr_intercept(F.when(inside, F.col("centred")), t).over(rows)
        return start, slope

    before_last = t < F.col("t1")
    first = line(before_last & (t < F.col("t0") + period))
    last = line(before_last & (t >= F.col("t1") - period))
    df = df.withColumns({"a0": first[0], "b0": first[1], "a1": last[0], "b1": last[1]})
    trend = (
        F.when(t < F.col("t0"), F.col("a0") + F.col("b0") * t)
        .when(t > F.col("t1"), F.col("a1") + F.col("b1") * t)
        .otherwise(F.col("centred"))
    )
    df = df.withColumn("trend", trend).withColumn("phase", t % period)
    phase = W.partitionBy(*keys, "phase")
    df = df.withColumn("phase_mean", F.avg(y - F.col("trend")).over(phase))
    # The grand mean weighs every phase once, however many days it has.
    once = F.row_number().over(phase.orderBy("date")) == 1
    df = df.withColumn("once", once)
    grand = F.avg(F.when(F.col("once"), F.col("phase_mean"))).over(rows)
    return df.withColumn("seasonal", F.col("phase_mean") - grand).select(
        *keys,
        "date",
        y.alias("observed"),
        "trend",
        "seasonal",
        (y - F.col("trend") - F.col("seasonal")).alias("resid"),
    )
