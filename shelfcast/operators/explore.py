"""Analytical queries over the merged panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.config import SETTINGS, Settings
from shelfcast.functions.calendar import flag
from shelfcast.operators.features import holiday_distance
from shelfcast.operators.impute import oil_by_day
from shelfcast.operators.quantiles import exact_quantiles
from shelfcast.session import by_day


def promo() -> Column:
    return flag(F.col("onpromotion") > 0)


def _zero_share() -> Column:
    return F.avg((F.col("sales") == 0).cast("int")) * 100


def with_flags(merged: DataFrame) -> DataFrame:
    return merged.withColumns(
        {"es_festivo": F.col("holiday_type").isNotNull().cast("int"), "tiene_promo": promo()}
    )


def _join_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Add an aggregate to another; a null group is a group too, and none is lost."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(renamed, same, "left").drop(*[f"_{c}" for c in by])


# --- distributions --------------------------------------------------------------


def describe(df: DataFrame, value: str, digits: int = 2) -> DataFrame:
    """Count, mean, deviation, range and quartiles, plus zeros and negatives."""
    v = F.col(value)
    parts = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    quartiles = exact_quantiles(df, value, parts).select(F.struct(*parts)).scalar()
    base = df.agg(
        F.count(v).alias("n"),
        F.round(F.avg(v), digits).alias("mean"),
        F.round(F.stddev_samp(v), digits).alias("std"),
        F.round(F.min(v), digits).cast("double").alias("min"),
        F.round(F.max(v), digits).cast("double").alias("max"),
        F.count_if(v == 0).alias("zeros"),
        F.round(F.avg((v == 0).cast("int")) * 100, 1).alias("pct_zeros"),
        F.count_if(v < 0).alias("negatives"),
    )
    return (
        base.withColumn("_q", quartiles)
        .withColumns({name: F.round(F.col(f"_q.{name}"), digits) for name in parts})
        .drop("_q")
    )


def histogram(df: DataFrame, value: Column, bins: int = 100) -> DataFrame:
    """Equal-width bins between minimum and maximum; empty bins are not listed."""
    values = df.select(value.alias("x")).where(F.col("x").isNotNull())
    edges = values.agg(F.struct(F.min("x").alias("a"), F.max("x").alias("b"))).scalar()
    width = (F.col("e.b") - F.col("e.a")) / bins
    index = F.when(width == 0, 0).otherwise(F.floor((F.col("x") - F.col("e.a")) / width))
    return (
        values.withColumn("e", edges)
        .select(F.least(index, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def iqr_outliers(df: DataFrame, top: int = 10, factor: float = 3.0) -> DataFrame:
    """Rows above Q3 + factor * IQR: total, and the families and stores with most of them."""
    quartiles = exact_quantiles(df, "sales", {"q1": 0.25, "q3": 0.75})
    bound = quartiles.select(F.col("q3") + factor * (F.col("q3") - F.col("q1"))).scalar()
    marked = df.groupBy("family", "store_nbr").agg(
        F.count_if(F.col("sales") > bound).alias("n"), F.count(F.lit(1)).alias("rows")
    )
    keys = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("all").alias("key")),
        F.struct(F.lit("family").alias("kind"), F.col("family").alias("key")),
        F.struct(F.lit("store_nbr").alias("kind"), F.col("store_nbr").cast("string").alias("key")),
    )
    total = F.col("kind") == "total"
    order = W.partitionBy("kind").orderBy(F.desc("n"), "key")
    return (
        marked.withColumn("k", F.explode(keys))
        .groupBy("k.kind", "k.key")
        .agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
        .where(total | (F.col("n") > 0))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)  # each task keeps its best before the shuffle
        .select(
            "kind",
            "key",
            "n",
            F.when(total, F.round(F.col("n") / F.col("rows") * 100, 2)).alias("pct"),
        )
    )


def boxplot(df: DataFrame, by: str) -> DataFrame:
    """Quartiles and the whiskers inside 1.5 IQR."""
    q = exact_quantiles(df, "sales", {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by])
    fences = q.withColumns(
        {
            "lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
            "hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
        }
    )
    # Whiskers come from the values that occur, counted once per group.
    values = df.select(by, "sales").distinct()
    inside = F.col("sales").between(F.col("lo"), F.col("hi"))
    return (
        _join_groups(values, fences, [by])
        .where(inside)
        .groupBy(by, "q1", "median", "q3")
        .agg(F.min("sales").alias("whisker_low"), F.max("sales").alias("whisker_high"))
    )


def mean_median(df: DataFrame, by: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Mean, exact median and further aggregates per group, rounded to cents."""
    stats = df.groupBy(*by).agg(
        F.round(F.avg("sales"), 2).alias("mean"),
        *[c.alias(name) for name, c in (extra or {}).items()],
    )
    medians = exact_quantiles(df, "sales", {"median": 0.5}, by).withColumn(
        "median", F.round("median", 2)
    )
    return _join_groups(stats, medians, by)


# --- families and stores ----------------------------------------------------------


def zeros_by_family(df: DataFrame) -> DataFrame:
    return df.groupBy("family").agg(F.round(_zero_share(), 1).alias("pct_zeros"))


def family_segments(df: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Each family with its segment and the size of the segment."""
    share = F.col("pct_zeros")
    segment = (
        F.when(share < settings.zero_share_core, "core")
        .when(share > settings.zero_share_sporadic, "sporadic")
        .otherwise("intermediate")
    )
    return (
        zeros_by_family(df)
        .withColumn("segment", segment)
        .withColumn("n_in_segment", F.count(F.lit(1)).over(W.partitionBy("segment")))
    )


def total_sales(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("sales").alias("total_sales"))


def edges_of_ranking(totals: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first and the last ``n`` rows of a ranking."""
    first = totals.orderBy(F.desc("total_sales"), key).limit(n).withColumn("edge", F.lit("top"))
    last = totals.orderBy("total_sales", F.desc(key)).limit(n).withColumn("edge", F.lit("bottom"))
    return first.unionByName(last)


# --- time -----------------------------------------------------------------------


def monthly_sales(df: DataFrame) -> DataFrame:
    return total_sales(df, F.trunc("date", "month").alias("month"))


def yearly_comparison(df: DataFrame) -> DataFrame:
    return total_sales(df, F.year("date").alias("year"), F.month("date").alias("month"))


def _by_name(df: DataFrame, number: Column, name: Column, value: str) -> DataFrame:
    """Means by a named part of the date, with its order and the extremes marked.

    Means are first reduced to sums per day, so names are formatted per day only.
    """
    per_day = df.groupBy("date").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    means = (
        per_day.withColumns({"position": number, "name": name})
        .groupBy("position", "name")
        .agg(F.round(F.try_divide(F.sum("s"), F.sum("n")), 6).alias("mean_value"))
    )
    every = W.partitionBy()  # at most twelve rows
    return means.withColumns(
        {
            "is_max": F.col("mean_value") == F.max("mean_value").over(every),
            "is_min": F.col("mean_value") == F.min("mean_value").over(every),
        }
    )


def by_weekday(df: DataFrame, value: str = "sales") -> DataFrame:
    return _by_name(df, F.weekday("date"), F.date_format("date", "EEEE"), value)


def by_month(df: DataFrame, value: str = "sales") -> DataFrame:
    return _by_name(df, F.month("date"), F.date_format("date", "MMMM"), value)


def event_window(df: DataFrame, day: str, days: int = 30) -> DataFrame:
    """Daily totals around one day; the filter reaches the scan."""
    center = F.lit(day).cast("date")
    near = df.where(F.col("date").between(F.date_sub(center, days), F.date_add(center, days)))
    return total_sales(near, "date")


# --- holidays -------------------------------------------------------------------


def holiday_counts(holidays: DataFrame, top: int = 10) -> DataFrame:
    """Counts by type, locale and transfer, distinct dates and the commonest descriptions."""

    def counted(column: str) -> DataFrame:
        return holidays.groupBy(F.col(column).cast("string").alias("value")).agg(
            F.count(F.lit(1)).alias("n")
        ).select(F.lit(column).alias("kind"), "value", "n")

    dates = holidays.agg(F.count_distinct("date").alias("n")).select(
        F.lit("distinct_dates").alias("kind"), F.lit("all").alias("value"), "n"
    )
    common = counted("description").orderBy(F.desc("n"), "value").limit(top)
    result = dates.unionByName(common)
    for column in ("type", "locale", "transferred"):
        result = result.unionByName(counted(column))
    return result


def holiday_effect(merged: DataFrame) -> DataFrame:
    return mean_median(
        with_flags(merged), ["es_festivo"], {"std": F.round(F.stddev_samp("sales"), 2)}
    )


def holiday_type_mean(merged: DataFrame) -> DataFrame:
    return (
        merged.where(F.col("holiday_type").isNotNull())
        .groupBy("holiday_type")
        .agg(F.round(F.avg("sales"), 6).alias("mean_sales"))
    )


def locale_impact(merged: DataFrame) -> DataFrame:
    """Sales on holidays by locale, and the mean of days without one.

    ``locale`` is that of the national holiday of the day.
    """
    n = F.count("sales")
    on_holidays = mean_median(
        merged.where(F.col("holiday_type").isNotNull() & F.col("locale").isNotNull()),
        ["locale"],
        {"n": n},
    ).select(F.lit("holiday").alias("form"), "locale", "mean", "median", "n")
    every_day = (
        merged.groupBy(F.coalesce("locale", F.lit("Normal")).alias("locale"))
        .agg(F.round(F.avg("sales"), 2).alias("mean"))
        .select(
            F.lit("all").alias("form"),
            "locale",
            "mean",
            F.lit(None).cast("double").alias("median"),
            F.lit(None).cast("bigint").alias("n"),
        )
    )
    return on_holidays.unionByName(every_day)


def daily_with_distance(merged: DataFrame) -> DataFrame:
    """Daily totals with the distance to the holidays around them: one pass over the panel."""
    days = with_flags(merged).groupBy("date").agg(
        F.sum("sales").alias("total_sales"), F.max("es_festivo").alias("es_festivo")
    )
    return holiday_distance(days)


def holiday_window(merged: DataFrame, reach: int = 7) -> DataFrame:
    """Mean daily total for each distance before and after a holiday."""
    days = daily_with_distance(merged)

    def side(column: str, label: str) -> DataFrame:
        return (
            days.where(F.col(column) <= reach)
            .groupBy(F.col(column).alias("days"))
            .agg(F.round(F.avg("total_sales"), 6).alias("mean_total"))
            .withColumn("side", F.lit(label))
        )

    return side("dias_para_siguiente_festivo", "before").unionByName(
        side("dias_desde_ultimo_festivo", "after")
    )


def holiday_promo(merged: DataFrame) -> DataFrame:
    def label(c: str) -> Column:
        return F.when(F.col(c) == 1, "Sí").otherwise("No")

    return (
        with_flags(merged)
        .groupBy(label("es_festivo").alias("Festivo"), label("tiene_promo").alias("Promocion"))
        .agg(F.round(F.avg("sales"), 2).alias("mean_sales"))
    )


def holiday_detail(merged: DataFrame) -> DataFrame:
    """Holidays without promotion against normal days without promotion."""
    plain = merged.where(promo() == 0)
    baseline = plain.where(F.col("holiday_type").isNull()).agg(F.avg("sales")).scalar()
    mean = F.round(F.avg("sales"), 2)
    return (
        plain.where(F.col("holiday_type").isNotNull())
        .groupBy("holiday_description")
        .agg(mean.alias("mean"), F.count("sales").alias("n"))
        .withColumn(
            "vs_baseline",
            F.round(F.try_divide(F.col("mean") - baseline, baseline) * 100, 1),
        )
    )


def zeros_by_holiday(merged: DataFrame) -> DataFrame:
    return with_flags(merged).groupBy("es_festivo").agg(F.round(_zero_share(), 1).alias("pct_zeros"))


# --- promotions, oil, transactions ------------------------------------------------


def promo_impact(df: DataFrame) -> DataFrame:
    flagged = df.withColumn("tiene_promo", promo())
    n = F.count(F.lit(1))
    counted = mean_median(flagged, ["tiene_promo"], {"n": n})
    total = F.sum("n").over(W.partitionBy())  # two rows
    return counted.withColumn("share_pct", F.round(F.col("n") / total * 100, 1))


def promo_lift(df: DataFrame) -> DataFrame:
    """Mean sales with promotion relative to the mean without."""
    sold = F.avg(F.when(promo() == 1, F.col("sales")))
    plain = F.avg(F.when(promo() == 0, F.col("sales")))
    return df.groupBy("family").agg(
        F.round(F.avg(promo()), 3).alias("pct_promo"),
        F.round(sold / F.nullif(plain, F.lit(0.0)), 3).alias("lift_promo"),
    )


def sales_vs_oil(df: DataFrame, oil: DataFrame) -> DataFrame:
    """Daily totals with the quoted and the interpolated price; gaps before the first stay null."""
    days = total_sales(df, "date")
    filled = oil_by_day(days.select("date"), oil, edges=False).withColumnRenamed(
        "dcoilwtico", "oil_interpolated"
    )
    return days.join(by_day(oil), "date", "left").join(by_day(filled), "date", "left")


def corr_oil_sales(daily_oil: DataFrame) -> DataFrame:
    """Pearson correlation of the quoted price and the daily total."""
    quoted = F.when(F.col("oil_interpolated").isNotNull(), F.col("dcoilwtico"))
    return daily_oil.agg(F.round(F.corr(quoted, "total_sales"), 3).alias("corr"))


def oil_sales_trend(daily_oil: DataFrame, points: int = 100) -> DataFrame:
    """Straight line of daily totals on the interpolated price, at evenly spaced prices."""
    x, y = F.col("oil_interpolated"), F.col("total_sales")
    line = daily_oil.where(x.isNotNull()).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.min(x).alias("x0"),
        F.max(x).alias("x1"),
    )
    step = (F.col("x1") - F.col("x0")) / (points - 1)
    return (
        line.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", F.col("x0") + F.col("point") * step)
        .select(
            "point",
            F.round("x", 6).alias("oil"),
            F.round(F.col("intercept") + F.col("slope") * F.col("x"), 4).alias("trend"),
        )
    )


def transactions_profile(transactions: DataFrame) -> DataFrame:
    """Mean transactions by store and by weekday."""
    stores = transactions.groupBy(F.col("store_nbr").cast("string").alias("key")).agg(
        F.round(F.avg("transactions"), 6).alias("mean_value")
    )
    days = by_weekday(transactions, "transactions")
    return stores.select(
        F.lit("store").alias("kind"), "key", "mean_value", F.lit(None).cast("boolean").alias("is_max")
    ).unionByName(
        days.select(F.lit("weekday").alias("kind"), F.col("name").alias("key"), "mean_value", "is_max")
    )


def trans_sales(df: DataFrame) -> DataFrame:
    """Sales and transactions per day and store; days without a count are left out."""
    return (
        df.groupBy("date", "store_nbr")
        .agg(F.sum("sales").alias("total_sales"), F.max("transactions").alias("transactions"))
        .where(F.col("transactions").isNotNull())
    )


def corr_trans_sales(per_store_day: DataFrame) -> DataFrame:
    return per_store_day.agg(
        F.round(F.corr(F.col("transactions").cast("double"), "total_sales"), 3).alias("corr")
    )
