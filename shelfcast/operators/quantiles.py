"""Exact quantiles with linear interpolation, without one task per group.

The built-in exact percentile keeps every distinct value of a group in one buffer.
Here values are counted, and only a stretch of values around each wanted rank is put
in order. Where a stretch has too many values, a quantile sketch splits it, the exact
counts of its parts say which of them holds the rank, and that part is the next stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.session import sized, staged

# Distinct values that one task orders, and the parts that a longer stretch is split into.
ORDERED = 1 << 17
PARTS = 16
ACCURACY = 1000


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None, ordered: int = ORDERED
) -> DataFrame:
    """One row per group, one column per named probability. Nulls do not count; a null group is a group."""
    keys = {f"_by{i}": c for i, c in enumerate(by or [])}
    freq = staged(
        df.where(F.col(value).isNotNull())
        .groupBy(*[F.col(c).alias(k) for k, c in keys.items()], F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n")),
        "frequencies",
    )
    ranks, areas = _areas(freq, list(keys), probs, ordered)
    inside = W.partitionBy(*keys, "_before").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = _within(freq, areas, list(keys)).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    same = _equal(list(keys), "_before")
    here = (F.col("w._rank") < F.col("v._upto")) & (F.col("w._rank") >= F.col("v._upto") - F.col("v._n"))
    picked = placed.alias("v").join(sized(ranks).alias("w"), same & here)

    def quantile(name: str, p: float) -> Column:
        here = F.col("_name") == name
        low, high = F.min(F.when(here, F.col("_v"))), F.max(F.when(here, F.col("_v")))
        exact = F.lit(p) * (F.max("_total") - 1)
        return (low + (high - low) * (exact - F.floor(exact))).alias(name)

    picked = picked.select(*[F.col(f"w.{k}").alias(c) for k, c in keys.items()], "_name", "_total", "_v")
    return picked.groupBy(*keys.values()).agg(*[quantile(name, p) for name, p in probs.items()])


def _equal(keys: list[str], *more: str) -> Column:
    """Equality of the group, null or not, and of further columns, between the sides v and w."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"v.{k}").eqNullSafe(F.col(f"w.{k}"))
    for c in more:
        same = same & (F.col(f"v.{c}") == F.col(f"w.{c}"))
    return same


def _within(freq: DataFrame, areas: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each area, with the rows before it. Areas are few: some for each group."""
    low, high = F.col("w._low"), F.col("w._high")
    inside = (low.isNull() | (F.col("v._v") >= low)) & (high.isNull() | (F.col("v._v") <= high))
    joined = freq.alias("v").join(sized(areas).alias("w"), _equal(keys) & inside)
    return joined.select(*[F.col(f"v.{k}") for k in keys], "v._v", "v._n", "w._before")


def _areas(freq: DataFrame, keys: list[str], probs: dict[str, float], ordered: int) -> tuple[DataFrame, DataFrame]:
    """The wanted ranks, each with the rows before its area, and the areas: few enough values each.

    An area is known inside its group by the number of rows before it.
    """
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), side(F.lit(p) * (F.col("_total") - 1)).alias("rank"))
            for name, p in probs.items()
            for side in (F.floor, F.ceil)
        ]
    )
    whole = freq.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_m"))
    bounds = {"_low": F.lit(None).cast("double"), "_high": F.lit(None).cast("double"), "_before": F.lit(0).cast("long")}
    ranks = whole.withColumns(bounds).withColumn("_w", F.explode(wanted))
    ranks = staged(
        ranks.select(*keys, "_total", "_m", *bounds, F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank")).distinct(),
        "ranks",
    )
    area = [*keys, "_before", "_low", "_high"]
    while not (wide := ranks.where(F.col("_m") > ordered)).isEmpty():
        parts = _parts(freq, wide.select(area).distinct(), keys)
        held = wide.alias("v").join(sized(parts).alias("w"), _equal(keys, "_before")).where(
            (F.col("v._rank") >= F.col("w._start")) & (F.col("v._rank") < F.col("w._start") + F.col("w._k"))
        )
        narrowed = held.select(
            *[F.col(f"v.{k}") for k in keys], "v._total", "w._m", "w._low", "w._high",
            F.col("w._start").alias("_before"), "v._name", "v._rank",
        )
        ranks = staged(ranks.where(F.col("_m") <= ordered).unionByName(narrowed), "ranks")
    return ranks, ranks.select(area).distinct()


def _parts(freq: DataFrame, areas: DataFrame, keys: list[str]) -> DataFrame:
    """Each area cut at the quantiles of a sketch: exact rows, values and ends of its parts."""
    values = _within(freq, areas, keys)
    steps = [i / PARTS for i in range(1, PARTS)]
    cuts = values.groupBy(*keys, "_before").agg(F.percentile_approx("_v", steps, ACCURACY).alias("_cuts"))
    cut = values.alias("v").join(sized(cuts).alias("w"), _equal(keys, "_before"))
    number = F.size(F.filter("w._cuts", lambda c: c <= F.col("v._v"))).alias("_part")
    parts = (
        cut.select(*[F.col(f"v.{k}") for k in keys], "v._before", "v._v", "v._n", number)
        .groupBy(*keys, "_before", "_part")
        .agg(
            F.sum("_n").alias("_k"), F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
    )
    earlier = W.partitionBy(*keys, "_before").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # 16 rows
    return parts.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_k").over(earlier), F.lit(0)))
