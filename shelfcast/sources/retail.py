"""The six retail tables, shaped from the warehouse tables.

Sales lines come from lineitem, supplier and part; the oil price from orders;
stores from nation and region. A store is a nation by default, or a supplier
(``store="supplier"``) for a panel that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.config import SERIES
from shelfcast.session import bucket_count, file_listing, table

# Yearly holiday rules (month, day, type, locale, locale_name,
# description, transferred). Every year of the sales data gets one copy.
HOLIDAY_RULES = [
    (1, 1, "Holiday", "National", "Ecuador", "Primer dia del ano", False),
    (2, 12, "Holiday", "National", "Ecuador", "Carnaval", False),
    (5, 1, "Holiday", "National", "Ecuador", "Dia del Trabajo", True),
    (5, 1, "Event", "National", "Ecuador", "Dia de la Madre", False),
    (5, 24, "Transfer", "National", "Ecuador", "Traslado Batalla de Pichincha", False),
    (11, 28, "Event", "National", "Ecuador", "Black Friday", False),
    (12, 25, "Holiday", "National", "Ecuador", "Navidad", False),
    (4, 16, "Event", "National", "Ecuador", "Terremoto Manabi", False),
    (4, 1, "Holiday", "Regional", "ASIA", "Provincializacion", False),
    (12, 25, "Additional", "Regional", "EUROPE", "Navidad Regional", False),
    (7, 3, "Holiday", "Local", "NATION_3", "Fundacion de Quito", False),
    (7, 3, "Holiday", "Local", "NATION_7", "Cantonizacion", True),
    (7, 3, "Holiday", "Local", "NATION_7", "Fundacion", False),
    (4, 1, "Holiday", "Local", "NATION_2", "Independencia de Cuenca", False),
]
PROMO_DISCOUNT = 0.08


class Retail:
    """Lazy retail tables over one folder of warehouse tables.

    The daily sales, the dense panel, the transactions and the oil price are
    written once per application, because every query starts from them.
    """

    def __init__(self, spark: SparkSession, folder: str, store: str = "nation"):
        self.spark, self.folder, self.store = spark, folder.rstrip("/"), store
        # what is written belongs to these very files
        self.source = f"{self.folder}#{store}#{file_listing(spark, self.folder)}"
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    def _written(self, name, build, **kw) -> DataFrame:
        return table(self.spark, self.source, name, build, **kw)

    def _lines(self) -> DataFrame:
        """Sale lines with the store key. Spark broadcasts supplier if its files are small."""
        store = "s_nationkey" if self.store == "nation" else "s_suppkey"
        supplier = self.raw("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), (F.col(store) + 1).cast("int").alias("store_nbr")
        )
        return (
            self.raw("lineitem")
            .select(
                F.col("l_shipdate").cast("date").alias("date"),
                "l_suppkey",
                "l_partkey",
                "l_orderkey",
                "l_quantity",
                "l_discount",
            )
            .join(supplier, "l_suppkey")
        )

    def daily(self) -> DataFrame:
        """One row per date, store and family with sales. Sums combine before the shuffle."""

        def build():
            part = self.raw("part").select(
                F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("family")
            )
            return (
                self._lines()
                .join(part, "l_partkey")
                .groupBy("date", *SERIES)
                .agg(
                    F.sum("l_quantity").alias("sales"),
                    F.count_if(F.col("l_discount") >= PROMO_DISCOUNT)
                    .cast("int")
                    .alias("onpromotion"),
                )
            )

        return self._written("daily", build)

    def train(self) -> DataFrame:
        """Dense panel, zero filled, bucketed by series.

        Series and daily sales move to the buckets while they are small; the
        zero rows are made there, so the dense rows are never shuffled.
        """

        def build():
            daily, n = self.daily(), self.buckets()
            days = daily.agg(F.array_sort(F.collect_set("date")))  # at most one entry per day
            zeros = (
                daily.select(*SERIES)
                .distinct()
                .repartition(n, *SERIES)
                .select(
                    F.explode(days.scalar()).alias("date"),
                    *SERIES,
                    F.lit(0.0).alias("sales"),
                    F.lit(0).alias("onpromotion"),
                )
            )
            return (
                zeros.unionByName(daily.repartition(n, *SERIES))
                .groupBy("date", *SERIES)
                .agg(
                    F.sum("sales").alias("sales"),
                    F.sum("onpromotion").cast("int").alias("onpromotion"),
                )
            )

        return self._written("train", build, keys=SERIES, buckets=self.buckets())

    def buckets(self) -> int:
        if not hasattr(self, "_buckets"):
            shape = self.daily().agg(
                F.count_distinct("date").alias("days"),
                F.count_distinct(*SERIES).alias("series"),
            )
            days, series = shape.first()
            self._buckets = bucket_count(self.spark, days * series, series)
        return self._buckets

    def test(self) -> DataFrame:
        """The last 16 dates without the target."""
        train = self.train()
        first = (
            train.select("date").distinct().orderBy(F.desc("date")).limit(16).agg(F.min("date"))
        )
        return train.where(F.col("date") >= first.scalar()).drop("sales")

    def stores(self) -> DataFrame:
        return self._written("stores", self._stores)

    def _stores(self) -> DataFrame:
        region = self.raw("region").withColumnRenamed("r_regionkey", "n_regionkey")
        nation = self.raw("nation").join(region, "n_regionkey")
        key = F.col("n_nationkey")
        attributes = [
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            F.element_at(F.array(*map(F.lit, "ABCDE")), (key % 5 + 1).cast("int")).alias("type"),
            ((key * 7) % 17 + 1).cast("int").alias("cluster"),
        ]
        if self.store == "nation":
            return nation.select((key + 1).cast("int").alias("store_nbr"), *attributes)
        supplier = self.raw("supplier").withColumnRenamed("s_nationkey", "n_nationkey")
        return supplier.join(nation, "n_nationkey").select(
            (F.col("s_suppkey") + 1).cast("int").alias("store_nbr"), *attributes
        )

    def transactions(self) -> DataFrame:
        """Distinct orders per date and store; Spark deduplicates before it counts."""

        def build():
            part = self.raw("part").select(F.col("p_partkey").alias("l_partkey"))
            return (
                self._lines()
                .join(part, "l_partkey", "left_semi")
                .groupBy("date", "store_nbr")
                .agg(F.count_distinct("l_orderkey").cast("int").alias("transactions"))
            )

        return self._written("transactions", build)

    def oil(self) -> DataFrame:
        """Weekday prices with some missing quotes."""

        def build():
            day = F.col("o_orderdate").cast("date").alias("date")
            price = F.round(F.avg("o_totalprice") / 1000, 2)
            return (
                self.raw("orders")
                .groupBy(day)
                .agg(F.min("o_custkey").alias("first_customer"), price.alias("price"))
                .where(F.weekday("date") < 5)
                .select(
                    "date",
                    F.when(F.col("first_customer") % 11 != 0, F.col("price")).alias("dcoilwtico"),
                )
            )

        return self._written("oil", build)

    def holidays(self) -> DataFrame:
        """Holiday rules laid over every year that has sales."""

        def build():
            names = ["m", "d", "type", "locale", "locale_name", "description", "transferred"]
            rules = F.array(
                *[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in HOLIDAY_RULES]
            )
            return (
                self.daily()
                .select(F.year("date").alias("y"))
                .distinct()
                .select("y", F.explode(rules).alias("h"))
                .select(
                    F.make_date("y", "h.m", "h.d").alias("date"), *[f"h.{n}" for n in names[2:]]
                )
            )

        return self._written("holidays", build)
