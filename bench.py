"""Benchmark: prints one JSON line with the seconds of each headline query.

``panel`` and ``panel_suppliers`` are the cold builds from the warehouse tables;
the queries after them start from what those wrote. The ``_suppliers`` runs use
one store per supplier: 15 million panel rows at scale factor 0.1.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from shelfcast.catalog import QUERIES, views
from shelfcast.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = """enrich_panel preprocess features_h7 features_h30 rolling_h7 target_lags_h7
oil_interpolate oil_lags_row label_encode fold_metrics walk_forward_folds eval_by_family
eval_by_store eval_by_date prediction_input forecast_interval null_report dup_keys describe_sales
iqr_outliers boxplot_stats holiday_effect holiday_window promo_lift dow_sales trans_sales
sales_vs_oil seasonal_decompose sales_histogram""".split()
LARGE = ["features_h7", "fold_metrics", "describe_sales", "holiday_effect", "promo_lift"]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(seconds: dict[str, float], name: str, action) -> None:
    start = time.perf_counter()
    action()
    seconds[name] = round(time.perf_counter() - start, 3)


def main() -> None:
    spark = build_session(CPUS, "shelfcast-bench")
    seconds: dict[str, float] = {}
    timed(seconds, "session_warmup", lambda: run(spark.range(1000)))
    for suffix, store, names in (("", "nation", HEADLINES), ("_suppliers", "supplier", LARGE)):

        def build(store=store):
            tables = views(spark, FOLDER, store)
            tables.processed()
            tables.state()

        timed(seconds, f"panel{suffix}", build)
        for name in names:
            timed(
                seconds,
                f"{name}{suffix}",
                lambda name=name, store=store: run(QUERIES[name](views(spark, FOLDER, store))),
            )
    seconds.pop("session_warmup")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
