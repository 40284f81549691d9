"""Null groups, single groups and zero denominators; a session without presets."""

import os
import subprocess
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import evaluate, explore, features
from shelfcast.operators.quantiles import exact_quantiles
from shelfcast.plans.features import fit_state
from shelfcast.session import bucket_count
from shelfcast.sources.files import scan_csv


def test_no_group_is_lost(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), (None, 5.0), ("c", None)], "k string, sales double"
    )
    got = {r.k: r.median for r in exact_quantiles(df, "sales", {"median": 0.5}, ["k"]).collect()}
    assert got == {"a": 2.0, None: 5.0}
    rows = {r.k: (r["mean"], r.median) for r in explore.mean_median(df, ["k"]).collect()}
    assert rows == {"a": (2.0, 2.0), None: (5.0, 5.0), "c": (None, None)}
    assert {r.k for r in explore.boxplot(df, "k").collect()} == {"a", None}


@pytest.mark.parametrize("totals", [[5.0], [5.0, 5.0, 5.0]])
def test_ranking_of_one_store_and_of_ties(spark, totals):
    rows = [(i, date(2020, 1, 1), t) for i, t in enumerate(totals)]
    df = spark.createDataFrame(rows, "store_nbr int, date date, sales double")
    ranks = {r.ranking_tienda for r in features.store_ranking(df).collect()}
    assert ranks == {(len(totals) + 1) // 2}


def test_champion_without_error(spark):
    zero, one = (spark.createDataFrame([(x,)], "rmse double") for x in (0.0, 1.0))
    row = evaluate.champion_challenger(zero, one).first()
    assert row.gain_pct is None and row.accepted is False


def test_state_leaves_later_rows_out(spark):
    rows = [(1, "f", date(2020, 1, d), float(d)) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "store_nbr int, family string, date date, sales double")
    stats = features.series_stats(df, F.lit(date(2020, 1, 5))).first()
    assert stats.venta_media_historica == 3.0
    assert features.series_stats(df).first().venta_media_historica == 5.5
    assert fit_state.__defaults__ == (None,)


def test_lookback_counts_days_that_have_rows(spark):
    from dataclasses import replace

    from shelfcast.config import SETTINGS
    from shelfcast.operators.folds import lookback

    df = spark.sql("select date_add(date'2020-01-01', cast(3 * id as int)) as date from range(100)")
    kept = lookback(df, replace(SETTINGS, lookback_days=9))
    assert kept.count() == 10
    assert kept.agg(F.min("date")).first()[0] == date(2020, 9, 27)


def test_a_repeated_oil_price_repeats_no_rows(spark):
    from shelfcast.operators.impute import oil_by_day

    days = spark.sql("select date'2020-01-01' as date")
    oil = spark.sql("select date'2020-01-01' as date, double(x) as dcoilwtico from values (1), (3), (null) as t(x)")
    assert [r.dcoilwtico for r in oil_by_day(days, oil).collect()] == [3.0]


def test_buckets_stay_within_what_spark_allows(spark):
    assert bucket_count(spark, 10**13, 10**12) == 100_000


def test_csv_with_a_wrong_number_raises(spark, tmp_path):
    (tmp_path / "oil.csv").write_text("date,dcoilwtico\n2020-01-01,abc\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        scan_csv(spark, "oil", str(tmp_path)).collect()


def test_session_without_presets(tmp_path):
    code = (
        "from shelfcast.session import build_session, shared_folder\n"
        "s = build_session(1, 'bare')\n"
        "a = shared_folder(s)\n"
        "assert a == shared_folder(s) and s.sparkContext.getCheckpointDir()\n"
        "s.range(3).checkpoint().count()\n"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).parents[1])}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]
