"""Queries against their SQL on the smallest tables. SHELFCAST_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from shelfcast.catalog import QUERIES
from tests.oracle_check import _kind, connect, same

CORE = """scan_parquet null_report dup_keys holiday_multi_dates store_coverage panel_profile
describe_sales validate_requests impute_audit holiday_split holdout_split event_window sample_weights
iqr_outliers enrich_panel holiday_resolve oil_by_day oil_interpolate preprocess calendar_features
holiday_impact holiday_distance target_lags_h7 rolling_h7 promo_features oil_lags_day oil_lags_row
trans_features_row store_ranking label_codes label_encode features_h7 walk_forward_folds fold_metrics
cv_summary eval_global eval_by_family eval_by_store eval_by_date eval_reports family_flags champion_challenger
future_grid history_union_future family_segments holiday_effect locale_impact promo_lift
boxplot_stats lookback_history prediction_input forecast_interval predict_store sales_histogram corr_oil_sales seasonal_decompose""".split()
# At this scale a sum ties on rounding.
LARGER_ONLY = {"features_h30"}
NAMES = sorted(set(entry.oracle_sql()) - LARGER_ONLY) if os.environ.get("SHELFCAST_ALL") else CORE


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, small, name):
    result = entry.queries()[name](spark, small)
    kinds = {c: _kind(t) for c, t in result.dtypes}
    relation = con.sql(entry.oracle_sql()[name])
    assert kinds == {c: _kind(t) for c, t in zip(relation.columns, relation.types)}
    assert not same(result.toPandas(), relation.df())


def test_entry_has_five_folds_at_most(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 5 and {"fold", "rmse", "wape"} <= set(rows[0].asDict())


def test_only_models_lack_sql():
    without = set(QUERIES) - set(entry.oracle_sql())
    assert without == {
        "fit_fold", "train_cv", "train_cv_h30", "fit_final", "fit_final_h30", "training_run", "training_run_h7",
        "feature_importance", "evaluation_run", "forecast_h7", "forecast_h30",
    }
