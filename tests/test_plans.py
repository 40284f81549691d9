"""Files, preprocessing, features, training and forecasts end to end on a small panel."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.config import Settings
from shelfcast.operators import evaluate as E
from shelfcast.operators.features import narrow_types
from shelfcast.operators.folds import holdout_split
from shelfcast.plans import features as P
from shelfcast.plans import forecast as FC
from shelfcast.plans import training as TR
from shelfcast.plans.preprocess import preprocess
from shelfcast.session import BROADCAST_ROWS, by_day, is_small, run_folder, sized, table
from shelfcast.sources import files

START = dt.date(2020, 1, 1)
SETTINGS = Settings(n_folds=2, val_weeks=1, test_weeks=1, top_families=[0])
PARAMS = TR.TreeParams(rounds=3, step=0.3, depth=3, min_rows=5, loss="absolute", bins=32)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    dates = [START + dt.timedelta(i) for i in range(420)]
    train = pd.MultiIndex.from_product([dates, [1, 2], ["A", "B"]]).to_frame(index=False)
    train.columns = ["date", "store_nbr", "family"]
    train["sales"] = np.round(rng.gamma(2, 3, len(train)), 2)
    train["onpromotion"] = rng.integers(0, 3, len(train))
    train["store_nbr"] = train["store_nbr"].astype("int32")
    test = train[train["date"] > dates[-8]].drop(columns="sales")
    oil = [(d, float(50 + i % 9)) for i, d in enumerate(dates) if d.weekday() < 5 and i % 10]
    trans = [(d, s, int(rng.integers(1, 90))) for d in dates for s in (1, 2) if rng.random() > 0.1]
    holidays = [
        (dates[100], "Holiday", "National", "E", "Navidad", False),
        (dates[200], "Event", "Local", "q", "Terremoto", False),
        (dates[300], "Holiday", "Regional", "s", "Fundacion", True),
    ]
    return {
        "train": spark.createDataFrame(train),
        "test": spark.createDataFrame(test),
        "stores": spark.createDataFrame(
            [(1, "q", "n", "A", 9), (2, "r", "s", "B", 10)],
            "store_nbr int, city string, state string, type string, cluster int",
        ),
        "oil": spark.createDataFrame(oil, "date date, dcoilwtico double"),
        "transactions": spark.createDataFrame(
            trans, "date date, store_nbr int, transactions int"
        ),
        "holidays_events": spark.createDataFrame(
            holidays,
            "date date, type string, locale string, locale_name string, description string, "
            "transferred boolean",
        ),
    }


@pytest.fixture(scope="module")
def processed(spark, tables):
    done = preprocess(tables, check=True)["train"]
    return table(spark, "test-plans", "processed", lambda: done, buckets=4, keys=["store_nbr", "family"])


@pytest.fixture(scope="module")
def state(spark, processed):
    return {
        n: table(spark, "test-plans", n, lambda d=d: d) for n, d in P.fit_state(processed).items()
    }


@pytest.fixture(scope="module")
def features(spark, processed, state):
    build = lambda: P.build_features(processed, 7, state)
    return table(spark, "test-plans", "features", build)


def test_preprocess_imputes_and_keeps_rows(tables, processed):
    assert processed.count() == tables["train"].count()
    for c in ("dcoilwtico", "transactions", "holiday_type", "transferred"):
        assert processed.where(F.col(c).isNull()).isEmpty()
    assert processed.where("abs(sales - ln(1 + sales_raw)) > 1e-9").isEmpty()
    assert processed.where("holiday_type = 'No_Holiday' and holiday_locale is not null").isEmpty()


def test_predict_mode_processes_test_alone(tables):
    done = preprocess(tables, predict=True)
    assert list(done) == ["test"] and "sales_raw" not in done["test"].columns
    assert done["test"].count() == tables["test"].count()


def test_row_grain_prices_differ_inside_a_day(tables):
    by_row = preprocess(tables, oil_grain="row")["train"]
    per_day = by_row.groupBy("store_nbr", "date").agg(F.count_distinct("dcoilwtico").alias("n"))
    assert not per_day.where("n > 1").isEmpty()


def test_bucketed_panel_feeds_windows_without_a_shuffle(processed, state):
    from shelfcast.operators.features import rolling_features

    plan = rolling_features(processed, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan


def test_features_are_complete_and_lags_known(features, processed):
    assert features.groupBy("store_nbr", "family").count().where("count <> 420 - 364").isEmpty()
    for c in P.feature_columns(features):
        assert features.where(F.col(c).isNull()).isEmpty(), c
    assert dict(features.dtypes)["holiday_locale"] == "int"


def test_both_grains_have_the_same_columns(processed, state, features):
    row = P.build_features(processed, 7, state, grain="row")
    assert sorted(row.columns) == sorted(features.columns)
    assert row.count() == features.count()  # lags in rows of a store reach less far back


def test_training_state_round_trip_and_forecast(spark, tables, processed, state, features):
    prepared = TR.prepare(features, SETTINGS)
    assert {r[0] for r in prepared.select("weight").distinct().collect()} == {1.0, 5.0}
    model, results, rounds = TR.train(prepared, 7, PARAMS, SETTINGS)
    assert [r["fold"] for r in results] == [1, 2] and 1 <= rounds <= PARAMS.rounds
    folder = run_folder(spark, "test-state")
    files.save_state(folder, 7, state, model)
    loaded, read = files.load_state(spark, folder, 7, list(state))
    forecast = FC.forecast(processed, tables, 7, read, TR.predictor(loaded), settings=SETTINGS)
    path = files.save_forecast(forecast, 7, folder, dt.date(2021, 3, 1))
    assert path.endswith("predictions_daily_20210301.parquet")
    got = files.scan_parquet(spark, path).toPandas()
    assert len(got) == 7 * 4
    assert got["date"].min() == START + dt.timedelta(420)
    assert (got["lower_bound"] <= got["predicted_sales"]).all()
    assert (got["predicted_sales"] <= got["upper_bound"]).all()
    shares = TR.importance(loaded, spark)
    assert abs(shares.agg(F.sum("importance")).first()[0] - 1) < 1e-6
    reports = TR.evaluate_all(prepared, loaded, SETTINGS)
    n = holdout_split(prepared, SETTINGS)[1].count()
    assert reports["family"].agg(F.sum("n_rows")).first()[0] == n
    assert reports["date"].count() == 7


@pytest.mark.parametrize(
    ("losses", "patience", "kept"),
    [
        ([5.0, 3.0, 4.0, 4.5, 2.0, 6.0], 3, 5),  # dips, rises, dips lower
        ([5.0, 3.0, 4.0, 4.5, 2.0, 6.0], 2, 2),
        ([5.0, 3.0, 3.0, 3.0], 150, 2),
        ([4.0, 3.0, 2.0], 1, 3),
        ([1.0], 150, 1),
        ([], 150, 0),
    ],
)
def test_best_round_waits(losses, patience, kept):
    assert TR.best_round(losses, patience) == kept


def test_shorter_fit_has_the_first_trees_of_the_longer(spark):
    rows = spark.range(300).selectExpr("id % 17 + 0.5 * (id % 5) as sales", "cast(id % 17 as double) a", "cast(id % 5 as double) b", "1.0d as weight")
    rows = TR.assembler(["a", "b"]).transform(rows).coalesce(1)
    long, short = TR.estimator(PARAMS).fit(rows), TR.estimator(PARAMS, 2).fit(rows)
    losses = long.evaluateEachIteration(rows, PARAMS.loss)
    assert short.evaluateEachIteration(rows, PARAMS.loss) == pytest.approx(losses[:2])


def test_truncated_model_equals_a_shorter_fit(spark):
    rows = spark.range(400).selectExpr("id % 17 + 0.5 * (id % 5) as sales", "cast(id % 17 as double) a", "cast(id % 5 as double) b", "1.0d + id % 2 as weight")
    rows = TR.assembler(["a", "b"]).transform(rows).coalesce(1)
    long = TR.estimator(PARAMS).fit(rows)
    for kept in (1, 2, 3):
        cut, short = TR.truncated(long, kept), TR.estimator(PARAMS, kept).fit(rows)
        assert cut.getNumTrees == kept and cut.treeWeights == short.treeWeights
        both = [[r.y_pred for r in m.transform(rows).select("y_pred").collect()] for m in (cut, short)]
        assert both[0] == both[1]
    folder = run_folder(spark, "test-truncated")
    cut.write().overwrite().save(folder)
    assert type(cut).load(folder).getNumTrees == 3


def test_fold_is_fitted_once(spark, features, monkeypatch):
    prepared = TR.prepare(features, SETTINGS)
    rows = table(spark, "test-plans", "vectors", lambda: TR.vectors(prepared, TR.model_columns(prepared)))
    fits = []
    estimator = TR.estimator
    monkeypatch.setattr(TR, "estimator", lambda *a: fits.append(a) or estimator(*a))
    monkeypatch.setattr(TR, "best_round", lambda losses, patience: 2)
    results, rounds = TR.train_cv(rows, PARAMS, SETTINGS)
    assert len(fits) == len(results) == 2 and rounds == 2 and {r["rounds"] for r in results} == {2}
    path = files.save_cv(TR.cv_table(spark, results), 7, run_folder(spark, "test-cv"))
    assert spark.read.parquet(path).count() == 2


def test_all_reports_come_from_one_table(spark, features):
    prepared = TR.prepare(features, SETTINGS)
    model = TR.fit_final(prepared, TR.model_columns(prepared), PARAMS, 2, SETTINGS)
    reports = TR.evaluate_all(prepared, model, SETTINGS)
    scored = model.transform(holdout_split(prepared, SETTINGS)[1])
    alone = {
        "global": E.evaluate(scored, []), "family": E.evaluate(scored, ["family"]),
        "family_log_wape": E.log_wape(scored, ["family"]), "store": E.evaluate_by_store(scored), "date": E.error_by_date(scored),
    }
    for name, df in alone.items():
        got, want = reports[name].select(*df.columns).toPandas(), df.toPandas()
        order = list(df.columns[:1])
        pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True))
    table_ = TR.all_reports(reports)
    counts = dict(table_.groupBy("report").count().collect())
    assert counts == {"global": 1, "family": 2, "family_log_wape": 2, "store": 2, "date": 7, "importance": len(TR.model_columns(prepared))}
    plan = E.report_table(scored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" in plan


def test_dynamic_overwrite_leaves_other_days(spark):
    folder = run_folder(spark, "test-partitions")
    day = lambda n: spark.createDataFrame([(n, 1.5)], "store_nbr int, predicted_sales double")
    for h, d, n in ((7, 1, 1), (7, 2, 2), (30, 1, 3), (7, 2, 4)):
        path = files.save_partition(day(n), folder, "predictions", h, dt.date(2021, 3, d))
    rows = spark.read.parquet(path)
    assert sorted(r.store_nbr for r in rows.collect()) == [1, 3, 4]
    one = rows.where("horizon = 7 and run_date = date'2021-03-02'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert [r.store_nbr for r in one.collect()] == [4] and "PartitionFilters: [isnotnull(horizon" in plan


def test_forecast_of_one_store_keeps_the_codes_of_training(spark, tables, processed, state):
    whole = FC.forecast(processed, tables, 7, state, FC.naive(7), settings=SETTINGS)
    one = FC.forecast(
        processed.where("store_nbr = 2"), tables, 7, state, FC.naive(7), settings=SETTINGS
    )
    keys = ["date", "store_nbr", "family"]
    a = FC.forecast_of_store(whole, 2).toPandas().sort_values(keys, ignore_index=True)
    b = one.toPandas().sort_values(keys, ignore_index=True)
    pd.testing.assert_frame_equal(a, b)
    assert FC.forecast_of_store(whole, 2, 1).count() == 7
    with pytest.raises(ValueError):
        FC.forecast_of_store(whole, 99)
    with pytest.raises(LookupError):
        FC.forecast_of_store(whole, 2, 99)


def test_forecast_beyond_the_horizon_is_refused(tables, processed, state):
    with pytest.raises(ValueError):
        FC.prediction_input(processed, tables, 7, state, periods=8)


def test_missing_feature_is_refused(features, state):
    prepared = TR.prepare(features, SETTINGS)
    model = TR.fit_final(prepared, TR.model_columns(prepared), PARAMS, 1, SETTINGS)
    with pytest.raises(ValueError):
        TR.predictor(model)(features.drop("lag_7"))


def test_csv_bundle_round_trip(spark, tables):
    folder = run_folder(spark, "test-csv")
    for name, df in tables.items():
        if name in ("train", "test"):
            df = df.withColumn("id", F.xxhash64("date", "store_nbr", "family"))
        # Another column order than declared: columns go by name.
        files.write_csv(df.select(*reversed(df.columns)), name, folder)
    read = files.load_bundle(spark, folder)
    assert set(read) == set(tables)
    assert dict(read["train"].dtypes)["date"] == "date"
    want = tables["train"].agg(F.round(F.sum("sales"), 2), F.count("*")).first()
    assert read["train"].agg(F.round(F.sum("sales"), 2), F.count("*")).first() == want
    assert spark.table("oil").count() == tables["oil"].count()
    assert set(files.load_bundle(spark, folder, predict=True)) == set(tables) - {"train", "test"}


def test_csv_problems_raise(spark, tables):
    folder = run_folder(spark, "test-csv-bad")
    with pytest.raises(FileNotFoundError):
        files.scan_csv(spark, "oil", folder)
    files.write_csv(tables["oil"].drop("dcoilwtico"), "oil", folder)
    with pytest.raises(ValueError):
        files.scan_csv(spark, "oil", folder)


def test_narrow_types(processed):
    kinds = dict(narrow_types(processed).dtypes)
    assert kinds["sales"] == "float" and kinds["family"] == "string" and kinds["date"] == "date"


def test_only_counted_tables_are_broadcast(spark):
    assert is_small(spark.range(10), 10) and not is_small(spark.range(11), 10)
    big = sized(spark.range(BROADCAST_ROWS + 1))
    assert "BroadcastHint" not in big._jdf.queryExecution().logical().toString()
    assert "broadcast" in by_day(spark.range(1))._jdf.queryExecution().logical().toString()


def test_model_queries_boost_the_full_rounds(spark, small, monkeypatch):
    from shelfcast import catalog

    class Asked(Exception):
        pass

    def asked(params, rounds=None):
        raise Asked(params, rounds or params.rounds)

    monkeypatch.setattr(TR, "estimator", asked)
    for name, horizon in (("fit_fold", 7), ("train_cv", 7), ("fit_final", 7), ("training_run", 30), ("forecast_h30", 30)):
        for rounds in (None, 2):
            v = catalog.views(spark, small, rounds=rounds)
            with pytest.raises(Asked) as e:
                catalog.QUERIES[name](v)
            want = TR.PARAMS[horizon]
            assert e.value.args[1] == (rounds or want.rounds) and e.value.args[0].bins == want.bins == 255
            assert (e.value.args[0].step, e.value.args[0].depth) == (want.step, want.depth)
