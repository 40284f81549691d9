"""Operators on small frames, against values worked out by hand or with pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.config import LAGS, Settings
from shelfcast.functions.calendar import calendar_columns, impact_type
from shelfcast.functions.metrics import metric_columns
from shelfcast.operators import explore as X
from shelfcast.operators import features as G
from shelfcast.operators import folds as V
from shelfcast.operators import quality as Q
from shelfcast.operators.decompose import seasonal_decompose
from shelfcast.operators.encode import apply_codes, decode, fit_codes
from shelfcast.operators.enrich import enrich_panel, split_holidays
from shelfcast.operators.evaluate import champion_challenger, evaluate
from shelfcast.operators.impute import fill_edges, interpolate, oil_by_row
from shelfcast.operators.positions import over_rows, with_positions
from shelfcast.operators.quantiles import exact_quantiles

DAY = dt.date(2020, 1, 1)


def days(n: int) -> list[dt.date]:
    return [DAY + dt.timedelta(i) for i in range(n)]


def panel(n_days=60, stores=(1, 2), families=("a", "b", "c"), seed=0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = pd.MultiIndex.from_product([days(n_days), stores, families]).to_frame(index=False)
    rows.columns = ["date", "store_nbr", "family"]
    rows["sales"] = np.round(rng.gamma(1, 3, len(rows)) * (rng.random(len(rows)) > 0.3), 3)
    rows["onpromotion"] = rng.integers(0, 4, len(rows))
    return rows


def sorted_pandas(df, keys=("store_nbr", "family", "date")):
    return df.toPandas().sort_values(list(keys), ignore_index=True)


# --- metrics, ranks, codes ---------------------------------------------------------


def test_metric_vector(spark):
    df = spark.createDataFrame(
        [(10.0, 12.0), (20.0, 18.0), (30.0, 33.0), (40.0, 38.0), (50.0, 52.0)], "y double, p double"
    )
    row = df.agg(*metric_columns("y", "p", in_log_scale=False)).first()
    assert tuple(row) == (2.2361, 2.2, 9.8, 0.1004, 7.3333)


def test_metrics_without_positive_actuals_are_null_where_relative(spark):
    df = spark.createDataFrame([(0.0, -1.0), (0.0, 1.0)], "y double, p double")
    row = df.agg(*metric_columns("y", "p", in_log_scale=False)).first()
    assert row["mape"] is None and row["wape"] is None
    assert row["mae"] == 0.5  # negative predictions count as zero


def test_store_rank_averages_ties_and_truncates(spark):
    df = spark.createDataFrame(
        list(enumerate([5.0, 5.0, 3.0, 9.0, 3.0, 3.0])), "store_nbr int, sales double"
    )
    ranks = {r["store_nbr"]: r["ranking_tienda"] for r in G.store_ranking(df).collect()}
    assert [ranks[i] for i in range(6)] == [2, 2, 5, 1, 5, 5]


def test_codes_sort_by_bytes_and_numbers_by_value(spark):
    rows = list(zip(["b", "a", None, "á", "Z", "b"], [10, 9, 100, None, 9, 10], range(6)))
    df = spark.createDataFrame(rows, "t string, n int, i int")
    codes = fit_codes(df, ["t", "n"])
    coded = apply_codes(df, codes, ["t", "n"]).orderBy("i").collect()
    assert [r["t"] for r in coded] == [2, 1, -1, 3, 0, 2]
    assert [r["n"] for r in coded] == [1, 0, 2, -1, 0, 1]
    back = decode(apply_codes(df, codes, ["t"]), codes, "t").orderBy("i").collect()
    assert [r["t"] for r in back] == [r[0] for r in rows]


def test_unknown_value_gets_minus_one(spark):
    known = spark.createDataFrame([("a",)], "t string")
    new = spark.createDataFrame([("zz",)], "t string")
    assert apply_codes(new, fit_codes(known, ["t"]), ["t"]).first()["t"] == -1


# --- calendar and holidays --------------------------------------------------------


def test_calendar_against_pandas(spark):
    dates = pd.date_range("2015-12-25", "2017-03-05", freq="D")
    df = spark.createDataFrame([(d.date(),) for d in dates], "date date")
    got = df.select("date", *[c.alias(n) for n, c in calendar_columns().items()])
    got = got.toPandas().sort_values("date", ignore_index=True)
    s = pd.Series(dates)
    expected = {
        "dia_semana": s.dt.dayofweek,
        "semana_del_año": s.dt.isocalendar().week,
        "semana_del_mes": (s.dt.day - 1) // 7 + 1,
        "trimestre": s.dt.quarter,
        "dias_para_fin_de_mes": s.dt.days_in_month - s.dt.day,
        "es_quincena": s.dt.day.isin([14, 15, 28, 29, 30, 31]),
        "es_viernes": s.dt.dayofweek == 4,
    }
    for name, values in expected.items():
        assert (got[name].to_numpy() == values.astype(int).to_numpy()).all(), name
    assert np.allclose(got["day_sin"], np.sin(2 * np.pi * s.dt.dayofweek / 7))


@pytest.mark.parametrize(
    ("text", "group"),
    [
        ("No_Holiday", "none"),
        ("TERREMOTO y Navidad", "atypical"),
        ("Puente Navidad", "positive"),
        ("puente del viernes", "negative"),
        ("Fundacion de Loja", "neutral"),
    ],
)
def test_impact_groups(spark, text, group):
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(impact_type("d")).first()[0] == group


def test_holiday_distance_against_brute_force(spark):
    rng = np.random.default_rng(5)
    flags = (rng.random(80) < 0.06).astype(int)
    df = spark.createDataFrame(list(zip(days(80), flags.tolist())), "date date, es_festivo int")
    got = G.holiday_distance(df).toPandas().sort_values("date", ignore_index=True)
    at = np.flatnonzero(flags)
    for i in range(80):
        ahead, behind = at[at >= i], at[at <= i]
        assert got.loc[i, "dias_para_siguiente_festivo"] == (ahead.min() - i if len(ahead) else 999)
        assert got.loc[i, "dias_desde_ultimo_festivo"] == (i - behind.max() if len(behind) else 999)


HOLIDAYS = "date date, type string, locale string, locale_name string, description string, transferred boolean"


def _tables(spark, p):
    stores = spark.createDataFrame(
        [(1, "q", "north", "A", 3), (2, "r", "south", "B", 4)],
        "store_nbr int, city string, state string, type string, cluster int",
    )
    oil = spark.createDataFrame([(d, 10.0 + i) for i, d in enumerate(days(60)) if i % 7 < 5], "date date, dcoilwtico double")
    trans = spark.createDataFrame([(d, 1, i) for i, d in enumerate(days(60))], "date date, store_nbr int, transactions int")
    holidays = spark.createDataFrame(
        [
            (DAY, "Holiday", "National", "E", "nat moved", True),
            (DAY, "Event", "National", "E", "nat", False),
            (DAY, "Holiday", "Regional", "north", "reg", False),
            (DAY, "Holiday", "Local", "q", "loc", False),
            (days(2)[1], "Holiday", "Regional", "south", "reg2", False),
            (days(3)[2], "Holiday", "Local", None, "nowhere", False),
        ],
        HOLIDAYS,
    )
    return stores, oil, trans, holidays


def test_enrichment_keeps_rows_and_prefers_local_over_regional_over_national(spark):
    p = panel()
    merged = enrich_panel(spark.createDataFrame(p), *_tables(spark, p))
    assert merged.count() == len(p)
    assert Q.duplicate_keys(merged).first()[0] == 0
    found = {
        (r["date"], r["store_nbr"]): r["holiday_description"]
        for r in merged.where("holiday_description is not null").collect()
    }
    assert found == {(DAY, 1): "loc", (DAY, 2): "nat", (days(2)[1], 2): "reg2"}


def test_dedup_prefers_rows_not_transferred(spark):
    national = split_holidays(_tables(spark, None)[3])["National"].collect()
    assert [(r["holiday_description"], r["transferred"]) for r in national] == [("nat", False)]


# --- windows against pandas --------------------------------------------------------


@pytest.mark.parametrize("horizon", [7, 30])
def test_lags_and_rolling_against_pandas(spark, horizon):
    p = panel(n_days=420, stores=(1,), families=("a", "b")).rename(columns={})
    got = sorted_pandas(
        G.promo_features(
            G.rolling_features(G.target_lags(spark.createDataFrame(p), horizon), horizon), horizon
        )
    )
    p = p.sort_values(["store_nbr", "family", "date"], ignore_index=True)
    group = p.groupby(["store_nbr", "family"])
    for k in LAGS[horizon]:
        assert np.allclose(got[f"lag_{k}"], group["sales"].shift(k), equal_nan=True)
    for w in G.ROLLING_WINDOWS[horizon]:
        for name in ("mean", "std", "max"):
            want = group["sales"].transform(
                lambda x, w=w, name=name: getattr(x.shift(horizon).rolling(w, min_periods=1), name)()
            )
            assert np.allclose(got[f"rolling_{name}_{w}d"], want, equal_nan=True, atol=1e-9)
    want = group["onpromotion"].transform(
        lambda x: x.shift(horizon).rolling(2 * horizon, min_periods=1).mean()
    )
    assert np.allclose(got[f"rolling_promo_mean_{2 * horizon}"], want, equal_nan=True)


def test_future_values_do_not_reach_back(spark):
    p = panel(n_days=90)
    changed = p.copy()
    cut = days(90)[60]
    changed.loc[changed["date"] > cut, "sales"] += 100
    frames = []
    for data in (p, changed):
        df = G.rolling_features(G.target_lags(spark.createDataFrame(data), 7), 7)
        early = df.where(F.col("date") <= cut + dt.timedelta(7))
        frames.append(sorted_pandas(early.drop("sales")))
    pd.testing.assert_frame_equal(*frames)


def test_row_grain_moves_rows_not_days(spark):
    p = panel(n_days=100, stores=(1, 2))
    p["dcoilwtico"] = p["date"].map({d: float(i) for i, d in enumerate(days(100))})
    p["transactions"] = p["store_nbr"] * 1000 + p["date"].map({d: i for i, d in enumerate(days(100))})
    df = spark.createDataFrame(p)
    got = sorted_pandas(G.trans_row_features(G.oil_row_features(df, 7), 7), ("store_nbr", "date", "family"))
    p = p.sort_values(["store_nbr", "date", "family"], ignore_index=True)
    group = p.groupby("store_nbr")
    assert np.allclose(got["oil_lag_7"], group["dcoilwtico"].shift(7), equal_nan=True)
    assert np.allclose(got["trans_lag_7"], group["transactions"].shift(7), equal_nan=True)
    for name, value, w in (("oil_rolling_mean_28", "dcoilwtico", 28), ("trans_rolling_mean_7", "transactions", 7)):
        want = group[value].transform(lambda x, w=w: x.shift(7).rolling(w, min_periods=1).mean())
        assert np.allclose(got[name], want, equal_nan=True)


def test_short_blocks_give_the_same_as_one_window(spark):
    df = with_positions(spark.createDataFrame(panel(n_days=80)))
    columns = {"m": (F.avg("sales"), -20, -3), "x": (F.max("sales"), -20, 0)}
    keys = ("store_nbr", "row")
    whole = sorted_pandas(over_rows(df, columns, 20), keys)
    short = sorted_pandas(over_rows(df, columns, 20, block=25), keys)
    assert len(short) == df.count()
    pd.testing.assert_frame_equal(whole, short)
    with pytest.raises(ValueError):
        over_rows(df, columns, 20, block=10)


def test_statistics_window_equals_grouping_and_as_of_leaves_later_rows_out(spark):
    p = panel()
    df = spark.createDataFrame(p)
    cut = days(60)[30]
    whole = df.withColumns(G.stats_columns()).select(*G.SERIES, "venta_media_historica").distinct()
    part = df.withColumns(G.stats_columns(F.lit(cut))).select(*G.SERIES, "venta_media_historica").distinct()
    for table, rows in ((whole, p), (part, p[p["date"] <= cut])):
        want = rows.groupby(["store_nbr", "family"])["sales"].mean()
        got = table.toPandas().set_index(["store_nbr", "family"])["venta_media_historica"]
        assert np.allclose(got.sort_index(), want.sort_index())


def test_single_value_has_no_deviation(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "store_nbr int, family string, sales double")
    assert G.series_stats(df).first()["venta_std_historica"] is None


# --- interpolation -----------------------------------------------------------------


def _gaps(n, seed):
    rng = np.random.default_rng(seed)
    return [None if x < 0.5 else round(float(x) * 10, 2) for x in rng.random(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_interpolation_against_pandas(spark, seed):
    values = _gaps(40, seed)
    df = spark.createDataFrame(list(zip(days(40), values)), "date date, v double")
    got = interpolate(df, "v", [], ["date"]).toPandas().sort_values("date")["v"]
    series = pd.Series(values, dtype=float)
    assert np.allclose(got, series.interpolate().ffill().bfill())
    open_start = interpolate(df, "v", [], ["date"], edges=False).toPandas().sort_values("date")["v"]
    assert np.allclose(open_start, series.interpolate(), equal_nan=True)
    filled = fill_edges(df, "v", [], ["date"]).toPandas().sort_values("date")["v"]
    assert np.allclose(filled, series.ffill().bfill())


def test_row_interpolation_against_pandas(spark):
    p = panel(n_days=40)
    prices = dict(zip(days(40), _gaps(40, 4)))
    oil = spark.createDataFrame([(d, v) for d, v in prices.items()], "date date, dcoilwtico double")
    got = sorted_pandas(oil_by_row(spark.createDataFrame(p), oil), ("store_nbr", "date", "family"))
    p = p.sort_values(["store_nbr", "date", "family"], ignore_index=True)
    p["v"] = p["date"].map(prices).astype(float)
    want = p.groupby("store_nbr")["v"].transform(lambda x: x.interpolate().ffill().bfill())
    assert np.allclose(got["dcoilwtico"], want)


# --- folds -------------------------------------------------------------------------


def test_folds_are_ordered_disjoint_and_counted(spark):
    settings = Settings(n_folds=3, val_weeks=1, test_weeks=2)
    df = spark.createDataFrame(panel(n_days=60))
    folds = V.walk_forward_folds(df, settings).toPandas().sort_values("fold", ignore_index=True)
    assert folds["fold"].tolist() == [1, 2, 3]
    assert folds["val_start"].tolist() == [days(60)[i] for i in (25, 32, 39)]
    assert folds["val_end"].tolist() == [days(60)[i] for i in (31, 38, 45)]
    assert folds["n_train"].tolist() == [25 * 6, 32 * 6, 39 * 6]
    assert (folds["train_end"] < folds["val_start"]).all()
    rows = V.validation_rows(df, settings)
    assert rows.count() == rows.select("date", "store_nbr", "family").distinct().count() == 21 * 6


def test_fold_without_training_days_is_left_out_and_keeps_its_number(spark):
    settings = Settings(n_folds=5, val_weeks=1, test_weeks=1)
    folds = V.walk_forward_folds(spark.createDataFrame(panel(n_days=29)), settings)
    assert sorted(r["fold"] for r in folds.collect()) == [3, 4, 5]


def test_holdout_is_whole_weeks_by_the_calendar(spark):
    train, test = V.holdout_split(spark.createDataFrame(panel(n_days=60)), Settings(test_weeks=1))
    assert train.agg(F.max("date")).first()[0] == days(60)[52]
    assert test.select("date").distinct().count() == 7


# --- quantiles and profiles ---------------------------------------------------------


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_quantiles_are_exact_for_ties_negatives_and_one_hot_group(spark, seed):
    rng = np.random.default_rng(seed)
    value = np.where(rng.random(3000) < 0.4, 0.0, np.round(rng.normal(0, 50, 3000), 2))
    group = np.where(rng.random(3000) < 0.7, "hot", rng.choice(["a", "b"], 3000))
    df = spark.createDataFrame(pd.DataFrame({"g": group, "v": value}))
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.931, "e": 1.0}
    got = exact_quantiles(df, "v", probs, ["g"]).toPandas().set_index("g")
    for g, part in pd.Series(value).groupby(group):
        assert np.allclose(got.loc[g, list(probs)].astype(float), part.quantile(list(probs.values())))
    whole = exact_quantiles(df, "v", probs).first()
    assert np.allclose(list(whole), np.quantile(value, list(probs.values())))


def test_null_report_lists_only_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "a int, b string")
    assert [tuple(r) for r in Q.null_report(df).collect()] == [("b", 2, 66.67)]


def test_missing_columns_raise_and_extra_are_returned(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert Q.check_columns(df, "t", ["a"]) == ["b"]
    with pytest.raises(ValueError):
        Q.check_columns(df, "t", ["a", "c"])
    with pytest.raises(ValueError):
        Q.check_features(df, ["z"])


def test_duplicates_raise(spark):
    df = spark.createDataFrame(pd.concat([panel(3), panel(3).head(2)]))
    assert Q.duplicate_keys(df).first()[0] == 2
    with pytest.raises(ValueError):
        Q.require_unique(df)


def test_requests(spark):
    rows = [(1, 7, None), (0, 7, 1), (3, 8, 1), (3, 30, 33), (54, 30, 32), (None, 7, 1)]
    df = spark.createDataFrame(rows, "store_nbr int, horizon int, family int")
    got = Q.validate_requests(df, 54, 33).collect()
    assert [r["reason"] for r in got] == [None, "store_nbr", "horizon", "family", None, "store_nbr"]


def test_promo_lift_of_a_family_without_promotion_is_null(spark):
    df = spark.createDataFrame(
        [("a", 4.0, 1), ("a", 2.0, 0), ("b", 1.0, 0)], "family string, sales double, onpromotion int"
    )
    got = {r["family"]: r["lift_promo"] for r in X.promo_lift(df).collect()}
    assert got == {"a": 2.0, "b": None}


def test_champion_keeps_its_place_without_enough_gain(spark):
    def one(x):
        return spark.createDataFrame([(x,)], "rmse double")

    assert not champion_challenger(one(100.0), one(99.5)).first()["accepted"]
    assert champion_challenger(one(100.0), one(99.0)).first()["accepted"]
    assert champion_challenger(one(100.0), one(120.0), force=True).first()["accepted"]


def test_evaluate_without_groups_counts_all_rows(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "sales double, y_pred double")
    assert evaluate(df, []).first()["n_rows"] == 2


# --- decomposition -------------------------------------------------------------------


@pytest.mark.parametrize("period", [7, 12])
def test_decomposition_against_numpy(spark, period):
    n = 100
    rng = np.random.default_rng(period)
    y = np.arange(n) * 0.3 + 5 * np.sin(2 * np.pi * np.arange(n) / period) + rng.normal(0, 1, n)
    df = spark.createDataFrame(list(zip(days(n), y.tolist())), "date date, y double")
    got = seasonal_decompose(df, "y", period).toPandas().sort_values("date", ignore_index=True)
    if period % 2:
        weights = np.ones(period) / period
    else:
        weights = np.r_[0.5, np.ones(period - 1), 0.5] / period
    half = len(weights) // 2
    trend = np.full(n, np.nan)
    trend[half : n - half] = np.convolve(y, weights, "valid")
    t = np.arange(n)
    k, c = np.polyfit(t[half : half + period], trend[half : half + period], 1)
    trend[:half] = k * t[:half] + c
    end = n - half - 1
    k, c = np.polyfit(t[end - period : end], trend[end - period : end], 1)
    trend[end + 1 :] = k * t[end + 1 :] + c
    phases = np.array([(y - trend)[i::period].mean() for i in range(period)])
    season = np.tile(phases - phases.mean(), n // period + 1)[:n]
    assert np.allclose(got["trend"], trend)
    assert np.allclose(got["seasonal"], season)
    assert np.allclose(got["resid"], y - trend - season)


def test_rolling_statistics_equal_pandas_on_gaps_and_constants(spark):
    rng = np.random.default_rng(5)
    rows = []
    for series, n in (("A", 130), ("B", 40), ("C", 5), ("D", 100)):
        for i in range(n):
            value = 3.25 if series == "D" else float(rng.gamma(2, 3) * 1e6 * (i % 11 > 3))
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(i), 1, series, None if series == "A" and i % 13 == 0 else value))
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double")
    for horizon, widths in ((7, [7, 14, 28]), (30, [30, 60, 90])):
        got = G.rolling_features(df, horizon).toPandas().sort_values(["family", "date"], ignore_index=True)
        assert not [c for c in got.columns if c.startswith("_")]
        base = got.groupby("family")["sales"].shift(horizon)
        for w in widths:
            rolled = base.groupby(got["family"]).rolling(w, min_periods=1)
            for name, want in (("mean", rolled.mean()), ("std", rolled.std()), ("max", rolled.max())):
                want = want.reset_index(drop=True)
                have = got[f"rolling_{name}_{w}d"]
                assert (have.isna() == want.isna()).all(), (name, w)
                np.testing.assert_allclose(have.dropna(), want.dropna(), rtol=1e-9, atol=1e-6)
        flat = got[got["family"] == "D"][f"rolling_std_{widths[0]}d"].dropna()
        assert (flat == 0).all()


def test_holdout_and_folds_are_cut_below_the_window(spark, small):
    from shelfcast import catalog

    v = catalog.views(spark, small)
    plan = v.holdout()._jdf.queryExecution().optimizedPlan().toString()
    assert ">= scalar-subquery" in plan[plan.index("Window [") :]
    folds = catalog.QUERIES["walk_forward_folds"](v)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in folds and "row_number" in folds


def test_quantiles_of_a_narrow_range_are_split_until_a_task_can_order_them(spark):
    from shelfcast.operators import quantiles as Q

    rng = np.random.default_rng(2)
    values = np.round(rng.random(30_000) * 0.01, 9)
    rows = [(None if i % 3 == 0 else "a", float(v)) for i, v in enumerate(values)] + [("b", 7.0)] * 5 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    probs = {"q1": 0.25, "median": 0.5, "p99": 0.99}
    got = {r.g: r for r in exact_quantiles(df, "x", probs, ["g"], ordered=500).collect()}
    assert set(got) == {None, "a", "b"}
    for g, part in ((None, values[::3]), ("a", np.delete(values, np.s_[::3])), ("b", np.full(5, 7.0))):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part, p), rel=1e-12)
    one = exact_quantiles(df, "x", probs, ordered=500).first()
    flat = np.append(values, np.full(5, 7.0))
    assert [one[n] for n in probs] == pytest.approx([np.quantile(flat, p) for p in probs.values()], rel=1e-12)
    freq = df.where("x is not null").groupBy(F.col("x").alias("_v")).agg(F.count("*").alias("_n"))
    ranks, areas = Q._areas(freq, [], probs, 500)
    assert ranks.agg(F.max("_m")).first()[0] <= 500
    assert Q._within(freq, areas, []).groupBy("_before").count().agg(F.max("count")).first()[0] <= 500


def test_positions_come_from_ranges(spark):
    from shelfcast.operators.ranges import range_positions

    df = spark.range(5000).selectExpr("cast(id % 7 as string) g", "cast(hash(id) as double) v", "id")
    rows = range_positions(df, [F.col("v").desc(), F.col("id").asc()], by="g").toPandas()
    for _, part in rows.groupby("g"):
        assert part.sort_values(["v", "id"], ascending=[False, True])["position"].tolist() == list(range(len(part)))
    plan = fit_codes(df.select("g", "v"), ["g", "v"])._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
    assert range_positions(df.limit(0), [F.col("v").asc()]).count() == 0


def test_changed_files_give_new_answers(spark, small):
    import shutil

    import pyarrow.parquet as pq

    from shelfcast import catalog, session

    folder = session.run_folder(spark, "test-listing")
    shutil.copytree(small, folder, copy_function=shutil.copyfile)
    old = catalog.views(spark, folder)
    before = old.oil.count()
    assert catalog.views(spark, folder) is old
    pq.write_table(pq.read_table(f"{small}/orders.parquet").slice(0, 10), f"{folder}/orders.parquet")
    new = catalog.views(spark, folder)
    assert new is not old and new.retail.source != old.retail.source
    assert new.oil.count() < before == old.oil.count()


def test_large_dimensions_meet_the_panel_in_its_buckets(spark, small, monkeypatch):
    from shelfcast import catalog
    from shelfcast.operators import enrich

    v = catalog.views(spark, small)
    want = v.merged()
    monkeypatch.setattr(enrich, "is_small", lambda df, *a: "locale" in df.columns)  # holidays alone are broadcast
    monkeypatch.setattr(v, "written", lambda name, build, keys=None, buckets=None: session_table(spark, name, build, keys, buckets))
    v.train, v.stores, v.oil, v.transactions, v.holidays  # noqa: B018  written before broadcasts end
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = v.merged()
        plan = got._jdf.queryExecution().executedPlan().toString()
        panel = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
        # whatever is shuffled (dates of holidays, prices) is not the panel: its joins are merges of buckets
        assert plan.count("SortMergeJoin [store_nbr") == 2
        assert not [line for line in panel if "family" in line or "hashpartitioning(store_nbr" in line or "hashpartitioning(date" in line and "store_nbr" in line]
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def session_table(spark, name, build, keys, buckets):
    from shelfcast.session import table

    return table(spark, "test-alike", name, build, keys=keys, buckets=buckets)
