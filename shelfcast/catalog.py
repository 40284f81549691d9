"""Every query by name: the Spark side and the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast import oracle as O
from shelfcast.config import (
    LAGS,
    METRICS,
    PANEL_KEYS,
    ROLLING_WINDOWS,
    SERIES,
    TOP_FAMILIES_TEST_TABLES,
    Settings,
)
from shelfcast.operators import evaluate as E
from shelfcast.operators import explore as X
from shelfcast.operators import features as G
from shelfcast.operators import folds as V
from shelfcast.operators import quality as Q
from shelfcast.operators.decompose import seasonal_decompose
from shelfcast.operators.encode import apply_codes
from shelfcast.operators.enrich import enrich_panel, join_holidays, split_holidays
from shelfcast.operators.impute import fill_edges, impute_nulls, oil_by_day, oil_by_row
from shelfcast.plans import features as P
from shelfcast.plans import forecast as FC
from shelfcast.plans import preprocess as PP
from shelfcast.plans import training as TR
from shelfcast.session import by_day, file_listing, run_folder, sized, table
from shelfcast.sources import files
from shelfcast.sources.retail import Retail

SETTINGS = Settings(top_families=TOP_FAMILIES_TEST_TABLES)

_models: set[str] = set()


class Views:
    """The derived tables queries start from, over one folder of warehouse tables.

    rounds: boosting rounds of the model queries; all of ``TR.PARAMS`` by default.
    """

    def __init__(self, spark: SparkSession, folder: str, store: str = "nation", rounds: int | None = None):
        self.spark, self.retail, self.rounds = spark, Retail(spark, folder, store), rounds

    @cached_property
    def train(self) -> DataFrame:
        return self.retail.train()

    @cached_property
    def test(self) -> DataFrame:
        return self.retail.test()

    @cached_property
    def stores(self) -> DataFrame:
        return self.retail.stores()

    @cached_property
    def small_stores(self) -> DataFrame:
        return sized(self.stores)

    @cached_property
    def oil(self) -> DataFrame:
        return self.retail.oil()

    @cached_property
    def holidays(self) -> DataFrame:
        return self.retail.holidays()

    @cached_property
    def transactions(self) -> DataFrame:
        return self.retail.transactions()

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return {
            "train": self.train,
            "test": self.test,
            "stores": self.stores,
            "oil": self.oil,
            "holidays_events": self.holidays,
            "transactions": self.transactions,
        }

    def written(self, name: str, build: Callable[[], DataFrame], **kw) -> DataFrame:
        return table(self.spark, self.retail.source, name, build, **kw)

    def merged(self) -> DataFrame:
        """Panel with all dimensions, nothing imputed."""
        return enrich_panel(self.train, self.stores, self.oil, self.transactions, self.holidays, self.alike)

    def alike(self, name: str, df: DataFrame) -> DataFrame:
        """A table in the buckets of the panel, written once."""
        return self.written(name, lambda: df, keys=SERIES, buckets=self.retail.buckets())

    def with_holidays(self) -> DataFrame:
        """Panel with stores and holidays only, for queries that read no more."""
        return join_holidays(
            self.train.join(self.small_stores, "store_nbr", "left"), self.holidays
        )

    def with_locale(self) -> DataFrame:
        national = split_holidays(self.holidays)["National"]
        return self.with_holidays().join(
            by_day(national.select("date", F.col("holiday_locale").alias("locale"))), "date", "left"
        )

    def processed(self) -> DataFrame:
        """Processed panel, written once and bucketed by series."""
        return self.written(
            "processed",
            lambda: G.log_target(PP.process(self.train, self.tables, alike=self.alike)),
            keys=SERIES,
            buckets=self.retail.buckets(),
        )

    def state(self, stats: bool = True) -> dict[str, DataFrame]:
        fitted = P.fit_state(self.processed())
        names = ["codes", "ranking"] + (["stats"] if stats else [])
        return {n: self.written(f"state_{n}", lambda n=n: fitted[n]) for n in names}

    def features(self, horizon: int, grain: str = "day") -> DataFrame:
        return P.build_features(self.processed(), horizon, self.state(stats=False), grain)

    def naive(self, year: bool = False, panel: DataFrame | None = None) -> DataFrame:
        """Panel with the value of a week ago as the prediction, and that of a year ago."""
        lags = {"y_pred": F.lag("sales", 7)} | ({"y_year": F.lag("sales", 364)} if year else {})
        panel = self.processed() if panel is None else panel
        df = panel.withColumns({n: c.over(G.by_series()) for n, c in lags.items()})
        return df.dropna(subset=list(lags))

    def holdout(self, year: bool = False) -> DataFrame:
        """Rows after the cutoff with their predictions.

        The panel is dense, so the lags reach as many days as rows: only those days
        and the holdout itself go through the window.
        """
        reach = SETTINGS.test_weeks * 7 + (364 if year else 7)
        rows = self.naive(year, V.last_days(self.processed(), reach))
        return rows.where(F.col("date") > V.holdout_cutoff(self.processed()))

    def fold_metrics(self) -> DataFrame:
        return E.evaluate(V.validation_rows(self.naive()), ["fold"])

    def family_metrics(self) -> DataFrame:
        return E.evaluate(self.holdout(), ["family"])

    def saved_family_metrics(self) -> DataFrame:
        """The same as the evaluation leaves it for its readers."""
        return self.written("family_metrics", self.family_metrics)

    def daily_oil(self) -> DataFrame:
        return X.sales_vs_oil(self.train, self.oil)

    def staged(self, horizon: int) -> Callable[[DataFrame], DataFrame]:
        """Writes the history with its future rows, bucketed like the panel."""
        return lambda df: self.written(
            f"combined_{horizon}", lambda: df, keys=SERIES, buckets=self.retail.buckets()
        )

    def combined(self, horizon: int) -> DataFrame:
        """History with its future rows, as the prediction reads them."""
        history = V.lookback(self.processed())
        return self.staged(horizon)(FC.history_with_future(history, self.tables, horizon))

    def prediction_input(self, horizon: int) -> DataFrame:
        return FC.prediction_input(
            self.processed(), self.tables, horizon, self.state(), stage=self.staged(horizon)
        )

    def forecast(self, horizon: int, predict) -> DataFrame:
        return FC.forecast(
            self.processed(), self.tables, horizon, self.state(), predict,
            stage=self.staged(horizon),
        )

    def naive_forecast(self, horizon: int) -> DataFrame:
        return self.forecast(horizon, FC.naive(horizon))

    def prepared(self, horizon: int) -> DataFrame:
        """Training table, written once: every fold reads it many times."""
        written = self.written(f"features_{horizon}", lambda: self.features(horizon))
        return TR.prepare(written, SETTINGS)

    def vectors(self, horizon: int) -> DataFrame:
        """Assembled rows of the training table, written once: every fit reads them."""
        df = self.prepared(horizon)
        return self.written(f"vectors_{horizon}", lambda: TR.vectors(df, TR.model_columns(df)))

    def fold_rows(self) -> DataFrame:
        """(date) of the rows of the feature table of the daily model: those with all lags."""
        return V.rows_with_history(self.processed(), max(LAGS[7]))

    def params(self, horizon: int) -> TR.TreeParams:
        full = TR.PARAMS[horizon]
        return full if self.rounds is None else replace(full, rounds=self.rounds)

    def model(self, horizon: int):
        """Final model, fitted and saved once per application."""
        params = self.params(horizon)
        folder = self.folder(f"models-{params.rounds}")
        if f"{folder}/{horizon}" not in _models:
            df = self.prepared(horizon)
            fitted = TR.fit_final(
                df, TR.model_columns(df), params, params.rounds, SETTINGS, self.vectors(horizon)
            )
            files.save_state(folder, horizon, {}, fitted)
            _models.add(f"{folder}/{horizon}")
        return files.load_state(self.spark, folder, horizon, [])[0]

    def model_forecast(self, horizon: int) -> DataFrame:
        return self.forecast(horizon, TR.predictor(self.model(horizon)))

    def folder(self, name: str) -> str:
        tag = self.retail.source.replace("/", "_").replace("#", "_")
        return run_folder(self.spark, "out", tag, name)


_views: dict[tuple[str, str, str, int | None, str], Views] = {}


def views(spark: SparkSession, folder: str, store: str = "nation", rounds: int | None = None) -> Views:
    """One set of views per application, rounds and state of the folder's files: changed files give new answers."""
    key = (spark.sparkContext.applicationId, folder, store, rounds, file_listing(spark, folder))
    if key not in _views:
        _views[key] = Views(spark, folder, store, rounds)
    return _views[key]


Query = Callable[[Views], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None, extra: dict | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = O.with_steps(sql, extra)


def rounded(df: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    """Keys and the given columns; sums of doubles are compared to a number of digits."""
    return df.select(
        *PANEL_KEYS,
        *[
            (F.col(c) if d is None else F.round(F.col(c).cast("double"), d)).alias(c)
            for c, d in columns.items()
            if c not in PANEL_KEYS
        ],
    )


def rounded_sql(source: str, columns: dict[str, int | None]) -> str:
    keys = ", ".join(PANEL_KEYS)
    parts = [
        c if d is None else f"round(cast({c} as double), {d}) as {c}"
        for c, d in columns.items()
        if c not in PANEL_KEYS
    ]
    return f"select {keys}, {', '.join(parts)} from {source}"


def _digits(names: list[str], d: int | None = 6) -> dict[str, int | None]:
    return dict.fromkeys(names, d)


# --- sources and sinks ------------------------------------------------------------

_MERGED = {
    **_digits("onpromotion city state type cluster transactions".split(), None),
    **_digits("holiday_type holiday_description holiday_locale transferred".split(), None),
    **_digits(["sales", "dcoilwtico"]),
}
_PROCESSED = {**_MERGED, "sales_raw": 6}


def _scan_csv(v: Views) -> DataFrame:
    folder = v.folder("csv")
    files.write_csv(v.transactions, "transactions", folder)
    return files.scan_csv(v.spark, "transactions", folder)


def _load_bundle(v: Views) -> DataFrame:
    folder = v.folder("bundle")
    # Row numbers that need no global order: the reader only wants a column of that name.
    for name, df in v.tables.items():
        if name in ("train", "test"):
            df = df.withColumn("id", F.xxhash64(*PANEL_KEYS))
        files.write_csv(df, name, folder)
    loaded = files.load_bundle(v.spark, folder)
    counts = [
        df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"))
        for name, df in loaded.items()
    ]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


_add("scan_csv", _scan_csv, "select date, cast(store_nbr as bigint) as store_nbr, "
     "cast(transactions as bigint) as transactions from fx_transactions")
_add("load_bundle", _load_bundle, " union all ".join(
    f"select '{n}' as name, count(*) as n_rows from {t}" for n, t in {
        "train": "fx_train", "test": "fx_test", "stores": "fx_stores", "oil": "fx_oil",
        "holidays_events": "fx_holidays", "transactions": "fx_transactions"}.items()))
_add("scan_parquet", lambda v: v.train.select(*PANEL_KEYS, "sales", "onpromotion"),
     "select date, store_nbr, family, sales, onpromotion from fx_train")


def _sink_processed(v: Views) -> DataFrame:
    folder = v.folder("processed")
    done = PP.preprocess(v.tables)
    files.save_processed(G.narrow_types(done["train"]), G.narrow_types(done["test"]), folder)
    train = files.scan_parquet(v.spark, f"{folder}/train_processed.parquet")
    test = files.scan_parquet(v.spark, f"{folder}/test_processed.parquet")
    return (
        train.withColumn("part", F.lit("train"))
        .unionByName(test.withColumn("part", F.lit("test")), allowMissingColumns=True)
        .groupBy("part", "holiday_type", "city")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("transactions").alias("transactions"),
            F.sum("onpromotion").alias("onpromotion"),
            F.round(F.sum(F.col("sales").cast("double")), 1).alias("sales"),
        )
    )


_add("sink_processed", _sink_processed, """select part, holiday_type, city, count(*) as n_rows,
    cast(sum(transactions) as bigint) as transactions,
    cast(sum(onpromotion) as bigint) as onpromotion, round(sum(sales), 1) as sales
  from (select 'train' as part, holiday_type, city, transactions, onpromotion, sales from processed
    union all select 'test', p.holiday_type, p.city, p.transactions, p.onpromotion, null
    from processed p join fx_test using (date, store_nbr, family))
  group by part, holiday_type, city""")


def _sink_features(v: Views) -> DataFrame:
    found = []
    for h in (7, 30):
        path = files.save_features(v.features(h), h, v.folder("features"))
        found.append(
            files.scan_parquet(v.spark, path)
            .groupBy("store_nbr")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tiene_promo").alias("promo_days"))
            .withColumn("horizon", F.lit(h))
        )
    return found[0].unionByName(found[1])


_add("sink_features", _sink_features, " union all ".join(
    f"""select store_nbr, count(*) as n_rows, cast(sum(tiene_promo) as bigint) as promo_days,
    {h} as horizon from features_{h} group by store_nbr""" for h in (7, 30)))


def _sink_metrics(v: Views) -> DataFrame:
    folder = v.folder("metrics")
    files.save_metrics(v.family_metrics(), E.evaluate_by_store(v.holdout()), 7, folder)
    family = files.scan_parquet(v.spark, f"{folder}/family_metrics_h7.parquet")
    store = files.scan_parquet(v.spark, f"{folder}/store_metrics_h7.parquet")
    columns = ["key", "rmse", "mae", "n_rows"]
    return family.withColumn("key", F.col("family")).select(*columns).unionByName(
        store.withColumn("key", F.col("store_nbr").cast("string")).select(*columns)
    )


_add("sink_metrics", _sink_metrics, """select family as key, rmse, mae, n_rows from family_metrics
  union all select cast(store_nbr as varchar), rmse, mae, n_rows from store_metrics""")


def _sink_merged(v: Views) -> DataFrame:
    folder = v.folder("merged")
    test = enrich_panel(v.tables["test"], v.stores, v.oil, v.transactions, v.holidays)
    files.save_merged(v.merged(), test, folder)
    read = [
        files.scan_parquet(v.spark, f"{folder}/{n}_merged.parquet")
        .groupBy("store_nbr", "holiday_type")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("dcoilwtico").alias("with_oil"))
        .withColumn("part", F.lit(n))
        for n in ("train", "test")
    ]
    return read[0].unionByName(read[1])


_add("sink_merged", _sink_merged, """select store_nbr, holiday_type, count(*) as n_rows,
    count(dcoilwtico) as with_oil, part from (select *, 'train' as part from merged union all
    select m.*, 'test' from merged m join (select distinct date from fx_test) using (date))
  group by part, store_nbr, holiday_type""")


def _sink_forecast(v: Views) -> DataFrame:
    path = files.save_forecast(v.naive_forecast(7), 7, v.folder("forecast"))
    return files.scan_parquet(v.spark, path)


_add("sink_forecast", _sink_forecast, "select * from naive_forecast_7", O._future(7))


def _state_tables(v: Views) -> DataFrame:
    folder = v.folder("state")
    files.save_state(folder, 7, {"stats": G.series_stats(v.processed())})
    _, tables = files.load_state(v.spark, folder, 7, ["stats"], with_model=False)
    return tables["stats"].select(
        *SERIES,
        F.round("venta_media_historica", 6).alias("venta_media_historica"),
        F.round("venta_std_historica", 6).alias("venta_std_historica"),
    )


_STATS_SQL = """select store_nbr, family, round(venta_media_historica, 6) as venta_media_historica,
  round(venta_std_historica, 6) as venta_std_historica from stats"""
_add("store_stats_state", _state_tables, _STATS_SQL)

# --- quality ----------------------------------------------------------------------


def _nulls_sql(source: str, columns: list[str]) -> str:
    parts = " union all ".join(
        f"select '{c}' as column_name, count(*) - count({c}) as nulls, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 2) as pct from {source}"
        for c in columns
    )
    return f"select * from ({parts}) where nulls > 0"


_MERGED_COLUMNS = """date store_nbr family sales onpromotion city state type cluster dcoilwtico
  transactions holiday_type holiday_description holiday_locale transferred""".split()
_add("null_report", lambda v: Q.null_report(v.merged().select(*_MERGED_COLUMNS)),
     _nulls_sql("merged", _MERGED_COLUMNS))
_add("schema_check", lambda v: Q.check_schema(v.oil, "oil", ["date", "dcoilwtico"]),
     _nulls_sql("fx_oil", ["date", "dcoilwtico"]))
_add("dup_keys", lambda v: Q.duplicate_keys(v.merged()), """select
    cast(coalesce(sum(n - 1), 0) as bigint) as duplicates
  from (select count(*) as n from merged group by date, store_nbr, family)""")
_add("holiday_multi_dates", lambda v: Q.repeated_dates(v.holidays), """select h.*, n from fx_holidays h
  join (select date, count(*) as n from fx_holidays group by date having count(*) > 1) using (date)""")
_add("inspect_table", lambda v: Q.inspect_table(v.train, PANEL_KEYS), """select t.*, s.* from (
    (select *, 'first' as edge from fx_train order by date, store_nbr, family limit 3) union all
    (select *, 'last' from fx_train order by date desc, store_nbr desc, family desc limit 3)) t,
  (select count(*) as n_rows, min(date) as min_date, max(date) as max_date from fx_train) s""")
_add("store_coverage", lambda v: Q.key_coverage(v.train, v.stores, "store_nbr"), """select
    (select count(distinct store_nbr) from fx_train) as n_left,
    (select count(distinct store_nbr) from fx_stores) as n_right,
    not exists (select store_nbr from fx_train except select store_nbr from fx_stores) and
    not exists (select store_nbr from fx_stores except select store_nbr from fx_train)
      as equal_sets""")
_add("panel_profile", lambda v: Q.panel_profile(v.train), """select count(*) as n_rows,
    min(date) as min_date, max(date) as max_date, count(distinct store_nbr) as n_stores,
    count(distinct family) as n_families, count(distinct (store_nbr, family)) as n_series
  from fx_train""")


def _describe_sql(source: str, value: str) -> str:
    q = ", ".join(
        f"round(quantile_cont(cast({value} as double), {p}), 2) as p{int(p * 100)}"
        for p in (0.25, 0.5, 0.75)
    )
    return f"""select count({value}) as n, round(avg({value}), 2) as mean,
      round(stddev_samp({value}), 2) as std, round(cast(min({value}) as double), 2) as min,
      round(cast(max({value}) as double), 2) as max,
      count(*) filter ({value} = 0) as zeros,
      round(avg(cast({value} = 0 as int)) * 100, 1) as pct_zeros,
      count(*) filter ({value} < 0) as negatives, {q} from {source}"""


_add("describe_sales", lambda v: X.describe(v.train, "sales"), _describe_sql("fx_train", "sales"))
_add("describe_promo", lambda v: X.describe(v.train, "onpromotion"),
     _describe_sql("fx_train", "onpromotion"))
_add("describe_oil", lambda v: X.describe(v.oil, "dcoilwtico"), _describe_sql("fx_oil", "dcoilwtico"))
_add("describe_transactions", lambda v: X.describe(v.transactions, "transactions"),
     _describe_sql("fx_transactions", "transactions"))


def _requests(v: Views) -> DataFrame:
    """Requests as events bring them: some out of range, some without a family."""
    return v.retail.raw("events").select(
        "event_id",
        (F.col("user_id") % 60).cast("int").alias("store_nbr"),
        F.when(F.col("event_id") % 5 == 0, 14).when(F.col("event_id") % 2 == 0, 7).otherwise(30)
        .alias("horizon"),
        F.when(F.col("event_type") != "view", (F.col("event_id") % 36).cast("int")).alias("family"),
    )


_add("validate_requests", lambda v: Q.validate_requests(_requests(v), 54, 33), """
  select *, reason is null as valid from (select *, case
      when not store_nbr between 1 and 54 then 'store_nbr'
      when horizon not in (7, 30) then 'horizon'
      when not family between 0 and 32 then 'family' end as reason
    from (select event_id, cast(user_id % 60 as int) as store_nbr,
      case when event_id % 5 = 0 then 14 when event_id % 2 = 0 then 7 else 30 end as horizon,
      case when event_type <> 'view' then cast(event_id % 36 as int) end as family from events))""")

_IMPUTED = ["dcoilwtico", "transactions", "holiday_type", "holiday_description", "transferred"]
_add("impute_audit", lambda v: Q.imputation_audit(v.merged(), v.processed(), _IMPUTED),
     " union all ".join(
         f"select '{c}' as column_name, count(*) - count({c}) as nulls, '{s}' as stage from {t}"
         for s, t in (("before", "merged"), ("after", "processed")) for c in _IMPUTED))
_add("target_range", lambda v: Q.target_range(v.processed()), """select
    round(min(sales_raw), 2) as min_raw, round(max(sales_raw), 2) as max_raw,
    round(min(sales), 2) as min_log, round(max(sales), 2) as max_log from processed""")


def _lag_nulls_sql(h: int) -> str:
    lags = [f"lag_{k}" for k in LAGS[h]] + [f"oil_lag_{k}" for k in LAGS[h]]
    lags += [f"promo_lag_{h}", f"trans_lag_{h}"]
    source = f"""(select w.*, d.* exclude (date) from windowed_{h} w join days_{h} d
      on w.date = d.date)"""
    any_null = " or ".join(f"{c} is null" for c in lags)
    return " union all ".join(
        f"""select '{c}' as column_name, round(avg(cast({c} is null as int)) * 100, 4) as null_pct,
        count(*) filter ({any_null}) as rows_dropped from {source}""" for c in lags)


def _lag_null_pct(v: Views) -> DataFrame:
    df = P.raw_features(v.processed(), 7, v.state(stats=False))
    return Q.lag_nulls(df, P.lag_names(df))


_add("lag_null_pct", _lag_null_pct, _lag_nulls_sql(7))


def _difference_sql() -> str:
    """Columns of the daily feature table beside those of the monthly one."""
    have, want = [c for c in O.feature_columns(7)], [c for c in O.feature_columns(30)]
    parts = [f"select '{c}' as column_name, '{'expected' if c in want else 'extra'}' as status, count({c}) as filled from features_7" for c in have]
    parts += [f"select '{c}', 'missing', cast(null as bigint)" for c in want if c not in have]
    return " union all ".join(parts)


_add("column_difference", lambda v: Q.column_difference(
        v.features(7).select(*O.feature_columns(7)), list(O.feature_columns(30))), _difference_sql())
_add("oil_null_days", lambda v: Q.days_without_quote(v.oil),
     "select date from fx_oil where dcoilwtico is null")

# --- projections and filters --------------------------------------------------------


def _holiday_split(v: Views) -> DataFrame:
    parts = [
        t.withColumns({c: F.lit(None).cast("string") for c in ("state", "city") if c not in t.columns})
        for t in split_holidays(v.holidays).values()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_add("holiday_split", _holiday_split, """select * from h_nat union all by name select * from h_reg
  union all by name select * from h_loc""")
_add("holiday_dedup", lambda v: split_holidays(v.holidays)["National"], "select * from h_nat")
_add("log_target", lambda v: rounded(G.log_target(v.train), _digits(["sales", "sales_raw"])),
     rounded_sql("(select date, store_nbr, family, ln(1 + sales) as sales, sales as sales_raw "
                 "from fx_train)", _digits(["sales", "sales_raw"])))


def _narrow(v: Views) -> DataFrame:
    df = G.narrow_types(v.processed())
    return df.select(*PANEL_KEYS, "transactions", F.round(F.col("sales").cast("double"), 3).alias("sales"))


_add("narrow_types", _narrow, """select date, store_nbr, family, transactions,
  round(cast(cast(sales as real) as double), 3) as sales from processed""")
_add("narrow_type_names", lambda v: G.narrow_types(v.processed()).groupBy().agg(
        *[F.max(F.typeof(c)).alias(c) for c in ("sales", "dcoilwtico", "transactions", "cluster")],
        F.count(F.lit(1)).alias("n_rows")),
     """select 'float' as sales, 'float' as dcoilwtico, 'int' as transactions, 'int' as cluster,
       count(*) as n_rows from processed""")
_add("feature_selection", lambda v: v.features(7).groupBy().agg(
        F.lit(len(P.feature_columns(v.features(7)))).alias("n_features"),
        F.count(F.lit(1)).alias("n_rows")),
     f"select {len([c for c in O.feature_columns(7) if c not in ('sales', 'sales_raw')]) + 2} "
     "as n_features, count(*) as n_rows from features_7")


def _split(v: Views) -> DataFrame:
    train, test = V.holdout_split(v.processed())
    mark = [train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test"))]
    return mark[0].unionByName(mark[1]).groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("d0"), F.max("date").alias("d1")
    )


_add("holdout_split", _split, """select case when date <= m - 56 then 'train' else 'test' end as part,
    count(*) as n_rows, min(date) as d0, max(date) as d1
  from processed, (select max(date) as m from processed) group by 1""")
_add("lookback_history",
     lambda v: rounded(V.lookback(v.processed()), _digits(["sales", "dcoilwtico"])),
     rounded_sql(f"(select * from processed where date >= {O.LOOKBACK})",
                 _digits(["sales", "dcoilwtico"])))
_add("event_window", lambda v: X.event_window(v.train, "1999-04-16"), """select date,
    sum(sales) as total_sales from fx_train
  where date between date '1999-04-16' - 30 and date '1999-04-16' + 30 group by date""")
_add("drop_null_lags", lambda v: v.features(7).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date")),
     """select store_nbr, family, count(*) as n_rows, min(date) as first_date from features_7
     group by store_nbr, family""")
_add("sample_weights", lambda v: V.sample_weights(
        apply_codes(v.processed().select(*PANEL_KEYS), v.state(stats=False)["codes"], ["family"]),
        settings=SETTINGS),
     """select p.date, p.store_nbr, code as family,
       case when code in (1, 3) then 5.0::double else 1.0::double end as weight
     from fx_train p join (select family, cast(row_number() over (order by family) - 1 as int) as code
       from (select distinct family from fx_train)) c on c.family = p.family""")
_add("iqr_outliers", lambda v: X.iqr_outliers(v.train), """
  , b as (select q3 + 3 * (q3 - q1) as bound from (select quantile_cont(sales, 0.25) as q1,
      quantile_cont(sales, 0.75) as q3 from fx_train)),
    o as (select * from fx_train, b where sales > bound)
  select 'total' as kind, 'all' as key, (select count(*) from o) as n,
    round((select count(*) from o) * 100.0 / (select count(*) from fx_train), 2) as pct
  union all (select 'family', family, count(*) as n, null from o group by family
    order by n desc, family limit 10)
  union all (select 'store_nbr', cast(store_nbr as varchar) as key, count(*) as n, null from o
    group by store_nbr order by n desc, key limit 10)""")

# --- enrichment and imputation ---------------------------------------------------------

_add("enrich_panel", lambda v: rounded(v.merged(), _MERGED), rounded_sql("merged", _MERGED))
_HOLIDAY = _digits("holiday_type holiday_description holiday_locale transferred".split(), None)
_add("holiday_resolve", lambda v: rounded(v.with_holidays(), _HOLIDAY), rounded_sql("merged", _HOLIDAY))
_add("impute_nulls", lambda v: rounded(impute_nulls(v.merged()), {**_HOLIDAY, "transactions": None}),
     rounded_sql("processed", {**_HOLIDAY, "transactions": None}))
_add("oil_by_day", lambda v: oil_by_day(v.train.select("date").distinct(), v.oil).select(
        "date", F.round("dcoilwtico", 6).alias("dcoilwtico")),
     "select date, round(dcoilwtico, 6) as dcoilwtico from oil_day")
_ROWS = "partition by store_nbr order by date, family"
_OIL_ROWS = """(select date, store_nbr, family, coalesce(v,
          case when pl is not null and pr is not null
            then vl + (vr - vl) * (p - pl) / (pr - pl) end, vl, vr) as dcoilwtico
        from (select *,
          last_value(case when v is not null then p end ignore nulls) over b as pl,
          last_value(v ignore nulls) over b as vl,
          first_value(case when v is not null then p end ignore nulls) over a as pr,
          first_value(v ignore nulls) over a as vr
        from (select t.date, store_nbr, family, dcoilwtico as v,
            row_number() over (partition by store_nbr order by t.date, family) as p
          from fx_train t left join fx_oil o on t.date = o.date)
        window b as (partition by store_nbr order by p
                 rows between unbounded preceding and current row),
               a as (partition by store_nbr order by p
                 rows between current row and unbounded following)))"""
_add("oil_interpolate", lambda v: rounded(oil_by_row(v.train, v.oil), _digits(["dcoilwtico"])),
     rounded_sql(_OIL_ROWS, _digits(["dcoilwtico"])))
_add("fill_edges", lambda v: fill_edges(v.train.select("date").distinct().join(
        by_day(v.oil), "date", "left"), "dcoilwtico", [], ["date"]),
     """select date, coalesce(last_value(dcoilwtico ignore nulls) over (order by date
         rows between unbounded preceding and current row),
       first_value(dcoilwtico ignore nulls) over (order by date
         rows between current row and unbounded following)) as dcoilwtico from oil_days""")
_add("preprocess", lambda v: rounded(PP.preprocess(v.tables)["train"], _PROCESSED),
     rounded_sql("processed", _PROCESSED))
_add("preprocess_row", lambda v: rounded(PP.preprocess(v.tables, oil_grain="row")["train"], _PROCESSED),
     rounded_sql(f"""(select p.* exclude (dcoilwtico), o.dcoilwtico
       from processed p join {_OIL_ROWS} o using (date, store_nbr, family))""", _PROCESSED))
_add("preprocess_test", lambda v: rounded(PP.preprocess(v.tables, predict=True)["test"], _HOLIDAY),
     rounded_sql("(select p.* from processed p join fx_test using (date, store_nbr, family))", _HOLIDAY))

# --- features ---------------------------------------------------------------------------

_CALENDAR = """dia_semana es_fin_de_semana semana_del_año semana_del_mes trimestre
  dias_para_fin_de_mes es_quincena es_inicio_mes pico_quincena_findex es_viernes""".split()
_CAL = {**_digits(_CALENDAR, None), **_digits(["day_sin", "day_cos"])}
_add("calendar_features", lambda v: rounded(G.calendar_features(v.train), _CAL),
     rounded_sql(f"(select *, {O.CALENDAR} from fx_train)", _CAL))
_IMPACT = _digits(["es_festivo", "holiday_impact_type"], None)
_add("holiday_impact", lambda v: rounded(G.holiday_flags(v.processed()), _IMPACT),
     rounded_sql("flagged", _IMPACT))
_add("holiday_distance", lambda v: X.daily_with_distance(v.with_holidays()).drop("es_festivo"),
     "select * from daily_distance")
for _h in (7, 30):
    _lag = _digits([f"lag_{k}" for k in LAGS[_h]])
    _roll = _digits([f"rolling_{f}_{w}d" for w in ROLLING_WINDOWS[_h] for f in ("mean", "std", "max")])
    _all = O.feature_columns(_h)
    _add(f"target_lags_h{_h}", lambda v, h=_h, c=_lag: rounded(G.target_lags(v.processed(), h), c),
         rounded_sql(f"windowed_{_h}", _lag))
    _add(f"features_h{_h}_row", lambda v, h=_h, c=_all: rounded(v.features(h, "row"), c),
         rounded_sql(f"row_features_{_h}", _all), O.row_grain(_h, _ROWS))
    _add(f"rolling_h{_h}",
         lambda v, h=_h, c={**_roll, "cv_ventas": 6}: rounded(G.rolling_features(v.processed(), h), c),
         rounded_sql(f"""(select *, rolling_std_{ROLLING_WINDOWS[_h][-1]}d
           / (rolling_mean_{ROLLING_WINDOWS[_h][-1]}d + 1e-6) as cv_ventas from windowed_{_h})""",
                     {**_roll, "cv_ventas": 6}))
    _add(f"features_h{_h}", lambda v, h=_h, c=_all: rounded(v.features(h), c),
         rounded_sql(f"features_{_h}", _all))
_PROMO = {"tiene_promo": None, "promo_lag_7": None, "rolling_promo_mean_14": 6}
_add("promo_features", lambda v: rounded(G.promo_features(v.train, 7), _PROMO),
     rounded_sql("windowed_7", _PROMO))
_OIL = _digits([f"oil_lag_{k}" for k in LAGS[7]] + [f"oil_rolling_mean_{w}" for w in ROLLING_WINDOWS[7]])


def _oil_days(v: Views) -> DataFrame:
    days = v.processed().groupBy("date").agg(F.max("dcoilwtico").alias("dcoilwtico"))
    return G.oil_day_features(days, 7).select("date", *[F.round(c, 6).alias(c) for c in _OIL])


_add("oil_lags_day", _oil_days, "select date, "
     + ", ".join(f"round({c}, 6) as {c}" for c in _OIL) + " from days_7")
_add("oil_lags_row", lambda v: rounded(G.oil_row_features(v.processed(), 7), _OIL),
     rounded_sql(f"(select *, {O._oil(7, _ROWS)} from processed)", _OIL))
_TRANS = {"trans_lag_7": None, "trans_rolling_mean_7": 6}
_add("trans_features_day", lambda v: rounded(G.trans_day_features(v.processed(), 7), _TRANS),
     rounded_sql("windowed_7", _TRANS))
_add("trans_features_row", lambda v: rounded(G.trans_row_features(v.processed(), 7), _TRANS),
     rounded_sql(f"(select *, {O._trans(7, _ROWS)} from processed)", _TRANS))
_add("series_stats", lambda v: v.state()["stats"].select(
        *SERIES, F.round("venta_media_historica", 6).alias("venta_media_historica"),
        F.round("venta_std_historica", 6).alias("venta_std_historica")), _STATS_SQL)
_add("store_totals", lambda v: v.state()["ranking"].select("store_nbr", F.round("total", 4).alias("total")),
     "select store_nbr, round(sum(sales), 4) as total from processed group by store_nbr")
_add("store_ranking", lambda v: v.state()["ranking"].select("store_nbr", "ranking_tienda"),
     "select store_nbr, ranking_tienda from ranking")
_STORE = {"venta_media_historica": 6, "venta_std_historica": 6, "ranking_tienda": None}
_add("store_features", lambda v: rounded(
        P.store_features(v.processed(), v.state(stats=False)["ranking"]), _STORE),
     rounded_sql("""(select p.*, venta_media_historica, venta_std_historica, ranking_tienda
       from processed p join stats s on p.store_nbr = s.store_nbr and p.family = s.family
       join ranking r on p.store_nbr = r.store_nbr)""", _STORE))
_add("series_std", lambda v: G.series_std(v.processed()).select(
        *SERIES, F.round("std_sales", 6).alias("std_sales")),
     """select store_nbr, family, round(exp(venta_std_historica) - 1, 6) as std_sales from stats""")
_add("label_codes", lambda v: v.state(stats=False)["codes"], "select * from codes")
_ENC = _digits([c for c in O.CODED if c != "family"], None)


def _encoded(v: Views) -> DataFrame:
    df = apply_codes(G.holiday_flags(v.processed()), v.state(stats=False)["codes"], P.ENCODED)
    return rounded(df, _ENC)


_add("label_encode", _encoded,
     "select w.date, w.store_nbr, c.code as family, "
     + ", ".join(f"coalesce(c{i}.code, -1) as {c}" for i, c in enumerate(_ENC))
     + " from flagged w join codes c on c.column_name = 'family' and c.value = w.family "
     + " ".join(f"left join codes c{i} on c{i}.column_name = '{c}' "
                f"and c{i}.value = cast(w.{c} as varchar)" for i, c in enumerate(_ENC)))

# --- folds and evaluation ------------------------------------------------------------------

_add("walk_forward_folds", lambda v: V.walk_forward_folds(v.fold_rows()), "select * from folds")
_add("fold_description", lambda v: V.describe_folds(V.walk_forward_folds(v.fold_rows())), """
  select fold, 'train' as role, train_start as start_date, train_end as end_date, n_train as n_rows
  from folds union all select fold, 'val', val_start, val_end, n_val from folds""")
_add("date_positions", lambda v: V.date_positions(v.processed()).select(
        "date", F.col("position").cast("bigint").alias("position")),
     """select date, row_number() over (order by date) - 1 as position
     from (select distinct date from processed)""")
_add("fold_metrics", lambda v: v.fold_metrics(), "select * from fold_metrics")
_add("cv_summary", lambda v: E.cv_summary(v.fold_metrics()), "select " + ", ".join(
    f"{O.mean_of_rounded(m)} as {m}_mean, round(stddev_pop({m}), 4) as {m}_std"
    for m in ("rmse", "mae", "mape", "rmsle", "wape")) + " from fold_metrics")
_add("eval_global", lambda v: E.evaluate(v.holdout(), []),
     f"select {O.metrics()}, count(*) as n_rows from holdout")
_add("eval_by_family", lambda v: v.family_metrics(), "select * from family_metrics")
_add("family_log_wape", lambda v: E.log_wape(v.holdout(), ["family"]), """select family,
  round(case when sum(sales) <> 0 then sum(abs(sales - y_pred)) / sum(sales) end, 6) as log_wape
  from holdout group by family""")
_add("eval_by_store", lambda v: E.evaluate_by_store(v.holdout()), "select * from store_metrics")
_add("eval_by_date", lambda v: E.error_by_date(v.holdout()), "select * from date_metrics")
_add("worst_families", lambda v: E.worst(v.saved_family_metrics(), "rmse", 5, "family"),
     "select * from family_metrics order by rmse desc nulls last, family limit 5")
_add("worst_stores", lambda v: E.worst(E.evaluate_by_store(v.holdout()), "rmse", 5, "store_nbr"),
     "select * from store_metrics order by rmse desc nulls last, store_nbr limit 5")
_add("worst_dates", lambda v: E.worst(E.error_by_date(v.holdout()), "mae_diario", 10, "date"),
     "select * from date_metrics order by mae_diario desc nulls last, date limit 10")


def _reports_sql() -> str:
    """The reports of the naive forecast, one after the other."""
    keys = {"global": "'all'", "family": "family", "store": "cast(store_nbr as varchar)", "date": "cast(date as varchar)"}
    parts = [
        f"""select '{name}' as report, {key} as key, {O.metrics()}, count(*) as n_rows,
          round(case when sum(sales) <> 0 then sum(abs(sales - y_pred)) / sum(sales) end, 6) as log_wape,
          round(avg(abs((exp(sales) - 1) - (exp(y_pred) - 1))), 6) as mae_diario,
          round(stddev_samp(abs((exp(sales) - 1) - (exp(y_pred) - 1))), 6) as std_diario
        from holdout group by {key if name != "global" else "()"}"""
        for name, key in keys.items()
    ]
    return " union all ".join(parts)


def _eval_reports(v: Views) -> DataFrame:
    table = E.report_table(v.holdout())
    name, key = F.lit("global"), F.lit("all")
    for report, (column, level) in E.REPORTS.items():
        if column:
            name = F.when(F.col("level") == level, report).otherwise(name)
            key = F.when(F.col("level") == level, F.col(column).cast("string")).otherwise(key)
    return table.select(
        name.alias("report"), key.alias("key"), *METRICS, "n_rows", "log_wape", "mae_diario", "std_diario"
    )


_add("eval_reports", _eval_reports, _reports_sql())
_add("series_compare", lambda v: E.series_compare(v.holdout(), 4, "ECONOMY"), """select date,
    round(exp(sales) - 1, 6) as actual, round(exp(y_pred) - 1, 6) as predicted,
    round(abs((exp(sales) - 1) - (exp(y_pred) - 1)), 6) as abs_error
  from holdout where store_nbr = 4 and family = 'ECONOMY'""")
_add("family_flags", lambda v: E.family_flags(v.saved_family_metrics()), f"""select family, rmse,
    mean_rmse, rmse > mean_rmse as above_mean
  from family_metrics, (select {O.mean_of_rounded("rmse")} as mean_rmse from family_metrics)""")
_add("metrics_summary", lambda v: E.metrics_summary(v.saved_family_metrics()), "select " + ", ".join(
    f"{O.mean_of_rounded(m)} as {m}" for m in ("rmse", "mae", "mape", "rmsle", "wape"))
    + " from family_metrics")


def _decision(v: Views) -> DataFrame:
    rows = v.holdout(year=True)
    return E.champion_challenger(E.evaluate(rows, []), E.evaluate(rows, [], yhat="y_year"))


_add("champion_challenger", _decision, f"""select before, after,
    round((before - after) / before * 100, 4) as gain_pct,
    (before - after) / before * 100 >= 1.0 as accepted
  from (select rmse as before from (select {O.metrics()} from holdout_year)),
       (select rmse as after from (select {O.metrics(p="y_year")} from holdout_year))""")

# --- forecast -----------------------------------------------------------------------------

_GRID_SQL = "select date, store_nbr, family, cast(sales as double) as sales from grid"
_add("future_grid", lambda v: FC.future_grid(V.lookback(v.processed()), 7).select(
        *PANEL_KEYS, "sales"), _GRID_SQL, O._future(7))
_BOTH = {**_HOLIDAY, "onpromotion": None, "transactions": None, "sales": 6, "dcoilwtico": 6}
_add("history_union_future", lambda v: rounded(FC.history_with_future(
        V.lookback(v.processed()), v.tables, 7), _BOTH), rounded_sql("joined", _BOTH), O._future(7))
for _h in (7, 30):
    _cols = {c: d for c, d in O.feature_columns(_h).items() if c not in ("sales", "sales_raw")}
    _add("prediction_input" if _h == 7 else "prediction_input_h30",
         lambda v, h=_h, c=_cols: rounded(v.prediction_input(h), c),
         rounded_sql(f"pred_input_{_h}", _cols), O._future(_h))
    _add("forecast_interval" if _h == 7 else "forecast_interval_h30",
         lambda v, h=_h: v.naive_forecast(h), f"select * from naive_forecast_{_h}", O._future(_h))
_add("sink_prediction_input", lambda v: rounded(v.combined(7), _BOTH),
     rounded_sql("joined", _BOTH), O._future(7))
_add("predict_store", lambda v: FC.forecast_of_store(
        v.written("naive_forecast_7", lambda: v.naive_forecast(7)), 4),
     "select * from naive_forecast_7 where store_nbr = 4", O._future(7))
_add("forecast_monthly_view", lambda v: FC.monthly_view(v.naive_forecast(30)).withColumn(
        "predicted_sales", F.round("predicted_sales", 2)),
     """select store_nbr, family, cast(date_trunc('month', date) as date) as month,
       round(sum(predicted_sales), 2) as predicted_sales from naive_forecast_30
     group by 1, 2, 3""", O._future(30))

# --- model (no SQL can state these) -----------------------------------------------------


def _fit_fold(v: Views) -> DataFrame:
    rows = v.vectors(7)
    fold = V.walk_forward_folds(rows, SETTINGS).orderBy(F.desc("fold")).first().asDict()
    _, rounds, scored = TR.fit_fold(rows, fold, v.params(7))
    return E.evaluate(scored, []).withColumns(
        {"fold": F.lit(fold["fold"]), "rounds": F.lit(rounds)}
    )


def _train_cv(v: Views, horizon: int) -> DataFrame:
    return TR.cv_table(v.spark, TR.train_cv(v.vectors(horizon), v.params(horizon), SETTINGS)[0])


def _training_run(v: Views, horizon: int) -> DataFrame:
    """Folds and final fit: metrics of the folds, read back from where they are kept, and of the holdout."""
    df, folder = v.prepared(horizon), v.folder("training")
    stage = lambda _: v.vectors(horizon)
    model, results, rounds = TR.train(df, horizon, v.params(horizon), SETTINGS, stage)
    files.save_state(folder, horizon, v.state(), model)
    saved = files.save_cv(TR.cv_table(v.spark, results), horizon, folder)
    folds = E.cv_summary(files.scan_parquet(v.spark, saved))
    holdout = E.evaluate(model.transform(V.holdout_split(df, SETTINGS)[1]), [])
    scores = holdout.select(F.struct(*holdout.columns)).scalar()
    return folds.withColumn("rounds", F.lit(rounds)).withColumn("t", scores).select(
        *folds.columns, "rounds", *[F.col(f"t.{c}").alias(f"test_{c}") for c in holdout.columns]
    )


def _fit_final(v: Views, horizon: int) -> DataFrame:
    model = v.model(horizon)
    scored = model.transform(V.holdout_split(v.prepared(horizon), SETTINGS)[1])
    return E.evaluate(scored, []).withColumn("rounds", F.lit(model.stages[1].getNumTrees))


def _evaluation_run(v: Views) -> DataFrame:
    """All six reports on the holdout; those of families and stores are written where a service would read them."""
    stage = lambda df: v.written(f"reports_{v.params(7).rounds}", lambda: df)
    reports = TR.evaluate_all(v.prepared(7), v.model(7), SETTINGS, stage)
    files.save_metrics(reports["family"], reports["store"], 7, v.folder("evaluation"))
    return TR.all_reports(reports)


_add("fit_fold", _fit_fold)
for _h in (7, 30):
    _suffix = "" if _h == 7 else "_h30"
    _add(f"train_cv{_suffix}", lambda v, h=_h: _train_cv(v, h))
    _add(f"fit_final{_suffix}", lambda v, h=_h: _fit_final(v, h))
_add("training_run", lambda v: _training_run(v, 30))
_add("training_run_h7", lambda v: _training_run(v, 7))
_add("feature_importance", lambda v: E.worst(
    TR.importance(v.model(7), v.spark), "importance", 30, "feature"))
_add("evaluation_run", _evaluation_run)
for _h in (7, 30):
    _add(f"forecast_h{_h}", lambda v, h=_h: v.model_forecast(h))

# --- exploration ------------------------------------------------------------------------

_ZEROS_SQL = """select family, round(avg(cast(sales = 0 as int)) * 100, 1) as pct_zeros
  from fx_train group by family"""
_add("zeros_by_family", lambda v: X.zeros_by_family(v.train), _ZEROS_SQL)
_add("family_segments", lambda v: X.family_segments(v.train), f"""select *,
    count(*) over (partition by segment) as n_in_segment from (select *, case
      when pct_zeros < 30 then 'core' when pct_zeros > 50 then 'sporadic' else 'intermediate'
      end as segment from ({_ZEROS_SQL}))""")
_add("sales_by_family", lambda v: X.total_sales(v.train, "family"),
     "select family, sum(sales) as total_sales from fx_train group by family")
_BY_STORE = "select store_nbr, sum(sales) as total_sales from fx_train group by store_nbr"
_add("sales_by_store", lambda v: X.total_sales(v.train, "store_nbr"), _BY_STORE)
_add("store_extremes", lambda v: X.edges_of_ranking(X.total_sales(v.train, "store_nbr"), "store_nbr"),
     f"""(select *, 'top' as edge from ({_BY_STORE}) order by total_sales desc, store_nbr limit 5)
     union all (select *, 'bottom' from ({_BY_STORE}) order by total_sales, store_nbr desc limit 5)""")
_add("daily_sales", lambda v: X.total_sales(v.train, "date"), "select * from daily")
_add("monthly_sales", lambda v: X.monthly_sales(v.train), """select
    cast(date_trunc('month', date) as date) as month, sum(sales) as total_sales
  from fx_train group by 1""")


def _name_sql(number: str, name: str, source: str = "fx_train", value: str = "sales") -> str:
    return f"""select *, mean_value = max(mean_value) over () as is_max,
      mean_value = min(mean_value) over () as is_min
    from (select cast({number} as int) as position, {name}(date) as name,
      round(avg({value}), 6) as mean_value from {source} group by 1, 2)"""


_add("dow_sales", lambda v: X.by_weekday(v.train), _name_sql("isodow(date) - 1", "dayname"))
_add("month_seasonality", lambda v: X.by_month(v.train), _name_sql("month(date)", "monthname"))
_add("yoy_sales", lambda v: X.yearly_comparison(v.train), """select cast(year(date) as int) as year,
    cast(month(date) as int) as month, sum(sales) as total_sales from fx_train group by 1, 2""")
_add("holiday_counts", lambda v: X.holiday_counts(v.holidays), """
  select 'distinct_dates' as kind, 'all' as value, count(distinct date) as n from fx_holidays
  union all (select 'description', description, count(*) as n from fx_holidays
    group by description order by n desc, description limit 10)
  union all select 'type', type, count(*) from fx_holidays group by type
  union all select 'locale', locale, count(*) from fx_holidays group by locale
  union all select 'transferred', cast(transferred as varchar), count(*) from fx_holidays
    group by transferred""")
_add("holiday_effect", lambda v: X.holiday_effect(v.with_holidays()), """select
    cast(holiday_type is not null as int) as es_festivo, round(avg(sales), 2) as mean,
    round(median(sales), 2) as median, round(stddev_samp(sales), 2) as std from merged group by 1""")
_add("holiday_type_mean", lambda v: X.holiday_type_mean(v.with_holidays()), """select holiday_type,
    round(avg(sales), 6) as mean_sales from merged where holiday_type is not null group by 1""")
_add("locale_impact", lambda v: X.locale_impact(v.with_locale()), """
  select 'holiday' as form, locale, round(avg(sales), 2) as mean, round(median(sales), 2) as median,
    count(sales) as n from with_locale
  where holiday_type is not null and locale is not null group by locale
  union all select 'all', coalesce(locale, 'Normal'), round(avg(sales), 2), null, null
  from with_locale group by 2""")
_add("holiday_window", lambda v: X.holiday_window(v.with_holidays()), " union all ".join(
    f"""select {c} as days, round(avg(total_sales), 6) as mean_total, '{s}' as side
    from daily_distance where {c} <= 7 group by {c}"""
    for c, s in (("dias_para_siguiente_festivo", "before"), ("dias_desde_ultimo_festivo", "after"))))
_add("promo_impact", lambda v: X.promo_impact(v.train), """select
    cast(onpromotion > 0 as int) as tiene_promo, round(avg(sales), 2) as mean,
    round(median(sales), 2) as median, count(*) as n,
    round(count(*) * 100.0 / sum(count(*)) over (), 1) as share_pct from fx_train group by 1""")
_add("promo_lift", lambda v: X.promo_lift(v.train), """select family,
    round(avg(cast(onpromotion > 0 as int)), 3) as pct_promo,
    round(avg(case when onpromotion > 0 then sales end)
      / nullif(avg(case when onpromotion = 0 then sales end), 0), 3) as lift_promo
  from fx_train group by family""")
_add("holiday_promo", lambda v: X.holiday_promo(v.with_holidays()), """select
    case when holiday_type is not null then 'Sí' else 'No' end as "Festivo",
    case when onpromotion > 0 then 'Sí' else 'No' end as "Promocion",
    round(avg(sales), 2) as mean_sales from merged group by 1, 2""")
_add("holiday_detail", lambda v: X.holiday_detail(v.with_holidays()), """select *,
    round((mean - baseline) / baseline * 100, 1) as vs_baseline from (select holiday_description,
      round(avg(sales), 2) as mean, count(sales) as n from merged
    where holiday_type is not null and onpromotion = 0 group by 1),
    (select avg(sales) as baseline from merged where holiday_type is null and onpromotion = 0)""")
ORACLES["holiday_detail"] = ORACLES["holiday_detail"].replace(
    "select *,\n    round((mean", "select holiday_description, mean, n,\n    round((mean")
_add("zeros_holiday", lambda v: X.zeros_by_holiday(v.with_holidays()), """select
    cast(holiday_type is not null as int) as es_festivo,
    round(avg(cast(sales = 0 as int)) * 100, 1) as pct_zeros from merged group by 1""")
_add("transactions_profile", lambda v: X.transactions_profile(v.transactions), f"""
  select 'store' as kind, cast(store_nbr as varchar) as key,
    round(avg(transactions), 6) as mean_value, cast(null as boolean) as is_max from fx_transactions group by store_nbr
  union all select 'weekday', name, mean_value, is_max from (
    {_name_sql("isodow(date) - 1", "dayname", "fx_transactions", "transactions")})""")
_add("trans_sales", lambda v: X.trans_sales(v.merged()), "select * from store_day")
_add("boxplot_stats", lambda v: X.boxplot(X.with_flags(v.with_holidays()), "es_festivo"), """
  , m as (select cast(holiday_type is not null as int) as es_festivo, sales from merged),
    q as (select es_festivo, quantile_cont(sales, 0.25) as q1, quantile_cont(sales, 0.5) as median,
      quantile_cont(sales, 0.75) as q3 from m group by 1)
  select q.es_festivo, q1, median, q3, min(sales) as whisker_low, max(sales) as whisker_high
  from m join q on m.es_festivo = q.es_festivo
  where sales between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by 1, 2, 3, 4""")


def _histogram_sql(values: str) -> str:
    return f"""select bin, count(*) as n from (select cast(least(
        case when b = a then 0 else floor((x - a) / ((b - a) / 100)) end, 99) as int) as bin
      from ({values}), (select min(x) as a, max(x) as b from ({values}))) group by bin"""


_add("sales_histogram", lambda v: X.histogram(v.train, F.col("sales")),
     _histogram_sql("select sales as x from fx_train"))
_add("log_sales_histogram", lambda v: X.histogram(v.train.where("sales > 0"), F.log1p("sales")),
     _histogram_sql("select ln(1 + sales) as x from fx_train where sales > 0"))
_add("sales_vs_oil", lambda v: v.daily_oil().withColumn(
        "oil_interpolated", F.round("oil_interpolated", 6)),
     """select date, total_sales, dcoilwtico, round(oil_interpolated, 6) as oil_interpolated
     from daily_oil""")
_add("corr_oil_sales", lambda v: X.corr_oil_sales(v.daily_oil()), """select
  round(corr(dcoilwtico, total_sales), 3) as corr from daily_oil where oil_interpolated is not null""")
_add("corr_trans_sales", lambda v: X.corr_trans_sales(X.trans_sales(v.merged())),
     "select round(corr(transactions, total_sales), 3) as corr from store_day")
_add("oil_sales_trend", lambda v: X.oil_sales_trend(v.daily_oil()), """select
    cast(point as int) as point, round(x0 + point * ((x1 - x0) / 99), 6) as oil,
    round(b + m * (x0 + point * ((x1 - x0) / 99)), 4) as trend
  from (select regr_slope(total_sales, oil_interpolated) as m,
      regr_intercept(total_sales, oil_interpolated) as b, min(oil_interpolated) as x0,
      max(oil_interpolated) as x1 from daily_oil where oil_interpolated is not null),
    (select unnest(range(100)) as point)""")


def _decomposition(v: Views) -> DataFrame:
    parts = seasonal_decompose(X.total_sales(v.train, "date"), "total_sales")
    return parts.select("date", *[F.round(c, 4).alias(c) for c in parts.columns if c != "date"])


_add("seasonal_decompose", _decomposition, """
  , s as (select date, total_sales as y, row_number() over (order by date) - 1 as t,
      case when count(*) over w = 365 then avg(total_sales) over w end as c from daily
    window w as (order by date rows between 182 preceding and 182 following)),
  e as (select min(t) as t0, max(t) as t1 from s where c is not null),
  f as (select regr_slope(c, t) as b, regr_intercept(c, t) as a from s, e
    where c is not null and t < t1 and t < t0 + 365),
  l as (select regr_slope(c, t) as b, regr_intercept(c, t) as a from s, e
    where c is not null and t < t1 and t >= t1 - 365),
  g as (select date, y, t, case when t < t0 then f.a + f.b * t when t > t1 then l.a + l.b * t
      else c end as trend from s, e, f, l),
  m as (select t % 365 as phase, avg(y - trend) as pm from g group by 1),
  r as (select date, y, trend, pm - (select avg(pm) from m) as seasonal
    from g join m on phase = t % 365)
  select date, round(y, 4) as observed, round(trend, 4) as trend, round(seasonal, 4) as seasonal,
    round(y - trend - seasonal, 4) as resid from r""")
