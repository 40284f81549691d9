"""SQL over the warehouse tables that states the result of each query."""

from __future__ import annotations

from shelfcast.config import HOLIDAY_IMPACT, LAGS, ROLLING_WINDOWS
from shelfcast.sources.retail import HOLIDAY_RULES

SER = "partition by store_nbr, family order by date"
LOOKBACK = """(select min(date) from (
  select distinct date from processed order by date desc limit 366))"""


def _rules() -> str:
    def literal(v):
        return str(v).lower() if isinstance(v, bool | int) else "'" + v + "'"

    return ",\n ".join("(" + ", ".join(map(literal, r)) + ")" for r in HOLIDAY_RULES)


def _impact(description: str) -> str:
    text = f"lower({description})"
    cases = [f"when {description} = 'No_Holiday' then 'none'"]
    for group in ("atypical", "positive", "negative"):
        hits = " or ".join(f"contains({text}, '{w.lower()}')" for w in HOLIDAY_IMPACT[group])
        cases.append(f"when {hits} then '{group}'")
    return "case " + " ".join(cases) + " else 'neutral' end"


def _first_holiday(locale: str, place: str | None) -> str:
    key = f", locale_name as {place}" if place else ""
    part = "date, locale_name" if place else "date"
    return f"""select date{key}, type as holiday_type, description as holiday_description,
      locale as holiday_locale, transferred
    from fx_holidays where locale = '{locale}' {"and locale_name is not null" if place else ""}
    qualify row_number() over (partition by {part} order by transferred, type, description) = 1"""


def _interpolated(source: str, edges: bool = True) -> str:
    """Dates with a price, filled on the line between the known neighbours."""
    tail = ", vr" if edges else ""
    return f"""select date, coalesce(v, case when pl is not null and pr is not null
        then vl + (vr - vl) * (p - pl) / (pr - pl) end, vl{tail}) as dcoilwtico
      from (select date, p, v,
        last_value(case when v is not null then p end ignore nulls) over b as pl,
        last_value(v ignore nulls) over b as vl,
        first_value(case when v is not null then p end ignore nulls) over a as pr,
        first_value(v ignore nulls) over a as vr
      from (select date, dcoilwtico as v, row_number() over (order by date) as p from ({source}))
      window b as (order by date rows between unbounded preceding and current row),
             a as (order by date rows between current row and unbounded following))"""


def _merged(panel: str, oil: str) -> str:
    return f"""select t.*, s.city, s.state, s.type, s.cluster, o.dcoilwtico, x.transactions,
      coalesce(l.holiday_type, r.holiday_type, n.holiday_type) as holiday_type,
      coalesce(l.holiday_description, r.holiday_description, n.holiday_description)
        as holiday_description,
      coalesce(l.holiday_locale, r.holiday_locale, n.holiday_locale) as holiday_locale,
      coalesce(l.transferred, r.transferred, n.transferred) as transferred
    from {panel} t left join fx_stores s on t.store_nbr = s.store_nbr
    left join {oil} o on t.date = o.date
    left join fx_transactions x on t.date = x.date and t.store_nbr = x.store_nbr
    left join h_nat n on t.date = n.date
    left join h_reg r on t.date = r.date and s.state = r.state
    left join h_loc l on t.date = l.date and s.city = l.city"""


_IMPUTED = """coalesce(transactions, 0) as transactions,
  coalesce(holiday_type, 'No_Holiday') as holiday_type,
  coalesce(holiday_description, 'No_Holiday') as holiday_description,
  coalesce(transferred, false) as transferred"""

CALENDAR = """cast(isodow(date) - 1 as int) as dia_semana,
  cast(isodow(date) in (6, 7) as int) as es_fin_de_semana,
  cast(weekofyear(date) as int) as semana_del_año,
  cast((day(date) - 1) // 7 + 1 as int) as semana_del_mes,
  cast(quarter(date) as int) as trimestre,
  cast(day(last_day(date)) - day(date) as int) as dias_para_fin_de_mes,
  cast(day(date) in (14, 15, 28, 29, 30, 31) as int) as es_quincena,
  cast(day(date) <= 3 as int) as es_inicio_mes,
  sin((isodow(date) - 1) * (2 * pi() / 7)) as day_sin,
  cos((isodow(date) - 1) * (2 * pi() / 7)) as day_cos,
  cast(isodow(date) in (6, 7) and day(date) in (14, 15, 28, 29, 30, 31) as int)
    as pico_quincena_findex,
  cast(isodow(date) = 5 as int) as es_viernes"""


def _distance(days: str) -> str:
    """Days to the next and since the last holiday for a table of (date, es_festivo)."""
    return f"""select date,
      cast(coalesce(min(h) over (order by date rows between current row and unbounded following)
        - date, 999) as int) as dias_para_siguiente_festivo,
      cast(coalesce(date - max(h) over (order by date
        rows between unbounded preceding and current row), 999) as int)
        as dias_desde_ultimo_festivo
    from (select date, case when es_festivo = 1 then date end as h from {days})"""


def _frame(shift: int, width: int) -> str:
    return f"rows between {shift + width - 1} preceding and {shift} preceding"


def _lags(value: str, lags: list[int], prefix: str, over: str = SER) -> str:
    return ", ".join(f"lag({value}, {k}) over ({over}) as {prefix}{k}" for k in lags)


def _rolling(h: int) -> str:
    parts = []
    for w in ROLLING_WINDOWS[h]:
        over = f"over ({SER} {_frame(h, w)})"
        parts += [
            f"avg(sales) {over} as rolling_mean_{w}d",
            f"stddev_samp(sales) {over} as rolling_std_{w}d",
            f"max(sales) {over} as rolling_max_{w}d",
        ]
    return ", ".join(parts)


def _promo(h: int) -> str:
    return f"""cast(coalesce(onpromotion > 0, false) as int) as tiene_promo,
      lag(onpromotion, {h}) over ({SER}) as promo_lag_{h},
      avg(onpromotion) over ({SER} {_frame(h, 2 * h)}) as rolling_promo_mean_{2 * h}"""


def _oil(h: int, over: str) -> str:
    means = ", ".join(
        f"avg(dcoilwtico) over ({over} {_frame(h, w)}) as oil_rolling_mean_{w}"
        for w in ROLLING_WINDOWS[h]
    )
    return _lags("dcoilwtico", LAGS[h], "oil_lag_", over) + ", " + means


def _trans(h: int, over: str = SER) -> str:
    return f"""lag(transactions, {h}) over ({over}) as trans_lag_{h},
      avg(transactions) over ({over} {_frame(h, h)}) as trans_rolling_mean_{h}"""


def metrics(y: str = "sales", p: str = "y_pred", log: bool = True) -> str:
    if log:
        y, p = f"(exp({y}) - 1)", f"(exp({p}) - 1)"
    p = f"greatest({p}, 0.0)"
    return f"""round(sqrt(avg(({y} - {p}) * ({y} - {p}))), 4) as rmse,
      round(avg(abs({y} - {p})), 4) as mae,
      round(avg(case when {y} > 0 then abs({y} - {p}) / {y} end) * 100, 4) as mape,
      round(sqrt(avg((ln(1 + {y}) - ln(1 + {p})) * (ln(1 + {y}) - ln(1 + {p})))), 4) as rmsle,
      round(case when sum({y}) > 0 then sum(abs({y} - {p})) / sum({y}) * 100 end, 4) as wape"""


def mean_of_rounded(m: str) -> str:
    units = f"cast(sum(cast(round({m} * 10000) as bigint)) as bigint)"
    return f"((2 * {units} + count({m})) // (2 * count({m}))) / 10000.0::double"


def feature_columns(h: int) -> dict[str, int | None]:
    """Numeric columns of a feature table with their digits (None: exact)."""
    wide = ROLLING_WINDOWS[h]
    exact = """dia_semana es_fin_de_semana semana_del_año semana_del_mes trimestre
      dias_para_fin_de_mes es_quincena es_inicio_mes pico_quincena_findex es_viernes es_festivo
      dias_para_siguiente_festivo dias_desde_ultimo_festivo tiene_promo onpromotion
      ranking_tienda city state type cluster holiday_type holiday_locale holiday_impact_type
      transferred""".split() + [f"promo_lag_{h}", f"trans_lag_{h}"]
    close = ["sales", "sales_raw", "day_sin", "day_cos", "dcoilwtico", "cv_ventas"]
    close += ["venta_media_historica", "venta_std_historica"]
    close += [f"lag_{k}" for k in LAGS[h]] + [f"oil_lag_{k}" for k in LAGS[h]]
    close += [f"rolling_{f}_{w}d" for w in wide for f in ("mean", "std", "max")]
    close += [f"oil_rolling_mean_{w}" for w in wide]
    close += [f"rolling_promo_mean_{2 * h}", f"trans_rolling_mean_{h}"]
    return {**dict.fromkeys(exact), **dict.fromkeys(close, 6)}


def _flagged(source: str) -> str:
    return f"""select *, {CALENDAR}, cast(holiday_type <> 'No_Holiday' as int) as es_festivo,
      {_impact("holiday_description")} as holiday_impact_type from {source}"""


def _day_features(h: int, flagged: str) -> str:
    return f"""select d.date, {_oil(h, "order by d.date")}, dias_para_siguiente_festivo,
        dias_desde_ultimo_festivo
      from (select date, max(dcoilwtico) as dcoilwtico from {flagged} group by date) d
      join ({_distance(f"(select date, max(es_festivo) as es_festivo from {flagged} group by date)")})
        x on d.date = x.date"""


def _coded(h: int, windowed: str, days: str) -> str:
    """Feature rows with codes, from the windowed rows and the dictionaries of the whole panel."""
    columns = "family city state type cluster holiday_type holiday_impact_type holiday_locale".split()
    joins = " ".join(
        f"left join codes c{i} on c{i}.column_name = '{c}' and c{i}.value = cast(w.{c} as varchar)"
        for i, c in enumerate(columns)
    )
    codes = ", ".join(f"coalesce(c{i}.code, -1) as {c}" for i, c in enumerate(columns))
    wide = ROLLING_WINDOWS[h][-1]
    lags = [f"lag_{k}" for k in LAGS[h]] + [f"oil_lag_{k}" for k in LAGS[h]]
    lags += [f"promo_lag_{h}", f"trans_lag_{h}"]
    return f"""select w.* exclude ({", ".join(columns)}, transferred), {codes},
        cast(w.transferred as int) as transferred,
        rolling_std_{wide}d / (rolling_mean_{wide}d + 1e-6) as cv_ventas, r.ranking_tienda,
        d.* exclude (date)
      from {windowed} w left join ranking r on r.store_nbr = w.store_nbr
      join {days} d on d.date = w.date {joins}
      where {" and ".join(f"{c} is not null" for c in lags)}"""


_OWN = """, avg(sales) over (partition by store_nbr, family) as venta_media_historica,
      stddev_samp(sales) over (partition by store_nbr, family) as venta_std_historica"""


def row_grain(h: int, rows: str) -> dict[str, str]:
    """Steps to the feature table whose oil and transaction columns count rows of a store."""
    days = _distance("(select date, max(es_festivo) as es_festivo from flagged group by date)")
    return {
        "row_days": days,
        f"row_windowed_{h}": f"""select *, {_lags("sales", LAGS[h], "lag_")}, {_rolling(h)}, {_promo(h)},
          {_trans(h, rows)}, {_oil(h, rows)} {_OWN} from flagged""",
        f"row_features_{h}": _coded(h, f"row_windowed_{h}", "row_days"),
    }


def _windowed(h: int, source: str, stats: bool) -> str:
    return f"""select *, {_lags("sales", LAGS[h], "lag_")}, {_rolling(h)}, {_promo(h)}, {_trans(h)}
      {_OWN if stats else ""} from {source}"""


def _future(h: int) -> dict[str, str]:
    last = "(select max(date) from processed)"
    return {
        "hist": f"select * from processed where date >= {LOOKBACK}",
        "grid": f"""select date, store_nbr, family, 0.0 as sales
          from (select distinct store_nbr, family from hist)
          cross join (select cast(unnest(generate_series({last} + 1, {last} + {h},
            interval 1 day)) as date) as date)""",
        "future": _merged("grid", "fx_oil"),
        "joined_raw": f"""select * exclude (dcoilwtico) from hist union all by name
          select * exclude (dcoilwtico, transactions, holiday_type, holiday_description, transferred),
            0 as onpromotion, {_IMPUTED} from future""",
        "joined_oil": _interpolated(
            """select date, max(dcoilwtico) as dcoilwtico from
            (select date, dcoilwtico from hist union all select date, dcoilwtico from future)
            group by date"""
        ),
        "joined": "select b.*, o.dcoilwtico from joined_raw b join joined_oil o on b.date = o.date",
        "f_flagged": _flagged("joined"),
        f"f_days_{h}": _day_features(h, "f_flagged"),
        f"f_windowed_{h}": f"""select w.*, s.venta_media_historica, s.venta_std_historica
          from ({_windowed(h, "f_flagged", False)}) w join stats s
          on s.store_nbr = w.store_nbr and s.family = w.family""",
        f"pred_input_{h}": f"""select * from ({_coded(h, f"f_windowed_{h}", f"f_days_{h}")})
          where date > {last}""",
        f"naive_forecast_{h}": f"""select date, p.store_nbr, p.family, predicted_sales,
            round(greatest(predicted_sales - 1.96 * std_sales, 0.0), 2) as lower_bound,
            round(predicted_sales + 1.96 * std_sales * 1.5, 2) as upper_bound
          from (select date, store_nbr, family,
              round(greatest(exp(lag_{h}) - 1, 0.0), 2) as predicted_sales from pred_input_{h}) p
          left join (select store_nbr, code as family, exp(stddev_samp(sales)) - 1 as std_sales
            from processed join codes on column_name = 'family' and value = family
            group by store_nbr, code) s
          on s.store_nbr = p.store_nbr and s.family = p.family""",
    }


CODED = "family city state type cluster holiday_type holiday_impact_type holiday_locale".split()

# Named steps in the order they may build on each other.
STEPS: dict[str, str] = {
    "fx_line": """select cast(l_shipdate as date) as date,
        cast(s_nationkey + 1 as int) as store_nbr, p_type as family, l_quantity, l_discount,
        l_orderkey
      from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey""",
    "fx_train": """select d.date, s.store_nbr, s.family, coalesce(a.sales, 0.0) as sales,
        cast(coalesce(a.onpromotion, 0) as int) as onpromotion
      from (select distinct date from fx_line) d
      cross join (select distinct store_nbr, family from fx_line) s
      left join (select date, store_nbr, family, sum(l_quantity) as sales,
          sum(case when l_discount >= 0.08 then 1 else 0 end) as onpromotion
        from fx_line group by date, store_nbr, family) a
      on a.date = d.date and a.store_nbr = s.store_nbr and a.family = s.family""",
    "fx_stores": """select cast(n_nationkey + 1 as int) as store_nbr, n_name as city,
        r_name as state, case n_nationkey % 5 when 0 then 'A' when 1 then 'B' when 2 then 'C'
          when 3 then 'D' else 'E' end as type,
        cast((n_nationkey * 7) % 17 + 1 as int) as cluster
      from nation join region on n_regionkey = r_regionkey""",
    "fx_transactions": """select date, store_nbr,
        cast(count(distinct l_orderkey) as int) as transactions
      from fx_line group by date, store_nbr""",
    "fx_oil": """select date, case when min_cust % 11 = 0 then null else px end as dcoilwtico
      from (select cast(o_orderdate as date) as date, min(o_custkey) as min_cust,
          round(avg(o_totalprice) / 1000, 2) as px
        from orders group by cast(o_orderdate as date)) where isodow(date) < 6""",
    "fx_holidays": f"""select make_date(y, m, d) as date, type, locale, locale_name, description,
        transferred
      from (select distinct year(date) as y from fx_line) cross join (values
       {_rules()}) t(m, d, type, locale, locale_name, description, transferred)""",
    "fx_test": """select date, store_nbr, family, onpromotion from fx_train where date >= (
        select min(date) from (select distinct date from fx_train order by date desc limit 16))""",
    "h_nat": _first_holiday("National", None),
    "h_reg": _first_holiday("Regional", "state"),
    "h_loc": _first_holiday("Local", "city"),
    "merged": _merged("fx_train", "fx_oil"),
    "with_locale": """select m.*, n.holiday_locale as locale from merged m
      left join h_nat n on m.date = n.date""",
    "oil_days": """select d.date, o.dcoilwtico
      from (select distinct date from fx_train) d left join fx_oil o on d.date = o.date""",
    "oil_day": _interpolated("select * from oil_days"),
    "processed": f"""select * exclude (sales, transactions, holiday_type, holiday_description,
        transferred), ln(1 + sales) as sales, sales as sales_raw, {_IMPUTED}
      from ({_merged("fx_train", "oil_day")})""",
    "flagged": _flagged("processed"),
    "codes": " union all ".join(
        f"""select '{c}' as column_name, cast(v as varchar) as value,
          cast(row_number() over (order by v) - 1 as int) as code
        from (select distinct {c} as v from flagged where {c} is not null)"""
        for c in CODED
    ),
    "ranking": """select store_nbr, cast(floor(rank() over (order by total desc)
        + (count(*) over (partition by total) - 1) / 2.0) as int) as ranking_tienda
      from (select store_nbr, round(sum(sales), 6) as total from processed group by store_nbr)""",
    "stats": """select store_nbr, family, avg(sales) as venta_media_historica,
        stddev_samp(sales) as venta_std_historica from processed group by store_nbr, family""",
    **{
        name: text
        for h in (7, 30)
        for name, text in {
            f"days_{h}": _day_features(h, "flagged"),
            f"windowed_{h}": _windowed(h, "flagged", True),
            f"features_{h}": _coded(h, f"windowed_{h}", f"days_{h}"),
        }.items()
    },
    "naive": f"""select * from (select *, lag(sales, 7) over ({SER}) as y_pred from processed)
      where y_pred is not null""",
    "naive_year": f"""select * from (select *, lag(sales, 7) over ({SER}) as y_pred,
        lag(sales, 364) over ({SER}) as y_year from processed)
      where y_pred is not null and y_year is not null""",
    "day_pos_naive": """select date, row_number() over (order by date) - 1 as pos, count(*) over () as n
      from (select distinct date from naive)""",
    "fold_days_naive": """select *, cast(5 - b as int) as fold from (
        select *, (n - 57 - pos) // 28 as b from day_pos_naive where pos < n - 56)
      where b < 5 and n - 56 - (b + 1) * 28 > 0""",
    "day_pos": """select date, n_rows, row_number() over (order by date) - 1 as pos,
        count(*) over () as n, lag(date) over (order by date) as date_before,
        min(date) over () as first_date,
        sum(n_rows) over (order by date rows between unbounded preceding and 1 preceding)
          as rows_before
      from (select date, count(*) as n_rows from features_7 group by date)""",
    "fold_days": """select *, cast(5 - b as int) as fold from (
        select *, (n - 57 - pos) // 28 as b from day_pos where pos < n - 56)
      where b < 5 and n - 56 - (b + 1) * 28 > 0""",
    "folds": """select fold, min(first_date) as train_start, min(date_before) as train_end,
        min(date) as val_start, max(date) as val_end,
        cast(min(rows_before) as bigint) as n_train, cast(sum(n_rows) as bigint) as n_val
      from fold_days group by fold""",
    "fold_metrics": f"""select fold, {metrics()}, count(*) as n_rows
      from naive join (select date, fold from fold_days_naive) using (date) group by fold""",
    "holdout": "select * from naive where date > (select max(date) from processed) - 56",
    "holdout_year": "select * from naive_year where date > (select max(date) from processed) - 56",
    "family_metrics": f"select family, {metrics()}, count(*) as n_rows from holdout group by family",
    "store_metrics": f"""select store_nbr, {metrics()}, min(city) as city, count(*) as n_rows
      from holdout group by store_nbr""",
    "date_metrics": """select date, round(avg(e), 6) as mae_diario,
        round(stddev_samp(e), 6) as std_diario
      from (select date, abs((exp(sales) - 1) - (exp(y_pred) - 1)) as e from holdout)
      group by date""",
    "daily": "select date, sum(sales) as total_sales from fx_train group by date",
    "daily_distance": f"""select d.date, d.total_sales, x.dias_para_siguiente_festivo,
        x.dias_desde_ultimo_festivo from daily d join ({_distance(
        "(select date, max(cast(holiday_type is not null as int)) as es_festivo "
        "from merged group by date)")}) x on x.date = d.date""",
    "daily_oil": f"""select d.date, d.total_sales, o.dcoilwtico, i.dcoilwtico as oil_interpolated
      from daily d left join fx_oil o on o.date = d.date
      left join ({_interpolated("select * from oil_days", False)}) i on i.date = d.date""",
    "store_day": """select date, store_nbr, sum(sales) as total_sales,
        max(transactions) as transactions from merged group by date, store_nbr
      having max(transactions) is not null""",
}


def _words(text: str) -> set[str]:
    return set("".join(ch if ch.isalnum() or ch == "_" else " " for ch in text).split())


def with_steps(query: str, extra: dict[str, str] | None = None) -> str:
    """The query behind the named steps it uses, directly or through others."""
    steps = {**STEPS, **(extra or {})}
    needed, todo = set(), [query]
    while todo:
        for name in _words(todo.pop()) & steps.keys() - needed:
            needed.add(name)
            todo.append(steps[name])
    ordered = [f"{name} as materialized ({text})" for name, text in steps.items() if name in needed]
    return ("with " + ",\n".join(ordered) + "\n" if ordered else "") + query
