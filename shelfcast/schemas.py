"""Schemas of the raw and derived tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_long, _double, _string = T.LongType(), T.DoubleType(), T.StringType()
_int, _date, _bool = T.IntegerType(), T.DateType(), T.BooleanType()

RAW = {
    "train": _struct(
        id=_long, date=_date, store_nbr=_long, family=_string, sales=_double, onpromotion=_long
    ),
    "test": _struct(id=_long, date=_date, store_nbr=_long, family=_string, onpromotion=_long),
    "stores": _struct(
        store_nbr=_long, city=_string, state=_string, type=_string, cluster=_long
    ),
    "oil": _struct(date=_date, dcoilwtico=_double),
    "holidays_events": _struct(
        date=_date,
        type=_string,
        locale=_string,
        locale_name=_string,
        description=_string,
        transferred=_bool,
    ),
    "transactions": _struct(date=_date, store_nbr=_long, transactions=_long),
}

TRAINING_TABLES = ["train", "test", "stores", "oil", "holidays_events", "transactions"]
PREDICTION_TABLES = ["stores", "oil", "holidays_events", "transactions"]

FORECAST = _struct(
    date=_date,
    store_nbr=_int,
    family=_int,
    predicted_sales=_double,
    lower_bound=_double,
    upper_bound=_double,
)
REQUESTS = _struct(store_nbr=_int, horizon=_int, family=_int)
