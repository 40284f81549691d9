"""Calendar and holiday expressions over a date and a description."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfcast.config import HOLIDAY_IMPACT, NO_HOLIDAY, PAYDAY_DAYS


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def calendar_columns(date: str = "date") -> dict[str, Column]:
    d = F.col(date)
    weekday, day = F.weekday(d), F.dayofmonth(d)
    angle = weekday * (2 * math.pi / 7)
    weekend, payday = weekday.isin(5, 6), day.isin(PAYDAY_DAYS)
    return {
        "dia_semana": weekday,
        "es_fin_de_semana": flag(weekend),
        "semana_del_año": F.weekofyear(d),
        "semana_del_mes": (F.floor((day - 1) / 7) + 1).cast("int"),
        "trimestre": F.quarter(d),
        "dias_para_fin_de_mes": F.dayofmonth(F.last_day(d)) - day,
        "es_quincena": flag(payday),
        "es_inicio_mes": flag(day <= 3),
        "day_sin": F.sin(angle),
        "day_cos": F.cos(angle),
        "pico_quincena_findex": flag(weekend & payday),
        "es_viernes": flag(weekday == 4),
    }


def impact_type(description: str) -> Column:
    """Impact group of a holiday by the first list that names it."""
    text = F.lower(F.col(description))
    result = F.when(F.col(description) == NO_HOLIDAY, "none")
    for group in ("atypical", "positive", "negative"):
        hits = [text.contains(word.lower()) for word in HOLIDAY_IMPACT[group]]
        result = result.when(reduce(or_, hits), group)
    return result.otherwise("neutral")
