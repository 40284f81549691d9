"""Error metrics as aggregate expressions, for any grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metric_columns(y: str, yhat: str, in_log_scale: bool = True, digits: int = 4) -> list[Column]:
    """RMSE, MAE, MAPE (positive actuals only), RMSLE and WAPE, in percent where relative."""
    actual, predicted = F.col(y), F.col(yhat)
    if in_log_scale:
        actual, predicted = F.expm1(actual), F.expm1(predicted)
    predicted = F.greatest(predicted, F.lit(0.0))
    miss = F.abs(actual - predicted)
    log_miss = F.log1p(actual) - F.log1p(predicted)
    relative = F.when(actual > 0, miss / actual)
    total = F.sum(actual)
    metrics = {
        "rmse": F.sqrt(F.avg(miss * miss)),
        "mae": F.avg(miss),
        "mape": F.avg(relative) * 100,
        "rmsle": F.sqrt(F.avg(log_miss * log_miss)),
        "wape": F.when(total > 0, F.sum(miss) / total * 100),
    }
    return [F.round(c, digits).alias(name) for name, c in metrics.items()]


def mean_of_rounded(name: str) -> Column:
    """Mean, to four decimals, of values that were rounded to four decimals before.

    Counted in whole units, so neither the order of addition nor a binary
    fraction decides a tie.
    """
    units, n = f"sum(cast(round({name} * 10000) as bigint))", f"count({name})"
    return F.expr(f"((2 * {units} + {n}) div (2 * {n})) / 10000D")
