"""Parameters of the library."""

from __future__ import annotations

from dataclasses import dataclass, field

# Results depend on them, so they are stated as they are.
SERIES = ["store_nbr", "family"]
PANEL_KEYS = ["date", "store_nbr", "family"]
TARGET = "sales"
HORIZONS = (7, 30)
LAGS = {7: [7, 14, 21, 28, 364], 30: [30, 60, 90, 364]}
ROLLING_WINDOWS = {7: [7, 14, 28], 30: [30, 60, 90]}
HOLIDAY_IMPACT = {
    "atypical": ["Terremoto"],
    "positive": [
        "Navidad",
        "Dia de la Madre",
        "Carnaval",
        "Dia del Trabajo",
        "Independencia de Cuenca",
        "Fundacion de Quito",
        "Mundial",
        "Dia de Difuntos",
    ],
    "negative": [
        "Primer dia del ano",
        "Traslado",
        "Black Friday",
        "Cyber Monday",
        "Puente",
        "Recupero",
    ],
}
CATEGORICAL = ["family", "city", "state", "type", "cluster", "holiday_type", "holiday_impact_type"]
NOT_FEATURES = ["date", "sales", "sales_raw", "id", "holiday_description", "transactions"]
METRICS = ["rmse", "mae", "mape", "rmsle", "wape"]
NO_HOLIDAY = "No_Holiday"
NO_EVENT_DAYS = 999
PAYDAY_DAYS = [14, 15, 28, 29, 30, 31]

# Family codes that weigh more in training. The full catalogue has 33 families,
# the test tables six.
TOP_FAMILIES = [3, 7, 12, 30]
TOP_FAMILIES_TEST_TABLES = [1, 3]


@dataclass(frozen=True)
class Settings:
    """Everything a run may change."""

    n_folds: int = 5
    val_weeks: int = 4
    test_weeks: int = 8
    lookback_days: int = 365
    weight: float = 5.0
    zero_share_core: float = 30.0
    zero_share_sporadic: float = 50.0
    seed: int = 42
    top_families: list[int] = field(default_factory=lambda: list(TOP_FAMILIES))


SETTINGS = Settings()
