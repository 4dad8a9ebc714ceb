"""Column names and default parameters.

Inside the library every table uses the short names of :data:`SALES` and
:data:`DISCOUNTS`; ``rename_source`` maps the headers found in the business
extracts onto them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Headers of the business extracts.
SALES_HEADERS = {
    "Головное СКЮ Артикул": "sku",
    "Головное СКЮ Наименование": "name",
    "Категория": "category",
    "Группа new": "grp",
    "Головное СКЮ ТИП": "type",
    "УПП__Группа клиентов": "client",
    "Дата": "date",
    "Кол_шт": "qty",
}
DISCOUNT_HEADERS = {
    "Головное СКЮ Артикул": "sku",
    "УПП__Группа клиентов": "client",
    "Дата начала недели": "week_start",
    "Год": "year",
    "Неделя": "week",
    "_промо план шт": "plan_qty",
    "_промо %скидки": "disc_pct",
}
# Positions of name, entry price and shelf price in the price
# list, and the header text that is repeated inside it.
PRICE_LIST_POSITIONS = (1, 57, 58)
PRICE_LIST_HEADER = "Наименование"

DESCRIPTORS = ("type", "category", "grp", "name")
SERIES_KEY = ("sku", "client")
PANEL_KEY = ("sku", "client", "month")

# Fills for missing labels.
UNKNOWN_CATEGORY = "unknown"
NO_GROUP = "—"


@dataclass(frozen=True)
class Settings:
    """Defaults of every tunable; pass a changed copy to override."""

    k: int = 10
    pool: int = 120
    embedding_dims: int = 16
    grid: tuple[int, ...] = (0, 5, 10, 15, 20, 25, 30)
    curve_grid: tuple[int, ...] = (0, 5, 10, 15, 20, 25, 30, 35, 40)
    hinge_knots: tuple[int, ...] = (10, 20)
    inverse_targets: tuple[int, ...] = (10, 20, 30, 50)
    folds: int = 5
    seed: int = 42
    test_months: int = 3
    cost_share: float = 0.6
    slots: int = 200
    kmax: int = 3
    robust: bool = False
    boot_reps: int = 200
    within_reps: int = 300
    min_rows: int = 400
    min_treated: int = 60
    price_bounds: tuple[float, float] = (100.0, 15000.0)
    high_season: tuple[int, ...] = (11, 12, 1, 2)
    lags: tuple[int, ...] = (1, 2, 3, 6, 12)


DEFAULTS = Settings()


def rename_source(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Keep the known headers that are present and give them short names."""
    present = [c for c in df.columns if c in headers]
    return df.select(*[df[f"`{c}`"].alias(headers[c]) for c in present])
