"""Calendar, lag and rolling features of the panel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..columns import DEFAULTS, SERIES_KEY

SEASON = ("m_sin", "m_cos", "is_high_season", "month_num", "quarter")
# Statistics of the rows before, and how many rows.
ROLLING = {"roll3_qty_mean": (F.avg, 3), "roll6_qty_mean": (F.avg, 6), "roll3_qty_std": (F.stddev_samp, 3)}


def lag_name(k: int) -> str:
    return f"lag_qty_{k}"


def controls_for(lags: tuple[int, ...]) -> tuple[str, ...]:
    """Names of the numeric controls that ``add_features`` makes with these lags."""
    return (*SEASON, *map(lag_name, lags), *ROLLING)



CONTROLS = controls_for(DEFAULTS.lags)


def log_quantity(qty: Column) -> Column:
    return F.log1p(F.greatest(qty, F.lit(0.0)))


def add_season(df: DataFrame) -> DataFrame:
    angle = F.lit(2.0 * math.pi) * F.month("month") / F.lit(12.0)
    return df.withColumns({
        "month_num": F.month("month"),
        "quarter": F.quarter("month"),
        "m_sin": F.sin(angle),
        "m_cos": F.cos(angle),
        "is_high_season": F.month("month").isin(*DEFAULTS.high_season).cast("int"),
    })


def add_features(panel: DataFrame, lags: tuple[int, ...] = DEFAULTS.lags) -> DataFrame:
    """Season parts, row lags, rolling statistics and the log target.

    One window per (sku, client) in month order: a series has one row per
    month, so its size is bounded by the calendar, not by the facts.
    """
    series = W.partitionBy(*SERIES_KEY).orderBy("month")
    zero = F.lit(0.0)
    columns = {lag_name(k): F.coalesce(F.lag("qty", k).over(series), zero) for k in lags}
    columns |= {name: F.coalesce(stat("qty").over(series.rowsBetween(-rows, -1)), zero)
                for name, (stat, rows) in ROLLING.items()}
    columns["y"] = log_quantity(F.col("qty"))
    return add_season(panel).withColumns(columns)
