"""Seeded, partition-independent randomness from row keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(2**60)


def hash60(*parts: Column) -> Column:
    """Integer in [0, 2^60) from the text of the parts."""
    digest = F.md5(F.concat_ws("#", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_uniform(*parts: Column) -> Column:
    return hash60(*parts).cast("double") / F.lit(_SPAN)


def panel_key() -> Column:
    """Text key of one panel row."""
    return F.concat_ws("|", F.col("sku"), F.col("client"), F.date_format("month", "yyyy-MM-dd"))


def fold_of(key: Column, folds: int, seed: int) -> Column:
    """Fold number of a row key."""
    return F.pmod(hash60(key, F.lit(seed)), F.lit(folds)).cast("int")


# Cumulative probabilities of a Poisson(1) variable.
POISSON1_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892,
)


def poisson1(u: Column) -> Column:
    """Poisson(1) draw from a uniform number, by inversion."""
    draw = F.lit(0.0)
    for edge in POISSON1_CDF:
        draw = draw + (u >= F.lit(edge)).cast("double")
    return draw
