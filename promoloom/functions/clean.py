"""Cleaning expressions for values that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Day-first forms come before year-first ones, full years before two-digit ones.
DATE_FORMATS = ("d.M.yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "yyyy/M/d", "yyyy.M.d")
SHORT_YEAR_FORMATS = ("d.M.yy", "d/M/yy", "d-M-yy")
LAST_SHORT_YEAR = 2068


def text_to_number(text: Column) -> Column:
    """Number from text with plain spaces and a decimal comma; bad text is null."""
    plain = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    value = plain.try_cast("double")
    # A cast takes "1d" and "2f" for numbers; they are not.
    return F.when(~F.isnan(value) & ~F.rlike(plain, F.lit("[0-9.][dDfF]\\s*$")), value)


def text_to_date(text: Column) -> Column:
    """Date from day-first or year-first text, any time of day dropped; bad text is null.

    Two-digit years are 1969 to 2068.
    """
    day = F.split_part(F.split_part(F.trim(text), F.lit(" "), F.lit(1)), F.lit("T"), F.lit(1))
    short = F.coalesce(*[_parsed(day, fmt) for fmt in SHORT_YEAR_FORMATS])
    short = F.when(F.year(short) > LAST_SHORT_YEAR, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(*[_parsed(day, fmt) for fmt in DATE_FORMATS], short)


def _parsed(day: Column, fmt: str) -> Column:
    """``day`` as a date if it has the form; a failed parse raises inside, so it is tried only where separators and year are in place."""
    mark = f"[{fmt.strip('dMy')[0]}]"
    years = "[0-9]{4}" if "yyyy" in fmt else "[^0-9][0-9]{2}"
    form = f"^[+-]?{years}.*{mark}.*{mark}" if fmt.startswith("y") else f"{mark}.*{mark}.*{years}$" if "yyyy" in fmt else f"{mark}.*{mark}[0-9]{{2}}$"
    return F.when(F.rlike(day, F.lit(form)), F.try_to_date(day, fmt))


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def number(df: DataFrame, name: str) -> Column:
    """``name`` as a double, cleaned first when it is text."""
    if _is_text(df, name):
        return text_to_number(F.col(name))
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def unreadable_dates(df: DataFrame, name: str) -> DataFrame:
    """One row ``unreadable``: rows whose date text is given but can't be read, which the panel drops."""
    text = F.col(name).cast("string")
    return df.agg(F.count_if(text.isNotNull() & (F.trim(text) != "") & month(df, name).isNull()).alias("unreadable"))


def month(df: DataFrame, name: str) -> Column:
    """First day of the month of ``name`` as a date."""
    day = text_to_date(F.col(name)) if _is_text(df, name) else F.col(name).cast("date")
    return F.trunc(day, "MM")
