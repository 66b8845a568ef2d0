"""Dates: keys, parsing, seasons, year fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months of snow and of leaves in the northern hemisphere; days in a year.
SNOW_MONTHS = (11, 12, 1, 2, 3)
LEAF_ON_MONTHS = (5, 6, 7, 8, 9)
YEAR_DAYS = 365.25


def date_key(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


def pair_key(reference: Column, secondary: Column) -> Column:
    """The two dates, yyyymmdd, earlier first, with an underscore between."""
    return F.concat_ws("_", date_key(F.least(reference, secondary)), date_key(F.greatest(reference, secondary)))


def split_pair_key(key: Column) -> Column:
    """Struct (reference, secondary) of a pair key; null dates where it isn't one."""
    parts = F.split(key, "_")
    get = lambda k: F.try_to_date(F.get(parts, F.lit(k)), "yyyyMMdd")
    return F.struct(get(0).alias("reference"), get(1).alias("secondary"))


def parse_date(text: Column) -> Column:
    """yyyy-mm-dd or yyyymmdd; null for anything else."""
    text = F.trim(text)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(iso, F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")))


def season(d: Column, northern: bool | Column = True) -> Column:
    """``snow``, ``leaf_on`` or ``transition``; the south is shifted by six months."""
    month = F.month(d)
    south = F.pmod(month + 5, F.lit(12)) + 1
    month = (month if northern else south) if isinstance(northern, bool) else F.when(northern, month).otherwise(south)
    return F.when(month.isin(*SNOW_MONTHS), "snow").when(month.isin(*LEAF_ON_MONTHS), "leaf_on").otherwise("transition")


def crosses_season(a: Column, b: Column, northern: bool | Column = True) -> Column:
    x, y = season(a, northern), season(b, northern)
    return ((x == "snow") & (y == "leaf_on")) | ((x == "leaf_on") & (y == "snow"))


def year_fraction(d: Column, origin: Column) -> Column:
    return F.datediff(d, origin) / YEAR_DAYS


def regular_dates(start: str, n: int, every: int) -> Column:
    """Array of ``n`` dates, ``every`` days apart."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.date_add(F.to_date(F.lit(start)), (k * every).cast("int")))
