"""Calendar Column helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import col, flag


def calendar_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Parts, cyclic encodings and day-threshold period flags.

    ``dayofweek`` is Monday = 0 (Spark ``weekday``), ``week`` is ISO.
    Month start/end use day thresholds (<= 3, >= 28), not exact calendar
    boundaries (that is C2).
    """
    d = F.col(date_col)
    month, dow, doy, day = F.month(d), F.weekday(d), F.dayofyear(d), F.dayofmonth(d)
    two_pi = 2 * math.pi
    return df.select(
        "*",
        F.year(d).alias("year"), month.alias("month"), day.alias("day"),
        dow.alias("dayofweek"), doy.alias("dayofyear"), F.weekofyear(d).alias("week"),
        F.quarter(d).alias("quarter"),
        F.sin(two_pi * month / 12).alias("month_sin"), F.cos(two_pi * month / 12).alias("month_cos"),
        F.sin(two_pi * dow / 7).alias("dayofweek_sin"), F.cos(two_pi * dow / 7).alias("dayofweek_cos"),
        F.sin(two_pi * doy / 365).alias("dayofyear_sin"), F.cos(two_pi * doy / 365).alias("dayofyear_cos"),
        flag(dow < 5).alias("is_weekday"), flag(dow >= 5).alias("is_weekend"),
        flag(day <= 3).alias("is_month_start"), flag(day >= 28).alias("is_month_end"),
        flag(month.isin(1, 4, 7, 10) & (day <= 3)).alias("is_quarter_start"),
        flag(month.isin(3, 6, 9, 12) & (day >= 28)).alias("is_quarter_end"),
        flag((month == 1) & (day <= 3)).alias("is_year_start"),
        flag((month == 12) & (day >= 28)).alias("is_year_end"),
        flag(month == 1).alias("is_january"), flag(month == 12).alias("is_december"),
        flag(month.isin(3, 4)).alias("is_tax_season"),
    )


def date_features(df: DataFrame, date_col: str) -> DataFrame:
    """Prefixed parts, exact period boundary booleans, cyclic month/day."""
    d = F.col(date_col).cast("date")
    p = date_col
    month, dow = F.month(d), F.weekday(d)
    two_pi = 2 * math.pi
    q_start = F.trunc(d, "quarter")
    return df.select(
        "*",
        F.year(d).alias(f"{p}_year"), month.alias(f"{p}_month"), F.dayofmonth(d).alias(f"{p}_day"),
        dow.alias(f"{p}_dayofweek"), F.dayofyear(d).alias(f"{p}_dayofyear"),
        F.weekofyear(d).alias(f"{p}_week"), F.quarter(d).alias(f"{p}_quarter"),
        (dow >= 5).alias(f"{p}_is_weekend"),
        (F.dayofmonth(d) == 1).alias(f"{p}_is_month_start"),
        (F.last_day(d) == d).alias(f"{p}_is_month_end"),
        (q_start == d).alias(f"{p}_is_quarter_start"),
        (F.date_add(F.add_months(q_start, 3), -1) == d).alias(f"{p}_is_quarter_end"),
        ((month == 1) & (F.dayofmonth(d) == 1)).alias(f"{p}_is_year_start"),
        ((month == 12) & (F.dayofmonth(d) == 31)).alias(f"{p}_is_year_end"),
        F.sin(two_pi * month / 12).alias(f"{p}_month_sin"),
        F.cos(two_pi * month / 12).alias(f"{p}_month_cos"),
        F.sin(two_pi * dow / 7).alias(f"{p}_dayofweek_sin"),
        F.cos(two_pi * dow / 7).alias(f"{p}_dayofweek_cos"),
    )


def flow_date_flags(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Exact month/quarter/year end and weekend flags plus parts."""
    d = F.col(date_col)
    q_end = F.date_add(F.add_months(F.trunc(d, "quarter"), 3), -1)
    return df.select(
        "*",
        flag(F.last_day(d) == d).alias("is_month_end"),
        flag(q_end == d).alias("is_quarter_end"),
        flag((F.month(d) == 12) & (F.dayofmonth(d) == 31)).alias("is_year_end"),
        flag(F.weekday(d) >= 5).alias("is_weekend"),
        F.month(d).alias("MONTH"), F.quarter(d).alias("QUARTER"),
        F.weekday(d).alias("DAY_OF_WEEK"), F.weekofyear(d).alias("WEEK_OF_YEAR"),
    )


def account_age(df: DataFrame, opening_col: str, as_of: str) -> DataFrame:
    """C4: account age in days and years (days/365.25), new (< 1y), mature (> 5y)."""
    days = F.datediff(F.lit(as_of).cast("date"), F.col(opening_col).cast("date"))
    years = days / 365.25
    return df.select("*", days.alias("account_age_days"), years.alias("account_age_years"),
                     flag(years < 1).alias("is_new_account"), flag(years > 5).alias("is_mature_account"))


def parse_date(x, fmt: str | None = None) -> Column:
    """Coercing date parse (bad text -> NULL)."""
    if fmt:
        return F.try_to_timestamp(col(x), F.lit(fmt)).cast("date")
    return F.try_to_timestamp(col(x)).cast("date")


def matches_date_format(x, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(col(x), F.lit(fmt)).isNotNull()
