"""Month arithmetic on date columns. The grain everywhere is the first day of a month."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(col: Column) -> Column:
    """First day of the month a date or timestamp falls in."""
    return F.trunc(F.to_date(col), "MM")


def month_number(col: Column) -> Column:
    """Months since year 0, so that differences are distances in months."""
    return F.year(col).cast("bigint") * 12 + F.month(col) - 1


def month_from_number(number: Column) -> Column:
    return F.make_date((number / 12).cast("int"), (F.pmod(number, F.lit(12)) + 1).cast("int"), F.lit(1))


def shift_months(col: Column, months: Column | int) -> Column:
    return F.add_months(col, months)


def days_in_month(col: Column) -> Column:
    return F.dayofmonth(F.last_day(col))


def month_label(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def parse_month(text: Column) -> Column:
    """``YYYY-MM`` text to the first day of that month; anything else is null."""
    year = F.regexp_extract(F.trim(text), r"^(\d{4})-(\d{1,2})$", 1)
    month = F.regexp_extract(F.trim(text), r"^(\d{4})-(\d{1,2})$", 2)
    return F.when(
        month.try_cast("int").between(1, 12) & year.try_cast("int").between(1, 9999),
        F.make_date(year.try_cast("int"), month.try_cast("int"), F.lit(1)),
    )


def season_sin(col: Column) -> Column:
    return F.sin(F.month(col) * (2.0 * math.pi) / 12.0)


def season_cos(col: Column) -> Column:
    return F.cos(F.month(col) * (2.0 * math.pi) / 12.0)


def require_month(text: str) -> dt.date:
    """The same parse for an API argument: an error instead of null."""
    pieces = (text or "").strip().split("-")
    if len(pieces) != 2 or not all(p.isdigit() for p in pieces):
        raise ValueError("date must be YYYY-MM")
    if not 1 <= int(pieces[1]) <= 12:
        raise ValueError("month must be 1..12")
    return dt.date(int(pieces[0]), int(pieces[1]), 1)
