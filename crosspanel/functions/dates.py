"""Month arithmetic and mixed-format date parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_key(d: Column) -> Column:
    """Month period key: first day of the month as a date."""
    return F.trunc(d, "MM")


def month_end(d: Column, months: int = 0) -> Column:
    """Calendar month end, ``months`` away from the month of ``d``."""
    return F.last_day(F.add_months(F.trunc(d, "MM"), months))


def month_number(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def portfolio_year(d: Column) -> Column:
    """July-to-June year: the year of the month end six months earlier."""
    return F.year(F.add_months(F.trunc(d, "MM"), -6))


def portfolio_month(d: Column) -> Column:
    """Position within the July-to-June year (July = 1)."""
    return F.month(F.add_months(F.trunc(d, "MM"), -6))


def fiscal_june(datadate: Column) -> Column:
    """June 30 of the year after the fiscal year end's calendar year."""
    return F.make_date(F.year(datadate) + 1, F.lit(6), F.lit(30))


def warm_start(start: Column, months: int) -> Column:
    return F.add_months(start, -months)


def parse_mixed_date(c: Column) -> Column:
    """Parse ``YYYY-MM-DD``, ``yyyymmdd`` and ``yyyymm``; anything else is null.

    Accepts numbers read as text (``19760730.0`` or padded with blanks).
    """
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    digits = F.regexp_replace(text, "-", "")
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")),
        F.when(digits.rlike(r"^\d{8}$"), F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")),
        F.when(digits.rlike(r"^\d{6}$"), F.try_to_timestamp(F.concat(digits, F.lit("01")), F.lit("yyyyMMdd")).cast("date")),
    )
