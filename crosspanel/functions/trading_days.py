"""Last exchange trading day of each month from a holiday rule set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Full-day closures outside the holiday rules.
AD_HOC_CLOSURES = (
    "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11",
    "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05",
)


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous computus in its 1961 form."""
    a = year % 19
    b, c = F.floor(year / 100), year % 100
    d, e = F.floor(b / 4), b % 4
    g = F.floor((8 * b + 13) / 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = F.floor(c / 4), c % 4
    el = (32 + 2 * e + 2 * i - h - k) % 7
    m = F.floor((a + 11 * h + 19 * el) / 433)
    n = h + el - 7 * m
    month = F.floor((n + 90) / 25)
    day = (n + 33 * month + 19) % 32
    return F.make_date(year, month.cast("int"), day.cast("int"))


def _on(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def _nearest_workday(d: Column) -> Column:
    dow = F.dayofweek(d)
    return F.when(dow == 7, F.date_sub(d, 1)).when(dow == 1, F.date_add(d, 1)).otherwise(d)


def _nth(year: Column, month: int, weekday: str, n: int) -> Column:
    before = F.date_sub(_on(year, month, 1), 1)
    return F.date_add(F.next_day(before, weekday), 7 * (n - 1))


def holidays_of(year: Column) -> Column:
    """Array of the closure dates of a year under the current rule set."""
    new_year = _on(year, 1, 1)
    rules = [
        F.when(F.dayofweek(new_year) == 1, F.date_add(new_year, 1)).otherwise(new_year),
        F.when(year >= 1998, _nth(year, 1, "Mon", 3)),
        _nth(year, 2, "Mon", 3),
        F.date_sub(easter_sunday(year), 2),
        F.next_day(_on(year, 5, 24), "Mon"),
        F.when(year >= 2021, _nearest_workday(_on(year, 6, 19))),
        _nearest_workday(_on(year, 7, 4)),
        _nth(year, 9, "Mon", 1),
        _nth(year, 11, "Thu", 4),
        _nearest_workday(_on(year, 12, 25)),
    ]
    return F.array_compact(F.array(*rules))


def last_trading_days(months: DataFrame, ym: str = "ym") -> DataFrame:
    """(ym, last_trading_day); falls back to the month end without trading days."""
    closures = F.array(*[F.lit(d).cast("date") for d in AD_HOC_CLOSURES])
    d = months.select(ym, F.last_day(ym).alias("_end")).withColumn("_y", F.year(ym))
    # A Saturday New Year is observed on the last workday of the year before only by
    # the nearest-workday rules, so the year's own list is enough.
    d = d.withColumn("_closed", F.array_union(holidays_of(F.col("_y")), closures))
    days = F.sequence(F.col(ym), F.col("_end"))
    open_days = F.filter(days, lambda x: (F.weekday(x) < 5) & ~F.array_contains(F.col("_closed"), x))
    return d.select(ym, F.coalesce(F.array_max(open_days), F.col("_end")).alias("last_trading_day"))
