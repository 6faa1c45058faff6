"""Scalar column helpers: guarded ratios, accounting items, adjustments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def safe_ratio(num: Column, den: Column, eps: float = 0.0) -> Column:
    """``num / den``; null when ``|den| <= eps`` or either side is null."""
    d = den.cast("double")
    return F.when(F.abs(d) > eps, num.cast("double") / d)


def pct_change(now: Column, before: Column, eps: float = 0.0) -> Column:
    return safe_ratio(now, before, eps) - F.lit(1.0)


def first_non_zero(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in cols], F.lit(0.0))


def book_equity(seq: Column, txditc: Column, pstkrv: Column, pstkl: Column, pstk: Column) -> Column:
    """Shareholder equity plus deferred taxes less preferred stock; zero is missing."""
    raw = seq + F.coalesce(txditc, F.lit(0.0)) - first_non_zero(pstkrv, pstkl, pstk)
    return F.nullif(raw, F.lit(0.0))


def book_equity_positive(seq: Column, txditc: Column, pstkrv: Column, pstkl: Column, pstk: Column) -> Column:
    """Older variant: first non-null preferred item, non-positive equity is missing."""
    raw = seq + F.coalesce(txditc, F.lit(0.0)) - F.coalesce(pstkrv, pstkl, pstk, F.lit(0.0))
    return F.when(raw > 0, raw)


def current_ratio(act: Column, lct: Column) -> Column:
    return F.when(lct > 0, act / lct)


def industry_code(sich: Column, company_sic: Column) -> Column:
    """Historical code when present, else the company's text code; blank is missing."""
    return F.coalesce(sich.cast("int"), F.nullif(F.trim(company_sic), F.lit("")).try_cast("int"))


def industry_bucket(sic: Column) -> Column:
    return F.floor(sic / 100).cast("int")


def market_equity(price: Column, shares: Column) -> Column:
    """Price may carry a negative sign (quote midpoint)."""
    return F.abs(price) * shares


def exchange_letter(exchcd: Column) -> Column:
    return F.when(exchcd == 1, "N").when(exchcd == 2, "A").when(exchcd == 3, "Q")


# End dates and divisors of the published volume adjustment for
# exchange code 3.
VOLUME_DIVISORS = (("2001-02-01", 2.0), ("2002-01-01", 1.8), ("2004-01-01", 1.6))


def adjusted_volume(vol: Column, exchcd: Column, date: Column) -> Column:
    """Scale double-counted dealer volume on exchange code 3 before 2004."""
    divisor = F.lit(1.0)
    for end, by in reversed(VOLUME_DIVISORS):
        divisor = F.when(date < F.lit(end).cast("date"), F.lit(by)).otherwise(divisor)
    return vol / F.when(exchcd == 3, divisor).otherwise(F.lit(1.0))


def orient(high: Column, low: Column, orientation: str) -> Column:
    """Long-short spread in one of the two named directions."""
    if orientation == "high_minus_low":
        return high - low
    if orientation == "low_minus_high":
        return low - high
    raise ValueError(f"orientation must be high_minus_low or low_minus_high, not {orientation!r}")


def normal_name(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "", name.lower())


def normalise_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names and keep only letters and digits."""
    return df.withColumnsRenamed({c: normal_name(c) for c in df.columns})


def rename_by_alias(df: DataFrame, aliases: Mapping[str, Iterable[str]]) -> DataFrame:
    """Rename columns to canonical names, matching aliases without case or marks."""
    have = {normal_name(c): c for c in df.columns}
    found: dict[str, str] = {}
    for canonical, options in aliases.items():
        hit = next((have[normal_name(o)] for o in (canonical, *options) if normal_name(o) in have), None)
        if hit is not None and hit not in found:
            found[hit] = canonical
    return df.withColumnsRenamed(found)
