"""Row-frame window helpers.

All windows here are partitioned by an entity (security, company, series) and
ordered by date.  Inputs hold one row per entity and period, so a window group
is bounded by the length of the calendar, never by the number of entities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec, functions as F


def by_entity(keys: str | Sequence[str], order: str | Sequence[str]) -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def rolling(agg, value: Column, spec: WindowSpec, size: int, min_periods: int, shift: int = 0) -> Column:
    """``agg`` over the last ``size`` rows, ending ``shift`` rows back.

    Null unless the frame holds at least ``min_periods`` non-null values.
    """
    frame = spec.rowsBetween(-(size - 1) - shift, -shift)
    return F.when(F.count(value).over(frame) >= min_periods, agg(value).over(frame))


def cumulative_product(value: Column, spec: WindowSpec) -> Column:
    return F.product(value).over(spec.rowsBetween(Window.unboundedPreceding, 0))


def running_max(value: Column, spec: WindowSpec) -> Column:
    return F.max(value).over(spec.rowsBetween(Window.unboundedPreceding, 0))


def cumulative_log_return(ret: Column, spec: WindowSpec) -> Column:
    return F.sum(F.log1p(ret)).over(spec.rowsBetween(Window.unboundedPreceding, 0))
