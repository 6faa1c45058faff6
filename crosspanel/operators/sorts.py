"""Portfolio sorts: breakpoints, bucket labels, value-weighted returns, spreads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crosspanel.functions.scalars import orient
from crosspanel.operators.quantiles import Quantile, grouped_quantiles
from crosspanel.session import stage_table

SIX = ("SL", "SM", "SH", "BL", "BM", "BH")
TAILS = ("L", "H")
EVENT = ("E", "N")
NEAREST_30_70 = (Quantile("q30", 0.3), Quantile("q70", 0.7))
LINEAR_30_70 = (Quantile("q30", 0.3, "linear"), Quantile("q70", 0.7, "linear"))
SIZE_MEDIAN = Quantile("sizemedn", 0.5, "linear")


def size_median(df: DataFrame, date: str = "jdate", exch: str | None = "primaryexch", me: str = "me") -> DataFrame:
    """Median equity per date over exchange N, or over all rows with ``exch=None``."""
    d = df.where(F.col(me) > 0)
    if exch is not None:
        d = d.where(F.col(exch) == "N")
    return grouped_quantiles(d, [date], me, [SIZE_MEDIAN]).drop("n_obs")


def exchange_quantiles(
    df: DataFrame,
    value: str,
    date: str = "jdate",
    exch: str | None = "primaryexch",
    quantiles: Sequence[Quantile] = NEAREST_30_70,
    sample: Column | None = None,
) -> DataFrame:
    """Characteristic breakpoints per date over exchange N (or all rows)."""
    d = df
    if exch is not None:
        d = d.where(F.col(exch) == "N")
    if sample is not None:
        d = d.where(sample)
    return grouped_quantiles(d, [date], value, quantiles).drop("n_obs")


def quantiles_with_fallback(df: DataFrame, value: str, date: str = "jdate", exch: str = "primaryexch", sample: Column | None = None) -> DataFrame:
    """Exchange N breakpoints where they exist, else those of all exchanges."""
    everyone = exchange_quantiles(df, value, date, None, sample=sample).withColumnsRenamed({"q30": "a30", "q70": "a70"})
    nyse = exchange_quantiles(df, value, date, exch, sample=sample)
    return everyone.join(nyse, date, "left").select(
        date, F.coalesce("q30", "a30").alias("q30"), F.coalesce("q70", "a70").alias("q70")
    )


def size_bucket(me: Column, median: Column) -> Column:
    return F.when(me <= median, "S").when(me > median, "B")


def tercile_bucket(v: Column, q30: Column, q70: Column) -> Column:
    known = v.isNotNull() & q30.isNotNull() & q70.isNotNull()
    return F.when(known & (v <= q30), "L").when(known & (v <= q70), "M").when(known & (v > q70), "H")


def tail_bucket(v: Column, q30: Column, q70: Column) -> Column:
    """Low and high tails; the middle stays null."""
    known = v.isNotNull() & q30.isNotNull() & q70.isNotNull()
    return F.when(known & (v <= q30), "L").when(known & (v >= q70), "H")


def flag_bucket(flag: Column) -> Column:
    return F.when(flag, "H").otherwise("L")


def assign_2x3(
    df: DataFrame,
    me: str = "me",
    value: str = "beme",
    median: str = "sizemedn",
    q30: str = "q30",
    q70: str = "q70",
    valid: Column | None = None,
    out_size: str = "szport",
    out_char: str = "chport",
) -> DataFrame:
    """Size and tercile labels; null where unassigned."""
    ok = F.lit(True) if valid is None else valid
    return df.withColumn(out_size, F.when(ok, size_bucket(F.col(me), F.col(median)))).withColumn(
        out_char, F.when(ok, tercile_bucket(F.col(value), F.col(q30), F.col(q70)))
    )


def value_weighted_returns(
    df: DataFrame,
    date: str = "jdate",
    ret: str = "mthret",
    weight: str = "wt",
    size: str = "szport",
    char: str = "chport",
) -> DataFrame:
    """Value-weighted return of the six portfolios per date, one column each."""
    d = df.where(
        F.col(ret).isNotNull() & (F.col(weight) > 0) & F.col(size).isNotNull() & F.col(char).isNotNull()
    ).withColumn("_port", F.concat(size, char))
    return d.groupBy(date).agg(*port_means(F.col("_port"), F.col(ret), F.col(weight), SIX))


def port_means(port: Column, ret: Column, weight: Column, names: Sequence[str]) -> list[Column]:
    """Conditional weighted means, which replace a pivot by one partial aggregate."""
    out = []
    for n in names:
        w = F.sum(F.when(port == n, weight))
        out.append(F.when(w > 0, F.sum(F.when(port == n, ret * weight)) / w).alias(n))
    return out


def port_counts(port: Column, names: Sequence[str]) -> list[Column]:
    return [F.count(F.when(port == n, 1)).alias(n) for n in names]


def long_short(orientation: str) -> Column:
    """Average high leg against average low leg over both size groups."""
    high = (F.col("BH") + F.col("SH")) / 2.0
    low = (F.col("BL") + F.col("SL")) / 2.0
    return orient(high, low, orientation)


def small_minus_big() -> Column:
    small = (F.col("SL") + F.col("SM") + F.col("SH")) / 3.0
    big = (F.col("BL") + F.col("BM") + F.col("BH")) / 3.0
    return small - big


def wide_breakpoints(
    df: DataFrame, samples: Mapping[str, tuple[Column, Column]], date: str = "jdate", medians: Sequence[str] = ()
) -> DataFrame:
    """Breakpoints of many samples in one pass: one row per date.

    ``samples`` maps a sample name to (row condition, value).  The samples of a row
    are exploded next to each other, so all of them share one scan and two shuffles.
    Output columns are ``<sample>_q30`` and ``<sample>_q70``, or ``<sample>_med`` for the
    samples named in ``medians``.
    """
    qs = [*NEAREST_30_70, Quantile("med", 0.5, "linear")]
    entries = [
        F.struct(F.lit(name).alias("sid"), F.when(cond, value.cast("double")).alias("v"))
        for name, (cond, value) in samples.items()
    ]
    long = df.select(date, F.explode(F.array(*entries)).alias("_e")).select(date, "_e.sid", "_e.v")
    bp = grouped_quantiles(long, ["sid", date], "v", qs)
    picks = [
        F.max(F.when(F.col("sid") == name, F.col(q.name))).alias(f"{name}_{q.name}")
        for name in samples
        for q in (qs[2:] if name in medians else qs[:2])
    ]
    # One row per date; written so that joining it back is a broadcast by known size.
    return stage_table(bp.groupBy(date).agg(*picks), "breakpoints")
