"""Interval, link, as-of, overlay and calendar joins.

No join carries a broadcast hint: adaptive execution broadcasts a side only when
its measured size is below ``spark.sql.autoBroadcastJoinThreshold`` and falls
back to a shuffled join, with skew splitting, beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosspanel.functions.dates import month_key
from crosspanel.operators.ordered import carry_last
from crosspanel.operators.rows import keep_last, stack_tables
from crosspanel.session import stage_table

OPEN_END = "9999-12-31"


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    date: str,
    start: str,
    end: str,
    columns: Sequence[str],
    how: str = "left",
    open_end: str = OPEN_END,
) -> DataFrame:
    """Join on equal keys where ``start <= date <= end``; a null end is open.

    The equality keys drive the shuffle and the interval is a residual filter, which suits keys
    with a handful of intervals each; ``banded_interval_join`` is for keys with very many.
    """
    r = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        F.col(start).alias("_from"),
        F.coalesce(F.col(end), F.lit(open_end).cast("date")).alias("_to"),
        *columns,
    )
    on: Column = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r_{k}") for k in keys])
    on = on & F.col(date).between(F.col("_from"), F.col("_to"))
    return left.join(r, on, how).drop("_from", "_to", *[f"_r_{k}" for k in keys])


def banded_interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    date: str,
    start: str,
    end: str,
    columns: Sequence[str],
    how: str = "left",
    open_end: str = OPEN_END,
) -> DataFrame:
    """The same join for keys with many intervals, by bands of interval length.

    Band k holds the intervals of more than 2^(k-1) and at most 2^k days and cuts the calendar into
    bins of 2^k days.  An interval touches two bins of its band at most, a date lies in one bin of each band, and
    rows meet on (keys, band, bin): what meets is at most a few times what matches, whatever
    the number of intervals of a key, and a hot key is spread over its bins.  Dates only; a null
    start, or an end before the start, matches nothing.  ``how`` is left or inner, or candidates for
    the rows that meet.
    """
    if how not in ("left", "inner", "candidates"):
        raise ValueError(f"unsupported join {how!r}")
    keys = list(keys)
    spans = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        F.unix_date(F.col(start)).alias("_from"),
        F.unix_date(F.coalesce(F.col(end), F.lit(open_end).cast("date"))).alias("_to"),
        *columns,
    ).where("_from <= _to")
    # The least power of two that is no shorter than the interval.
    band = F.ceil(F.log2(F.col("_to") - F.col("_from") + 1)).cast("int")
    spans = stage_table(spans.withColumn("_band", band), "bands")
    bands = sorted(r[0] for r in spans.select("_band").distinct().collect())  # 22 at most in the calendar
    width = F.call_function("shiftleft", F.lit(1), F.col("_band"))
    bins = F.array_distinct(F.array(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width)))
    spans = spans.withColumn("_bin", F.explode(bins))
    day = F.unix_date(F.col(date))
    places = F.array(*[F.struct(F.lit(b).alias("band"), F.floor(day / (1 << b)).alias("bin")) for b in bands]) if bands else F.array().cast("array<struct<band:int,bin:bigint>>")
    probes = left.withColumn("_day", day).withColumn("_at", F.explode(places))
    on: Column = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r_{k}") for k in keys])
    on = on & (F.col("_at.band") == F.col("_band")) & (F.col("_at.bin") == F.col("_bin"))
    met = probes.join(spans, on)
    found = met.where(F.col("_day").between(F.col("_from"), F.col("_to"))).select(*left.columns, *columns)
    if how == "candidates":
        return met
    if how == "inner":
        return found
    # A row without a match equals no row with one in keys and date.
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in [*keys, date]])
    matched = found.select(*[F.col(k).alias(f"_m_{k}") for k in [*keys, date]]).distinct()
    rest = left.join(matched, same, "left_anti")
    return found.unionByName(rest.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns]))


def usable_links(links: DataFrame, window_end: str | Column) -> DataFrame:
    """Links of research quality; an open end is set to the window's end."""
    end = F.lit(window_end).cast("date") if isinstance(window_end, str) else window_end
    return links.where((F.substring("linktype", 1, 1) == "L") & F.col("linkprim").isin("C", "P")).select(
        "gvkey", F.col("lpermno").alias("permno"), "linkdt", F.coalesce("linkenddt", end).alias("linkenddt")
    )


def link_join(statements: DataFrame, links: DataFrame, anchor: Column) -> DataFrame:
    """Attach securities to company rows whose ``anchor`` date lies inside the link."""
    a = statements.withColumn("_anchor", anchor)
    return (
        a.join(links, "gvkey")
        .where(F.col("_anchor").between(F.col("linkdt"), F.col("linkenddt")))
        .drop("_anchor", "linkdt", "linkenddt")
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_date: str,
    right_date: str,
    tie: Sequence[str],
    columns: Sequence[str],
    left_unique: bool = False,
    ranges: bool = False,
) -> DataFrame:
    """For each left row, the latest right row with ``right_date <= left_date``.

    Rows on the same right date are reduced to the last in ``tie`` order first and
    left rows to distinct dates, so a key's window holds at most two rows per
    calendar day whatever its share of the input.  Left rows without a match are
    dropped.  Set ``left_unique`` when (keys, left_date) is unique on the left, and
    ``ranges`` for timestamps, where the calendar doesn't bound a key's window: then ranges of
    (keys, time) are worked apart and the last right row of each is carried on.  There a null
    key matches nothing.
    """
    keys, tie, columns = list(keys), list(tie), list(columns)
    payload = [c for c in columns if c not in keys]
    r = right.where(F.col(right_date).isNotNull()).select(*dict.fromkeys([*keys, right_date, *tie, *payload]))
    r = keep_last(r, [*keys, right_date], tie)
    events = r.select(
        *keys, F.col(right_date).alias("_ts"), F.lit(0).alias("_side"), F.struct(*payload).alias("_hit")
    )
    carried = [] if not left_unique else [c for c in left.columns if c not in keys and c != left_date]
    base = left if left_unique else left.select(*keys, left_date).distinct()
    probes = base.select(
        *keys, F.col(left_date).alias("_ts"), F.lit(1).alias("_side"), F.struct(F.col(left_date), *carried).alias("_row")
    )
    both = stack_tables([events, probes])
    if ranges:
        carried_on = carry_last(both, keys, ["_ts", "_side"], "_hit", "_last")
    else:
        w = Window.partitionBy(*keys).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
        carried_on = both.withColumn("_last", F.last("_hit", ignorenulls=True).over(w))
    hits = (
        carried_on.where((F.col("_side") == 1) & F.col("_last").isNotNull())
        .select(*keys, "_row.*", *[F.col(f"_last.{c}").alias(c) for c in payload])
    )
    if left_unique:
        return hits
    return left.join(hits, [*keys, left_date])


def overlay(primary: DataFrame, fallback: DataFrame, key: str, end: str | None = None) -> DataFrame:
    """Primary values win, fallback fills gaps; optional end date; empty rows drop."""
    values = sorted((set(primary.columns) | set(fallback.columns)) - {key})
    a, b = primary.alias("a"), fallback.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")

    def pick(c: str) -> Column:
        sides = [F.col(f"{side}.{c}") for side, t in (("a", primary), ("b", fallback)) if c in t.columns]
        return F.coalesce(*sides).alias(c)

    out = joined.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *[pick(c) for c in values])
    if end is not None:
        out = out.where(F.col(key) <= F.lit(end).cast("date"))
    return out.dropna(how="all", subset=values)


def merge_series(long: DataFrame, names: Sequence[str], date: str = "date", name: str = "factor", value: str = "value") -> DataFrame:
    """Full outer merge of many series on date: one shuffle and a pivot."""
    return long.where(F.col(date).isNotNull()).groupBy(date).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def inner_merge(frames: dict[str, DataFrame], date: str = "date") -> DataFrame:
    """Dates present in every source within the common span, last row per date.

    A column name already taken by an earlier source gets that source's suffix.
    """
    taken: set[str] = set()
    spans, parts = [], []
    for source, frame in frames.items():
        clean = keep_last(frame.where(F.col(date).isNotNull()), [date], [c for c in frame.columns if c != date][:1])
        rename = {c: f"{c}__{source}" for c in frame.columns if c != date and c in taken}
        clean = clean.withColumnsRenamed(rename)
        taken |= set(clean.columns) - {date}
        parts.append(clean)
        spans.append(clean.agg(F.min(date).alias("first"), F.max(date).alias("last")))
    out = reduce(lambda a, b: a.join(b, date), parts)
    return clip_to_common_span(out, stack_tables(spans), date)


def clip_to_common_span(df: DataFrame, spans: DataFrame, date: str) -> DataFrame:
    """Keep dates between the latest start and the earliest end of all sources."""
    start = spans.agg(F.max("first")).scalar()
    end = spans.agg(F.min("last")).scalar()
    return df.where((F.col(date) >= start) & (F.col(date) <= end))


def align(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Two series on their common dates."""
    return a.join(b, list(on))


def reindex(series: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    """One row per calendar date, null where the series has none."""
    return calendar.select(F.col(date)).distinct().join(series, date, "left")


def month_calendar(df: DataFrame, date: str, out: str = "date") -> DataFrame:
    """Last observed date of each month."""
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(month_key(F.col(date)).alias("ym"))
        .agg(F.max(date).alias(out))
        .select(out)
    )


def align_metadata(names: DataFrame, meta: DataFrame, key: str = "factor") -> DataFrame:
    """Metadata in series order plus a status column for names without metadata."""
    found = meta.withColumn("_hit", F.lit(True))
    return names.join(found, key, "left").withColumn(
        "status", F.when(F.col("_hit"), F.lit("matched")).otherwise(F.lit("missing"))
    ).drop("_hit")
