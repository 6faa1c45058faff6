"""Row-level set operators: deduplication, unions, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order``, remaining columns break ties.

    Written as a partial aggregate over an ordered struct, so a key that owns a
    large share of the rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in set(keys) | set(order)]
    packed = F.max(F.struct(*order, *rest)).alias("_last")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in set(keys) | set(order)]
    packed = F.min(F.struct(*order, *rest)).alias("_first")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def stack_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name, absent columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def missing_and_extra(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Names in ``want`` but not in ``have`` (missing) and the reverse (extra)."""
    h, w = have.select(key).distinct(), want.select(key).distinct()
    missing = w.join(h, key, "left_anti").select(key, F.lit("missing").alias("status"))
    extra = h.join(w, key, "left_anti").select(key, F.lit("extra").alias("status"))
    return missing.unionByName(extra)


def drop_all_null(df: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(value_cols))


def duplicates(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Row count per key and the mean the duplicates collapse to."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias(value))


def top_k(df: DataFrame, metric: str, k: int, ascending: bool, tie: str) -> DataFrame:
    """The ``k`` best rows by a metric; nulls sort last either way."""
    c: Column = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return df.orderBy(c, F.col(tie)).limit(k)
