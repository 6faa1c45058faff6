"""Comparing two sources of the same factor series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crosspanel.functions.dates import month_key
from crosspanel.operators.ordered import average_ranks
from crosspanel.operators.quantiles import grouped_median
from crosspanel.operators.rows import keep_last


def paired(a: DataFrame, b: DataFrame, on: Sequence[str] = ("factor", "date"), value: str = "ret") -> DataFrame:
    """(on..., a, b) for keys present with a value in both sources."""
    left = a.where(F.col(value).isNotNull()).select(*on, F.col(value).alias("a"))
    right = b.where(F.col(value).isNotNull()).select(*on, F.col(value).alias("b"))
    return left.join(right, list(on))


def delta_summary(pairs: DataFrame, by: str = "factor") -> DataFrame:
    """Rows, minimum, maximum and mean of a - b."""
    d = F.col("a") - F.col("b")
    return pairs.groupBy(by).agg(
        F.count(d).alias("rows_compared"), F.min(d).alias("delta_min"), F.max(d).alias("delta_max"), F.avg(d).alias("delta_mean")
    )


def replication_metrics(pairs: DataFrame, by: str = "factor", eps: float = 1e-12, standardise: bool = False) -> DataFrame:
    """Agreement of two sources per series, in one aggregate over ranked pairs.

    Ranks come from range partitions and standardisation from an aggregate, so a series of
    any length is spread over tasks.
    """
    d = pairs
    if standardise:
        stats = pairs.groupBy(by).agg(*[f(x).alias(f"_{n}_{x}") for x in ("a", "b") for n, f in (("avg", F.avg), ("sd", F.stddev_samp))])
        stats = stats.withColumnRenamed(by, "_by")
        scaled = [((F.col(x) - F.col(f"_avg_{x}")) / F.when(F.col(f"_sd_{x}") > 0, F.col(f"_sd_{x}")).otherwise(1.0)).alias(x) for x in ("a", "b")]
        d = pairs.join(stats, F.col(by).eqNullSafe(F.col("_by"))).select(*[c for c in pairs.columns if c not in ("a", "b")], *scaled)
    d = average_ranks(d, [by], ["a", "b"])
    a, b = F.col("a"), F.col("b")
    err = a - b
    agg = d.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr("a", "b").alias("_r"),
        F.corr("_rank_a", "_rank_b").alias("_rho"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(F.abs(err) / F.greatest(F.abs(b), F.lit(eps))).alias("mape"),
        F.avg(err).alias("bias"),
        F.coalesce(F.stddev_samp(err), F.lit(0.0)).alias("std_diff"),
        F.var_samp("a").alias("_va"),
        F.var_samp("b").alias("_vb"),
        F.avg("a").alias("_ma"),
        F.avg("b").alias("_mb"),
    )
    varied = (F.col("_va") > 0) & (F.col("_vb") > 0)
    spread = F.col("_va") + F.col("_vb") + (F.col("_ma") - F.col("_mb")) ** 2
    pearson = F.when(varied, F.col("_r"))
    return agg.select(
        by,
        "n",
        pearson.alias("pearson"),
        F.when(varied, F.col("_rho")).alias("spearman"),
        (pearson * pearson).alias("r2"),
        "rmse",
        "mae",
        "mape",
        "bias",
        "std_diff",
        F.when(spread != 0, 2.0 * pearson * F.sqrt("_va") * F.sqrt("_vb") / spread).alias("ccc"),
    )


def by_month(series: DataFrame, keys: Sequence[str] = ("factor",), date: str = "date", value: str = "ret") -> DataFrame:
    """Last value of each month, keyed by month."""
    d = series.where(F.col(value).isNotNull()).select(*keys, month_key(F.col(date)).alias("month"), date, value)
    return keep_last(d, [*keys, "month"], [date]).select(*keys, "month", value)


def single_comparison(a: DataFrame, b: DataFrame, by: str = "factor", value: str = "ret") -> DataFrame:
    """Month-aligned comparison of two versions of each series."""
    pairs = paired(by_month(a, [by], value=value), by_month(b, [by], value=value), [by, "month"], value)
    pairs = pairs.withColumn("_d", F.col("a") - F.col("b"))
    d = F.col("_d")
    stats = pairs.groupBy(by).agg(
        F.count(F.lit(1)).alias("obs"),
        F.corr("a", "b").alias("corr"),
        F.avg(F.abs(d)).alias("mae"),
        F.avg(d * d).alias("mse"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(d).alias("mean_diff"),
    )
    return stats.join(grouped_median(pairs, [by], "_d", "median_diff"), by)


def statistic_difference(pairs: DataFrame, key: str = "factor") -> DataFrame:
    """Absolute and relative gap between two implementations of a statistic."""
    gap = F.col("a") - F.col("b")
    return pairs.select(key, "a", "b", gap.alias("difference"), F.try_divide(100.0 * gap, F.col("b")).alias("diff_pct"))


def missing_counts(long: DataFrame, calendar: DataFrame, name: str = "factor", value: str = "ret") -> DataFrame:
    """Missing dates per series against a calendar, complete series included."""
    n_dates = calendar.agg(F.count(F.lit(1))).scalar()
    have = long.join(calendar.select("date"), "date", "left_semi").groupBy(name).agg(F.count(value).alias("n_have"))
    return have.select(name, (n_dates - F.col("n_have")).alias("n_missing"))


def complete_series(long: DataFrame, calendar: DataFrame, name: str = "factor", value: str = "ret") -> DataFrame:
    """Rows of the series that have a value on every calendar date."""
    full = missing_counts(long, calendar, name, value).where(F.col("n_missing") == 0).select(name)
    return long.join(calendar.select("date"), "date", "left_semi").join(full, name, "left_semi")
