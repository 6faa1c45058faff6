"""Ranks and last values along an order, spread over range partitions.

A window over a key puts all rows of the key in one task.  Here rows are cut into ranges of
(keys, order), each range is worked by itself, and what the earlier ranges of a key add
travels as one small row a key and range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from crosspanel.session import stage_table


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` written in ranges of (keys, order); ``_part`` rises with them.

    Rows equal in keys and order lie in one range.  ``parts`` is the number of shuffle
    partitions unless given.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    return stage_table(cut, "ranges")


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """``df`` plus ``out``: the last non-null ``value`` of the key at or before each row.

    (keys, order) should be unique among rows with a value, else any of the tied counts.
    Rows with a null key are dropped.
    """
    keys, order = list(keys), list(order)
    cut = ranged(df.dropna(subset=keys), keys, order, parts)
    ends = cut.groupBy(*keys, "_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    # One row a key and range.
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).where(F.col("_before").isNotNull())
    here = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(before.drop("_end"), [*keys, "_part"], "left")
    last = F.coalesce(F.last(value, ignorenulls=True).over(here), F.col("_before"))
    return joined.withColumn(out, last).select(*df.columns, out)


def average_ranks(df: DataFrame, by: Sequence[str], columns: Sequence[str], prefix: str = "_rank_", parts: int | None = None) -> DataFrame:
    """``df`` plus the rank of each column within ``by``; ties share their mean rank, nulls come first.

    Equal values are one row with a count before anything is ordered.  Columns are compared as
    doubles.  ``df`` is written first: ranks return to the rows by value, which must not change.
    """
    df, by = stage_table(df, "ranked"), list(by)
    value = lambda n: F.col(n).cast("double")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("_of"), value(n).alias("_value")) for n in columns]))
    keys = [*by, "_of"]
    counts = df.select(*by, each.alias("_v")).select(*by, "_v.*").groupBy(*keys, "_value").agg(F.count("*").alias("_n"))
    cut = ranged(counts, keys, ["_value"], parts)
    # One row a series and range.
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    here = Window.partitionBy(*keys, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    upto = cut.withColumn("_upto", F.sum("_n").over(here))
    before = before.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_part"]], "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_part"]]
    rank = (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("_rank")
    ranks = upto.join(before, reduce(and_, same)).select(*[f"_k_{k}" for k in keys], "_value", rank)
    out = df
    for n in columns:
        mine = ranks.where(F.col("_k__of") == n).withColumnRenamed("_rank", f"{prefix}{n}")
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by] + [value(n).eqNullSafe(F.col("_value"))]
        out = out.join(mine, reduce(and_, on)).drop("_value", *[f"_k_{k}" for k in keys])
    return out
