"""Incremental fill of a stored panel from its high-water marks.

The studied system has no stream processing; its only incremental behaviour is to
load the rows after the last stored date and merge them into their year.  A row that arrives
later with a date before its year's mark is therefore never loaded; fill such a year again as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crosspanel.operators.rows import keep_last, stack_tables
from crosspanel.session import stage_table
from crosspanel.sources.store import PanelStore


def high_water_marks(store: PanelStore, table: str) -> DataFrame:
    """Next date to load per year, from the audit table: the day after the last stored date."""
    return store.latest(table).select("year", F.date_add("max_date", 1).alias("next_date"))


def rows_to_load(source: DataFrame, marks: DataFrame, date_col: str) -> DataFrame:
    """Source rows past the mark of their year, and all rows of years not stored."""
    d = source.withColumn("year", F.year(date_col)).join(marks, "year", "left")
    fresh = F.col("next_date").isNull() | (F.col(date_col) >= F.col("next_date"))
    return d.where(fresh).drop("year", "next_date")


def merge_rows(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union with later loads winning on equal keys."""
    marked = [stored.withColumn("_load", F.lit(0)), fresh.withColumn("_load", F.lit(1))]
    both = stack_tables(marked)
    if not keys:
        return both.drop("_load").dropDuplicates()
    return keep_last(both, keys, ["_load"]).drop("_load")


def incremental_fill(store: PanelStore, source: DataFrame, table: str, date_col: str, keys: Sequence[str], spec_key: str = "") -> DataFrame:
    """Merge new source rows into the years they touch and rewrite only those years."""
    stored = store.spark.read.parquet(store.path(table))
    fresh = stage_table(rows_to_load(source, high_water_marks(store, table), date_col), "fill")
    touched = fresh.select(F.year(date_col).alias("year")).distinct()
    old = stored.join(touched, "year", "left_semi").drop("year")
    merged = stage_table(merge_rows(old, fresh, [date_col, *keys]), "fill")
    store.replace_years(merged, table, date_col, spec_key)
    return touched
