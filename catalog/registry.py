"""Registration of runnable queries next to the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.sql_tables import with_tables
from crosspanel.plans.extracts import BaseTables, extract_base, staged_raw
from crosspanel.plans.factors import with_panel
from crosspanel.session import stage_table, stage_tables
from crosspanel.sources.derived import RawTables, line_sums, raw_tables, read_table
from crosspanel.sources.research import ResearchTables, research_tables


class Tables:
    """Input tables of one data folder; shared intermediates are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def sums(self) -> DataFrame:
        return stage_table(line_sums(self.read("lineitem")), "sums")

    @cached_property
    def raw(self) -> RawTables:
        return staged_raw(raw_tables(self.spark, self.sf_dir, self.sums))

    @cached_property
    def base(self) -> BaseTables:
        return with_panel(extract_base(self.raw))

    @cached_property
    def research(self) -> ResearchTables:
        r = research_tables(self.spark, self.sf_dir, self.sums)
        factors, factors_open, assets = stage_tables(factors=r.factors, factors_open=r.factors_open, assets=r.assets)
        return replace(r, factors=factors, factors_open=factors_open, assets=assets)


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def round_doubles(df: DataFrame, digits: int) -> DataFrame:
    return df.select(
        *[F.round(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def query(name: str, sql: str | None = None, doubles: str = "", digits: int | None = 8):
    """Register a query; ``doubles`` names the columns both sides round.

    With ``digits=None`` the doubles are exact on both sides and stay as they are.
    """

    def decorate(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn if digits is None else lambda t: round_doubles(fn(t), digits)
        if sql is not None:
            body = sql
            if doubles:
                cols = ", ".join(f'round("{d}", {digits}) + 0.0::DOUBLE AS "{d}"' for d in doubles.split())
                body = f"SELECT * REPLACE ({cols}) FROM (\n{sql}\n) AS q"
            ORACLES[name] = with_tables(body)
        return fn

    return decorate


_TABLES: dict[tuple[str, str], Tables] = {}


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]


def forget_tables() -> None:
    """Drop the shared intermediates, so the next query starts from the inputs."""
    _TABLES.clear()
