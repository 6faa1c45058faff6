"""Long factor and asset return tables derived from order lines.

Brands act as factors and suppliers as test assets.  A return is the bounded
change of the integer-cent monthly sum, so it is exact on every engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crosspanel.session import stage_table
from crosspanel.sources.derived import _cents, line_sums, monthly_sums, read_table, security_months


def bounded_change(now: Column, before: Column) -> Column:
    return F.try_divide((now - before).cast("double"), (10 * (now + before)).cast("double"))


def risk_free(calendar: DataFrame) -> DataFrame:
    """A deterministic monthly rate for the dates of a calendar."""
    number = F.year("date") * 12 + F.month("date")
    return calendar.select("date", (F.lit(0.001) + (number % 5).cast("double") * 0.0005).alias("rf"))


def calendar_of(sums: DataFrame) -> DataFrame:
    """Last trading date of each month, from monthly sums."""
    return sums.where(F.col("last").isNotNull()).groupBy("ym").agg(F.max("last").alias("date")).select("date")


def brand_sums(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """(factor, ym, c, c_open): integer cents of all and of open lines per brand and month."""
    d = lineitem.select(
        "l_partkey",
        F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("ym"),
        _cents(F.col("l_extendedprice")).alias("c"),
        (F.col("l_linestatus") == "O").alias("open"),
    )
    both = [F.sum("c").alias("c"), F.sum(F.when(F.col("open"), F.col("c"))).alias("c_open")]
    # Sums per part first: the join then moves one row per part and month.
    per_part = d.groupBy("l_partkey", "ym").agg(*both)
    brands = part.select(F.col("p_partkey").alias("l_partkey"), F.regexp_replace("p_brand", "#", "").alias("factor"))
    return per_part.join(brands, "l_partkey").groupBy("factor", "ym").agg(F.sum("c").alias("c"), F.sum("c_open").alias("c_open"))


def factor_returns(brands: DataFrame, calendar: DataFrame, value: str = "c") -> DataFrame:
    """(factor, date, ret) per brand and month with a value, first month dropped."""
    w = Window.partitionBy("factor").orderBy("ym")
    sums = brands.where(F.col(value).isNotNull())
    ret = sums.withColumn("ret", bounded_change(F.col(value), F.lag(value).over(w))).where(F.col("ret").isNotNull())
    dates = calendar.select(F.trunc("date", "MM").alias("ym"), "date")
    return ret.join(dates, "ym").select("factor", "date", "ret")


def asset_returns(months: DataFrame, rf: DataFrame) -> DataFrame:
    """(asset, block, date, ret): excess returns per supplier and month."""
    w = Window.partitionBy("permno").orderBy("ym")
    ret = months.select("permno", F.col("mthcaldt").alias("date"), bounded_change(F.col("cents"), F.lag("cents").over(w)).alias("r"))
    return (
        ret.where(F.col("r").isNotNull())
        .join(rf, "date")
        .select(
            F.col("permno").alias("asset"),
            F.floor(F.col("permno") / 6).alias("block"),
            "date",
            (F.col("r") - F.col("rf")).alias("ret"),
        )
    )


def factor_metadata(part: DataFrame) -> DataFrame:
    """Publication year, sample end and eligibility per factor."""
    k = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    brands = part.select(F.regexp_replace("p_brand", "#", "").alias("factor"), k.alias("k")).distinct()
    return brands.select(
        "factor",
        (F.lit(1990) + F.col("k")).alias("year_pub"),
        (F.lit(1985) + F.col("k")).alias("year_end"),
        (F.lit(5) + (F.col("k") * 7) % 20).alias("min_stk6"),
        F.col("k").alias("position"),
    )


@dataclass(frozen=True)
class ResearchTables:
    factors: DataFrame
    factors_open: DataFrame
    assets: DataFrame
    metadata: DataFrame
    rf: DataFrame
    calendar: DataFrame


def research_tables(spark: SparkSession, sf_dir: str, sums: DataFrame | None = None) -> ResearchTables:
    """Series and assets from staged ``line_sums`` and brand sums, one pass over the lines each."""
    lineitem, part = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    brands = stage_table(brand_sums(lineitem, part), "brands")
    sums = stage_table(line_sums(lineitem), "sums") if sums is None else sums
    months = monthly_sums(sums)
    calendar = stage_table(calendar_of(months), "calendar")
    rf = risk_free(calendar)
    return ResearchTables(
        factors=factor_returns(brands, calendar),
        factors_open=factor_returns(brands, calendar, "c_open"),
        assets=asset_returns(security_months(months), rf),
        metadata=factor_metadata(part),
        rf=rf,
        calendar=calendar,
    )
