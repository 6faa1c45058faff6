"""Market panel: universe, company collapse, July-June weights, December equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from crosspanel.functions.dates import month_key, portfolio_month, portfolio_year
from crosspanel.functions.frames import by_entity, cumulative_product, rolling
from crosspanel.functions.scalars import adjusted_volume, exchange_letter, market_equity


def common_share_universe(df: DataFrame) -> DataFrame:
    """Common shares on the three major exchanges, by whichever codes exist."""
    if "shrcd" in df.columns:
        df = df.where(F.col("shrcd").isin(10, 11))
    if "exchcd" in df.columns:
        df = df.where(F.col("exchcd").isin(1, 2, 3))
    elif "primaryexch" in df.columns:
        df = df.where(F.col("primaryexch").isin("N", "A", "Q"))
    return df


def flag_universe(df: DataFrame) -> DataFrame:
    """The same universe expressed in the newer classification flags."""
    return df.where(
        (F.col("sharetype") == "NS")
        & (F.col("securitytype") == "EQTY")
        & (F.col("securitysubtype") == "COM")
        & (F.col("usincflg") == "Y")
        & F.col("issuertype").isin("ACOR", "CORP")
        & F.col("primaryexch").isin("N", "A", "Q")
        & (F.col("conditionaltype") == "RW")
        & (F.col("tradingstatusflg") == "A")
    )


def with_exchange_letter(df: DataFrame) -> DataFrame:
    if "primaryexch" not in df.columns and "exchcd" in df.columns:
        df = df.withColumn("primaryexch", exchange_letter(F.col("exchcd")))
    return df


def collapse_companies(df: DataFrame, date: str = "jdate") -> DataFrame:
    """Keep a company's largest security and give it the company's total equity.

    Exact copies of a row become one row by partial aggregation, so they never travel;
    each copy still counts in the total.  The second join key
    includes the equity itself, so the rows of one very large company spread over
    partitions instead of landing in a single task.  Securities tied for the maximum
    all stay.  A company without any equity in a month (no price) keeps its securities
    with equity 0; a security without equity beside priced ones goes.
    """
    totals = df.groupBy(date, "permco").agg(F.sum("me").alias("_sum"), F.max("me").alias("_most"))
    most = totals.withColumnsRenamed({date: "_date", "permco": "_permco"})
    same = (F.col(date) == F.col("_date")) & (F.col("permco") == F.col("_permco")) & F.col("me").eqNullSafe(F.col("_most"))
    largest = df.distinct().join(most, same)
    return largest.withColumn("me", F.coalesce("_sum", F.lit(0.0))).drop("_sum", "_date", "_permco", "_most")


def add_weights(df: DataFrame) -> DataFrame:
    """Portfolio-year weights from last June's equity grown by price returns.

    All windows share the partitioning by security; a security has one row per
    month, so a group is bounded by the calendar.
    """
    d = (
        df.withColumn("ffyear", portfolio_year(F.col("jdate")))
        .withColumn("ffmonth", portfolio_month(F.col("jdate")))
        .withColumn("_gross", 1.0 + F.col("mthretx"))
    )
    w = by_entity("permno", "jdate")
    in_year = by_entity(["permno", "ffyear"], "jdate")
    whole_year = Window.partitionBy("permno", "ffyear")
    # The security window comes first: its partitioning also serves the year windows.
    d = d.withColumn(
        "lme",
        F.when(F.row_number().over(w) == 1, F.try_divide("me", "_gross")).otherwise(F.lag("me").over(w)),
    )
    d = d.withColumn("cumretx", cumulative_product(F.col("_gross"), in_year))
    d = d.withColumn("_lcum", F.lag("cumretx").over(w))
    july = F.max(F.when(F.col("ffmonth") == 1, F.col("lme"))).over(whole_year)
    december = F.max(F.when(F.month("jdate") == 12, F.col("me"))).over(whole_year)
    return (
        d.withColumn("mebase", july)
        .withColumn("dec_me", december)
        .withColumn("wt", F.when(F.col("ffmonth") == 1, F.col("lme")).otherwise(F.col("mebase") * F.col("_lcum")))
        .drop("_gross", "_lcum")
    )


def market_panel(
    monthly: DataFrame, start: str | None = None, end: str | None = None, warm_months: int = 0, universe=common_share_universe
) -> DataFrame:
    """Security-month panel with weights.

    Columns: permno, permco, jdate, ym, primaryexch, mthret, mthretx, prc, me,
    ffyear, ffmonth, cumretx, lme, mebase, dec_me, wt.  ``dec_me`` is the equity of
    the December inside the July-June year of the row, which for a June row is the
    December before.
    """
    d = warm_window(monthly, "mthcaldt", start, end, warm_months)
    d = with_exchange_letter(universe(d)).select(
        "permno",
        "permco",
        F.col("mthcaldt").alias("jdate"),
        month_key(F.col("mthcaldt")).alias("ym"),
        "primaryexch",
        F.coalesce("mthret", F.lit(0.0)).alias("mthret"),
        F.coalesce("mthretx", F.lit(0.0)).alias("mthretx"),
        F.abs("mthprc").alias("prc"),
        market_equity(F.col("mthprc"), F.col("shrout")).alias("me"),
    )
    return add_weights(collapse_companies(d))


def warm_window(df: DataFrame, date: str, start: str | None, end: str | None, warm_months: int) -> DataFrame:
    """Rows from ``warm_months`` before ``start`` through ``end``; None is open."""
    if start is not None:
        df = df.where(F.col(date) >= F.add_months(F.lit(start).cast("date"), -warm_months))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def june_rows(panel: DataFrame) -> DataFrame:
    """June snapshot; securities without equity last December drop out."""
    return panel.where((F.month("jdate") == 6) & F.col("dec_me").isNotNull())


def liquidity_panel(
    monthly: DataFrame,
    start: str | None = None,
    end: str | None = None,
    warm_months: int = 13,
    exchange_screen: bool = True,
) -> DataFrame:
    """Security months with turnover, log dollar volume and last month's equity.

    Returns are left missing and companies are not collapsed in this chain.
    ``exchange_screen=False`` keeps the share-code screen only and scales the
    turnover rather than the volume.
    """
    d = warm_window(monthly, "mthcaldt", start, end, warm_months)
    if exchange_screen:
        d = common_share_universe(d)
    elif "shrcd" in d.columns:
        d = d.where(F.col("shrcd").isin(10, 11))
    d = with_exchange_letter(d)
    vol, shares, price = F.col("vol"), F.col("shrout"), F.abs("mthprc")
    exch = F.col("exchcd") if "exchcd" in d.columns else F.lit(None).cast("int")
    if exchange_screen:
        adj = adjusted_volume(vol, exch, F.col("mthcaldt"))
        turnover = F.when(shares > 0, adj / shares)
    else:
        adj = vol
        turnover = F.when(shares > 0, adjusted_volume(vol / shares, exch, F.col("mthcaldt")))
    dollar = adj * price
    d = d.select(
        "permno",
        F.col("mthcaldt").alias("jdate"),
        "primaryexch",
        "mthret",
        market_equity(F.col("mthprc"), shares).alias("me"),
        turnover.alias("turnover"),
        F.when(dollar > 0, F.log(dollar)).alias("ldolvol"),
    )
    w = by_entity("permno", "jdate")
    return d.select(
        "*",
        F.lag("me").over(w).alias("wt"),
        rolling(F.avg, F.col("turnover"), w, 6, 3, shift=1).alias("turn"),
        rolling(F.avg, F.col("ldolvol"), w, 12, 9, shift=1).alias("dolvol"),
        rolling(F.stddev_samp, F.col("ldolvol"), w, 12, 9, shift=1).alias("std_dolvol"),
        rolling(F.stddev_samp, F.col("turnover"), w, 12, 9, shift=1).alias("std_turn"),
    )


def momentum_panel(panel: DataFrame) -> DataFrame:
    """Six-month and lagged 35-month compounded returns per security.

    The six-month window ends in the month being earned, as published by the
    studied code; no option shifts it.
    """
    w = by_entity("permno", "jdate")
    gross = 1.0 + F.col("mthret")
    log_sum = rolling(F.sum, F.log(F.greatest(gross, F.lit(1e-6))), w, 6, 6)
    return panel.select(
        "*",
        (F.exp(log_sum) - 1.0).alias("mom6m"),
        (rolling(F.product, gross, w, 35, 35, shift=2) - 1.0).alias("mom36m"),
    )
