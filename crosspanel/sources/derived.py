"""Research base tables derived from order-line data.

The licensed panels this library is written for are not distributable, so the
registered queries run on a panel derived from ``lineitem`` and ``supplier``: a
supplier is a security, a calendar month of its sales is a security-month.  All
money is summed in integer cents before any division, so results do not depend
on the order of summation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crosspanel.operators.rows import stack_tables
from crosspanel.session import stage_table


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def _dealt_lines(lineitem: DataFrame, key: str) -> DataFrame:
    """The order lines in integer cents, dealt by security and quarter.

    A security has a few lines a month, which lie anywhere in the input: sums over a
    split are hardly fewer than its lines, yet wider, and fill the memory of its task.
    So narrow lines travel once, flag and status as the places of their letters in RAN
    and OF, and are summed where they meet.  The quarter spreads the lines of a very
    large security over the calendar.
    """
    date, flag, status = F.col("l_shipdate").cast("date"), F.col("l_returnflag"), F.col("l_linestatus")
    d = lineitem.select(
        F.col(key).alias("k"),
        date.alias("d"),
        F.when(flag == "R", 1).when(flag == "A", 2).when(flag == "N", 3).alias("flag"),
        F.when(status == "O", 1).when(status == "F", 2).alias("status"),
        F.col("l_quantity").cast("long").alias("q"),
        _cents(F.col("l_extendedprice")).alias("c"),
        _cents(F.col("l_extendedprice") * F.col("l_discount")).alias("disc"),
        _cents(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
    )
    return d.repartition("k", F.trunc("d", "quarter"))


def line_sums(lineitem: DataFrame, key: str = "l_suppkey") -> DataFrame:
    """Statement sums per company and quarter, in integer cents, and the sums of its months.

    Months and quarters come from one shuffle of the lines.
    """

    def part(value: str, cond: Column | None = None) -> Column:
        picked = F.col(value) if cond is None else F.when(cond, F.col(value)).otherwise(0)
        return F.sum(picked)

    flag, status = F.col("flag"), F.col("status")
    month = _dealt_lines(lineitem, key).groupBy("k", F.trunc("d", "quarter").alias("period"), F.trunc("d", "MM").alias("ym")).agg(
        part("c").alias("c_all"),
        part("c", flag == 1).alias("c_r"),
        part("c", flag == 2).alias("c_a"),
        part("c", flag == 3).alias("c_n"),
        part("c", status == 1).alias("c_o"),
        part("c", status == 2).alias("c_f"),
        part("disc").alias("disc"),
        part("disc", flag == 2).alias("disc_a"),
        part("disc", flag == 1).alias("disc_r"),
        part("tax").alias("tax"),
        part("tax", flag == 1).alias("tax_r"),
        F.count(F.lit(1)).alias("n"),
        F.sum("q").alias("shares"),
        F.max("d").alias("last"),
    )
    own = F.struct("ym", F.col("c_all").alias("cents"), "shares", F.col("n").alias("n_lines"), "last")
    sums = [F.sum(x).alias(x) for x in month.columns if x not in ("k", "period", "ym", "shares", "last")]
    return month.groupBy("k", "period").agg(*sums, F.collect_list(own).alias("months"))


def monthly_sums(sums: DataFrame) -> DataFrame:
    """One row per security and calendar month: integer sums and the last trading date."""
    return sums.select(F.col("k").alias("permno"), F.inline("months"))


def quarter_sums(sums: DataFrame) -> DataFrame:
    """Statement sums per company and quarter."""
    return sums.drop("months")


def security_months(sums: DataFrame) -> DataFrame:
    """Monthly sums with the last trading date of the month over all securities."""
    calendar = sums.groupBy("ym").agg(F.max("last").alias("mthcaldt"))
    return sums.drop("last").join(calendar, "ym")


def monthly_file(months: DataFrame) -> DataFrame:
    """Base monthly file: returns, shares, price (negative marks a quote midpoint)."""
    w = Window.partitionBy("permno").orderBy("ym")
    before = F.lag("cents").over(w)
    ret = F.try_divide((F.col("cents") - before).cast("double"), (10 * (F.col("cents") + before)).cast("double"))
    number = F.year("ym") * 12 + F.month("ym")
    price = F.try_divide(F.col("cents").cast("double"), (F.col("shares") * 100).cast("double"))
    flag = (F.col("permno") + number) % 7 == 0
    return months.select(
        "permno",
        (F.col("permno") - F.when(F.col("permno") % 10 == 1, 1).otherwise(0)).alias("permco"),
        "mthcaldt",
        "ym",
        F.when(F.col("permno") % 3 == 0, "N").when(F.col("permno") % 3 == 1, "A").otherwise("Q").alias("primaryexch"),
        F.when((F.col("permno") * 7 + number) % 29 != 0, ret).alias("mthret"),
        (ret * F.lit(0.9)).alias("mthretx"),
        F.col("shares").cast("double").alias("shrout"),
        F.when(flag, -price).otherwise(price).alias("mthprc"),
        F.lit("CORP").alias("issuertype"),
        F.lit("EQTY").alias("securitytype"),
        F.when(F.col("permno") % 31 == 0, "ADR").otherwise("COM").alias("securitysubtype"),
        F.lit("NS").alias("sharetype"),
        F.when(F.col("permno") % 37 == 0, "N").otherwise("Y").alias("usincflg"),
        F.lit("RW").alias("conditionaltype"),
        F.when((F.col("permno") + number) % 53 == 0, "H").otherwise("A").alias("tradingstatusflg"),
    )


def volume_file(months: DataFrame) -> DataFrame:
    """Legacy volume by security and date; some months are absent."""
    number = F.year("ym") * 12 + F.month("ym")
    return months.where((F.col("permno") + number) % 41 != 0).select(
        "permno", F.col("mthcaldt").alias("date"), F.col("n_lines").cast("double").alias("vol")
    )


def names_history(supplier: DataFrame) -> DataFrame:
    """Share and exchange codes by date interval; the last interval is open."""
    k = F.col("s_suppkey")
    exch = F.when(k % 3 == 0, 1).when(k % 3 == 1, 2).otherwise(3)
    early = supplier.where(k % 13 != 0).select(
        k.alias("permno"),
        F.lit("1990-01-01").cast("date").alias("namedt"),
        F.lit("1998-06-30").cast("date").alias("nameendt"),
        F.lit(10).alias("shrcd"),
        exch.alias("exchcd"),
    )
    late = supplier.select(
        k.alias("permno"),
        F.lit("1998-07-01").cast("date").alias("namedt"),
        F.lit(None).cast("date").alias("nameendt"),
        F.when(k % 17 == 0, 12).otherwise(11).alias("shrcd"),
        exch.alias("exchcd"),
    )
    return stack_tables([early, late])


def link_history(supplier: DataFrame) -> DataFrame:
    """Company-to-security links with quality codes and open-ended intervals."""
    k = F.col("s_suppkey")
    return supplier.select(
        F.lpad(k.cast("string"), 6, "0").alias("gvkey"),
        k.alias("lpermno"),
        F.when(k % 19 == 0, "NR").when(k % 2 == 0, "LC").otherwise("LU").alias("linktype"),
        F.when(k % 23 == 0, "J").when(k % 4 == 3, "C").otherwise("P").alias("linkprim"),
        F.make_date((F.lit(1990) + k % 8).cast("int"), F.lit(1), F.lit(1)).alias("linkdt"),
        F.when(k % 11 == 0, F.lit("1999-12-31").cast("date")).alias("linkenddt"),
    )


def company(supplier: DataFrame) -> DataFrame:
    """Company header with a text industry code, blank for some."""
    k = F.col("s_suppkey")
    return supplier.select(
        F.lpad(k.cast("string"), 6, "0").alias("gvkey"),
        F.when(k % 14 == 5, "").otherwise((F.lit(1000) + (k * 37) % 8000).cast("string")).alias("sic"),
    )


def annual_statements(quarters: DataFrame) -> DataFrame:
    """Annual statement rows per company and fiscal year, rolled up from quarter sums."""
    sums = [F.sum(x).alias(x) for x in quarters.columns if x not in ("k", "period")]
    s = quarters.groupBy("k", F.year("period").alias("period")).agg(*sums)
    k, y = F.col("k"), F.col("period")

    def money(c: Column | str) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return c.cast("double") / F.lit(100.0)

    return s.select(
        F.lpad(k.cast("string"), 6, "0").alias("gvkey"),
        F.when(k % 5 == 0, F.make_date(y, F.lit(6), F.lit(30))).otherwise(F.make_date(y, F.lit(12), F.lit(31))).alias("datadate"),
        F.when(k % 29 == 0, "FS").otherwise("INDL").alias("indfmt"),
        F.lit("STD").alias("datafmt"),
        F.lit("D").alias("popsrc"),
        F.lit("C").alias("consol"),
        F.when((k + y) % 3 == 0, money("tax_r")).when((k + y) % 3 == 1, 0.0).alias("pstkrv"),
        F.when((k + y) % 4 == 0, money("disc_r")).when((k + y) % 4 == 1, 0.0).alias("pstkl"),
        F.when((k + y) % 2 == 0, money("tax")).alias("pstk"),
        F.when((k + y) % 6 != 0, money("disc_a")).alias("txditc"),
        F.when((k + y) % 13 == 0, -money("c_r")).otherwise(money(F.col("c_n") + F.col("c_a"))).alias("seq"),
        money(F.col("c_a") + F.col("c_n")).alias("act"),
        F.when((k + y) % 17 != 0, money("c_a")).alias("invt"),
        F.when((k + y) % 23 != 0, money("c_r")).otherwise(0.0).alias("lct"),
        money("c_all").alias("sale"),
        money(F.col("c_r") + F.col("disc")).alias("cogs"),
        money("disc").alias("che"),
        money("c_o").alias("rect"),
        money("tax").alias("dp"),
        money("c_f").alias("ppent"),
        money(F.col("c_n") - F.col("c_r")).alias("ib"),
        money(F.col("c_all") + F.col("tax")).alias("at"),
        F.when((k + y) % 5 != 0, money(F.col("c_n") - F.col("c_a"))).alias("oancf"),
        money(F.col("disc") - F.col("tax")).alias("xidoc"),
        money("c_r").alias("dltt"),
        F.when((k + y) % 3 == 0, money("disc_r")).when((k + y) % 3 == 1, 0.0).alias("dcvt"),
        money("tax_r").alias("dlc"),
        F.col("n").cast("double").alias("emp"),
        money("disc_a").alias("xad"),
        F.when((k + y) % 7 != 0, money("disc_r")).alias("xrd"),
        money("tax_r").alias("txt"),
        F.when((k * 31 + y * 17) % 4 < 2, money("tax")).otherwise(0.0).alias("dvt"),
        F.when(k % 3 != 0, (F.lit(1000) + (k * 37) % 8000)).cast("int").alias("sich"),
    )


def quarterly_statements(s: DataFrame) -> DataFrame:
    """Quarterly statement rows with a report date 45 to 74 days after quarter end."""
    k = F.col("k")
    end = F.last_day(F.add_months(F.col("period"), 2))
    number = F.year("period") * 4 + F.quarter("period")

    def money(c: str) -> Column:
        return F.col(c).cast("double") / F.lit(100.0)

    return s.select(
        F.lpad(k.cast("string"), 6, "0").alias("gvkey"),
        end.alias("datadate"),
        F.when((k + number) % 19 != 0, F.date_add(end, (F.lit(45) + k % 30).cast("int"))).alias("rdq"),
        F.when(k % 29 == 0, "FS").otherwise("INDL").alias("indfmt"),
        F.lit("STD").alias("datafmt"),
        F.lit("D").alias("popsrc"),
        F.lit("C").alias("consol"),
        money("c_r").alias("ltq"),
        ((F.col("c_n") - F.col("c_a")).cast("double") / F.lit(100.0)).alias("ibq"),
        F.when((k + number) % 31 != 0, money("tax")).alias("dpq"),
        money("c_f").alias("ppentq"),
    )


@dataclass(frozen=True)
class RawTables:
    """The undigested inputs of the three panel extracts."""

    msf: DataFrame
    volume: DataFrame
    names: DataFrame
    links: DataFrame
    company: DataFrame
    funda: DataFrame
    fundq: DataFrame


def raw_tables(spark: SparkSession, sf_dir: str, sums: DataFrame | None = None) -> RawTables:
    """The inputs from one pass over the order lines, summed and written once.

    ``sums`` are staged ``line_sums``, if some exist already.
    """
    supplier = read_table(spark, sf_dir, "supplier")
    if sums is None:
        sums = stage_table(line_sums(read_table(spark, sf_dir, "lineitem")), "sums")
    months, quarters = security_months(monthly_sums(sums)), quarter_sums(sums)
    return RawTables(
        msf=monthly_file(months),
        volume=volume_file(months),
        names=names_history(supplier),
        links=link_history(supplier),
        company=company(supplier),
        funda=annual_statements(quarters),
        fundq=quarterly_statements(quarters),
    )
