"""The three panel extracts: monthly file, annual anchors, quarterly as-of rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crosspanel.functions.dates import fiscal_june, month_key
from crosspanel.functions.scalars import book_equity, current_ratio, industry_code
from crosspanel.operators.joins import asof_join, interval_join, link_join, usable_links
from crosspanel.operators.rows import keep_last
from crosspanel.session import stage_tables
from crosspanel.sources.derived import RawTables, raw_tables

ANNUAL_ITEMS = [
    "act", "invt", "lct", "sale", "cogs", "che", "rect", "dp", "ppent", "ib", "at", "oancf",
    "xidoc", "dltt", "dcvt", "dlc", "emp", "xad", "xrd", "txt", "dvt",
]
QUARTERLY_ITEMS = ["ltq", "ibq", "dpq", "ppentq"]
FAR_END = "2100-12-31"


def in_window(df: DataFrame, date: str, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def standard_format(statements: DataFrame) -> DataFrame:
    """Industrial, standardised, domestic, consolidated statements only."""
    return statements.where(
        (F.col("indfmt") == "INDL") & (F.col("datafmt") == "STD") & (F.col("popsrc") == "D") & (F.col("consol") == "C")
    )


def monthly_extract(
    raw: RawTables, start: str | None = None, end: str | None = None, extra: Column | None = None
) -> DataFrame:
    """Monthly file with legacy volume and the share/exchange codes of the day."""
    m = in_window(raw.msf, "mthcaldt", start, end)
    if extra is not None:
        m = m.where(extra)
    vol = raw.volume.select("permno", F.col("date").alias("mthcaldt"), "vol")
    m = m.join(vol, ["permno", "mthcaldt"], "left")
    return interval_join(m, raw.names, ["permno"], "mthcaldt", "namedt", "nameendt", ["shrcd", "exchcd"])


def annual_core(funda: DataFrame, company: DataFrame) -> DataFrame:
    """Book equity, current ratio, industry code and sales growth per company year."""
    f = standard_format(funda).join(company, "gvkey", "left")
    be = book_equity(F.col("seq"), F.col("txditc"), F.col("pstkrv"), F.col("pstkl"), F.col("pstk"))
    core = f.select(
        "gvkey",
        "datadate",
        F.year("datadate").alias("fyear"),
        be.alias("be"),
        current_ratio(F.col("act"), F.col("lct")).alias("currat"),
        industry_code(F.col("sich"), F.col("sic")).alias("sic"),
        *ANNUAL_ITEMS,
    )
    lag_sale = F.lag("sale").over(Window.partitionBy("gvkey").orderBy("datadate"))
    return core.withColumn("sgr", F.when(lag_sale != 0, (F.col("sale") - lag_sale) / lag_sale))


def annual_anchors(raw: RawTables, end: str | None = None) -> DataFrame:
    """Latest fiscal year per security, anchored to June of the following year."""
    links = usable_links(raw.links, end or FAR_END)
    anchor = fiscal_june(F.col("datadate"))
    linked = link_join(annual_core(raw.funda, raw.company), links, anchor)
    linked = linked.withColumn("ym", month_key(anchor)).where(F.year("datadate") == F.year("ym") - 1)
    return keep_last(linked, ["permno", "ym"], ["datadate", "gvkey"])


def annual_extract(
    raw: RawTables, start: str | None = None, end: str | None = None, extra: Column | None = None
) -> DataFrame:
    """Annual anchors joined to the June row of the monthly file."""
    m = in_window(raw.msf, "mthcaldt", start, end)
    if extra is not None:
        m = m.where(extra)
    m = m.select(
        "permno",
        "permco",
        F.col("mthcaldt").alias("jdate_ltrd"),
        month_key(F.col("mthcaldt")).alias("ym"),
        F.last_day("mthcaldt").alias("cal_mend"),
        "mthret",
        "mthretx",
        "shrout",
        "mthprc",
    )
    return m.join(annual_anchors(raw, end), ["permno", "ym"])


def quarterly_core(fundq: DataFrame, company: DataFrame) -> DataFrame:
    q = standard_format(fundq).join(company, "gvkey", "left")
    return q.select("gvkey", "datadate", "rdq", *QUARTERLY_ITEMS, industry_code(F.lit(None), F.col("sic")).alias("sic"))


def quarterly_extract(
    raw: RawTables, start: str | None = None, end: str | None = None, extra: Column | None = None
) -> DataFrame:
    """Latest reported quarter known on each monthly date."""
    m = in_window(raw.msf, "mthcaldt", start, end)
    if extra is not None:
        m = m.where(extra)
    m = m.select("permno", "permco", F.col("mthcaldt").alias("jdate_ltrd"), month_key(F.col("mthcaldt")).alias("ym"))
    linked = link_join(
        quarterly_core(raw.fundq, raw.company).where(F.col("rdq").isNotNull()),
        usable_links(raw.links, end or FAR_END),
        F.col("rdq"),
    )
    hit = asof_join(
        m,
        linked,
        ["permno"],
        "jdate_ltrd",
        "rdq",
        ["datadate", "gvkey"],
        ["gvkey", "datadate", "rdq", *QUARTERLY_ITEMS, "sic"],
        left_unique=True,
    )
    return keep_last(hit, ["permno", "ym"], ["jdate_ltrd"])


@dataclass(frozen=True)
class BaseTables:
    """The bundle of base tables every factor reads.

    ``panel`` optionally holds the full-history market panel built from ``monthly``,
    so that many factors share one materialised copy.
    """

    monthly: DataFrame
    annual: DataFrame
    quarterly: DataFrame
    panel: DataFrame | None = None


def base_tables(spark: SparkSession, sf_dir: str) -> BaseTables:
    """The three extracts, each written once to the shared checkpoint folder."""
    return extract_base(staged_raw(raw_tables(spark, sf_dir)))


def staged_raw(raw: RawTables) -> RawTables:
    """Write the aggregated inputs once; all extracts then read those."""
    msf, funda, fundq = stage_tables(msf=raw.msf, funda=raw.funda, fundq=raw.fundq)
    return replace(raw, msf=msf, funda=funda, fundq=fundq)


def extract_base(raw: RawTables) -> BaseTables:
    """Run the three extracts on given inputs."""
    return BaseTables(
        *stage_tables(monthly=monthly_extract(raw), annual=annual_extract(raw), quarterly=quarterly_extract(raw))
    )
