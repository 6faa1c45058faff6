"""Stand-alone three-factor variant on classification flags.

It differs from the registry's chain in four ways: the universe comes from flags,
dates are calendar month ends, the 30/70 breakpoints are interpolated, and a
company needs a prior filing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from crosspanel.functions.dates import fiscal_june, month_end
from crosspanel.functions.scalars import book_equity_positive, safe_ratio
from crosspanel.operators.joins import link_join, usable_links
from crosspanel.operators.quantiles import Quantile, grouped_quantiles
from crosspanel.operators.sorts import LINEAR_30_70, SIX, assign_2x3, port_counts, port_means
from crosspanel.plans.extracts import FAR_END, standard_format
from crosspanel.plans.market import add_weights, collapse_companies, flag_universe
from crosspanel.session import stage_table
from crosspanel.sources.derived import RawTables


def flag_panel(msf: DataFrame, signed_price: bool = True) -> DataFrame:
    """Flag-universe panel on calendar month ends.

    The variant multiplies shares with the price as stored, whose sign may be negative;
    without ``signed_price`` the absolute value counts.
    """
    price = F.col("mthprc") if signed_price else F.abs("mthprc")
    d = flag_universe(msf).select(
        "permno",
        "permco",
        month_end(F.col("mthcaldt")).alias("jdate"),
        "primaryexch",
        F.coalesce("mthret", F.lit(0.0)).alias("mthret"),
        F.coalesce("mthretx", F.lit(0.0)).alias("mthretx"),
        (price * F.col("shrout")).alias("me"),
    )
    return add_weights(collapse_companies(d))


def company_book_equity(funda: DataFrame) -> DataFrame:
    """Positive book equity and the number of earlier filings per company."""
    be = book_equity_positive(F.col("seq"), F.col("txditc"), F.col("pstkrv"), F.col("pstkl"), F.col("pstk"))
    n = F.row_number().over(Window.partitionBy("gvkey").orderBy("datadate")) - 1
    return standard_format(funda).select("gvkey", "datadate", be.alias("be"), n.alias("filings"))


def labelled_months(raw: RawTables, signed_price: bool = True) -> DataFrame:
    panel = stage_table(flag_panel(raw.msf, signed_price), "flag-panel")
    anchor = fiscal_june(F.col("datadate"))
    linked = link_join(company_book_equity(raw.funda), usable_links(raw.links, FAR_END), anchor)
    linked = linked.select("permno", anchor.alias("jdate"), "be", "filings")
    june = panel.where((F.month("jdate") == 6) & F.col("dec_me").isNotNull()).join(linked, ["permno", "jdate"])
    june = stage_table(
        june.select("permno", "jdate", "primaryexch", "me", "filings", safe_ratio(F.col("be") * 1000.0, F.col("dec_me")).alias("beme")),
        "flag-june",
    )
    valid = (F.col("beme") > 0) & (F.col("me") > 0) & (F.col("filings") >= 1)
    sample = june.where(valid & (F.col("primaryexch") == "N"))
    size = grouped_quantiles(sample, ["jdate"], "me", [Quantile("sizemedn", 0.5, "linear")]).drop("n_obs")
    value = grouped_quantiles(sample, ["jdate"], "beme", LINEAR_30_70).drop("n_obs")
    june = assign_2x3(june.join(size, "jdate").join(value, "jdate"), valid=valid)
    labels = june.select("permno", F.year("jdate").alias("ffyear"), F.concat("szport", "chport").alias("port"))
    held = panel.select("permno", "ffyear", "jdate", "mthret", "wt").join(labels, ["permno", "ffyear"])
    return held.where((F.col("wt") > 0) & F.col("port").isNotNull())


def legacy_three_factor(raw: RawTables) -> DataFrame:
    six = labelled_months(raw).groupBy(F.col("jdate").alias("date")).agg(
        *port_means(F.col("port"), F.col("mthret"), F.col("wt"), SIX)
    )
    high, low = (F.col("BH") + F.col("SH")) / 2.0, (F.col("BL") + F.col("SL")) / 2.0
    small = (F.col("SL") + F.col("SM") + F.col("SH")) / 3.0
    big = (F.col("BL") + F.col("BM") + F.col("BH")) / 3.0
    return six.select("date", (high - low).alias("whml"), (small - big).alias("wsmb"))


def legacy_firm_counts(raw: RawTables) -> DataFrame:
    """Names per portfolio and rolled-up totals per date."""
    counts = labelled_months(raw).groupBy(F.col("jdate").alias("date")).agg(*port_counts(F.col("port"), SIX))
    c = {p: F.col(p) for p in SIX}
    out = counts.withColumns(
        {
            "hml": c["SH"] + c["BH"] + c["SL"] + c["BL"],
            "total": c["BL"] + c["BM"] + c["BH"] + c["SL"] + c["SM"] + c["SH"],
        }
    )
    return out.withColumnsRenamed({p: p.lower() for p in SIX})
