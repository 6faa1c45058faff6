"""Extracts, filters, projections and row windows on the security panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from catalog.registry import Tables, query
from catalog.sql_factors import labelled_june
from crosspanel.functions import dates as D, scalars as S
from crosspanel.functions.frames import by_entity, cumulative_product, rolling
from crosspanel.operators import joins as J, rows as R, sorts as P
from crosspanel.plans import extracts as X, factors as FA, market as M
from crosspanel.plans.factors import REGISTRY, payer_events, quarterly_characteristics
from crosspanel.plans.legacy import company_book_equity
from crosspanel.schemas import ANNUAL, QUARTERLY, SECURITY_MONTH, normalise_types, require_columns
from crosspanel.session import stage_table
from crosspanel.sources.store import ScanRequest, scan

c = F.col

# --- extracts ---------------------------------------------------------------------


@query("s01_monthly_extract", "SELECT * FROM t_monthly", digits=None)
def s01(t: Tables) -> DataFrame:
    return require_columns(X.monthly_extract(t.raw), SECURITY_MONTH.fieldNames(), "monthly extract")


_MONEY = "mthret mthretx shrout mthprc be currat act invt lct sale cogs che rect dp ppent ib at oancf xidoc dltt dcvt dlc emp xad xrd txt dvt sgr"


@query("s02_annual_extract", "SELECT * FROM t_annual", _MONEY, 6)
def s02(t: Tables) -> DataFrame:
    return require_columns(X.annual_extract(t.raw), ANNUAL.fieldNames(), "annual extract")


@query("s03_quarterly_extract", "SELECT * FROM t_quarterly", "ltq ibq dpq ppentq", 4)
def s03(t: Tables) -> DataFrame:
    return require_columns(X.quarterly_extract(t.raw), QUARTERLY.fieldNames(), "quarterly extract")


@query(
    "s04_parameterised_scan",
    "SELECT permno, mthcaldt, mthret FROM t_msf WHERE mthcaldt BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND permno > 10 AND primaryexch = 'N'",
    "mthret",
)
def s04(t: Tables) -> DataFrame:
    request = ScanRequest(
        "security_month", ("permno", "mthcaldt", "mthret"), "mthcaldt", "1997-01-01", "1998-12-31",
        {"permno": "> 10", "primaryexch": "= 'N'"},
    )
    return scan(t.raw.msf, request)


@query(
    "s13_type_normalisation",
    """SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_suppkey END AS permno, l_orderkey AS row_id, l_linenumber AS line,
      CASE WHEN l_linenumber <> 5 THEN l_extendedprice END AS mthprc, CASE WHEN l_linenumber <> 2 THEN l_shipdate::DATE END AS mthcaldt
      FROM lineitem""",
)
def s13(t: Tables) -> DataFrame:
    text = t.read("lineitem").select(
        F.when(c("l_linenumber") == 3, "n/a").otherwise(c("l_suppkey").cast("string")).alias("permno"),
        c("l_orderkey").alias("row_id"),
        c("l_linenumber").alias("line"),
        F.when(c("l_linenumber") == 5, "C").otherwise(c("l_extendedprice").cast("string")).alias("mthprc"),
        F.when(c("l_linenumber") == 2, "not a date").otherwise(c("l_shipdate").cast("string")).alias("mthcaldt"),
    )
    return normalise_types(text, SECURITY_MONTH)


@query(
    "s14_mixed_date_parse",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN date_trunc('month', o_orderdate)::DATE WHEN 3 THEN NULL ELSE o_orderdate::DATE END AS d FROM orders""",
)
def s14(t: Tables) -> DataFrame:
    d, k = c("o_orderdate"), c("o_orderkey") % 4
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.concat(F.lit(" "), F.date_format(d, "yyyyMMdd")))
        .when(k == 2, F.date_format(d, "yyyyMM"))
        .otherwise("pending")
    )
    return t.read("orders").select("o_orderkey", D.parse_mixed_date(text).alias("d"))


# --- projections and filters ---------------------------------------------------------


@query("p01_common_share_universe", "SELECT permno, mthcaldt, shrcd, exchcd FROM t_monthly WHERE shrcd IN (10, 11) AND exchcd IN (1, 2, 3)")
def p01(t: Tables) -> DataFrame:
    return M.common_share_universe(t.base.monthly).select("permno", "mthcaldt", "shrcd", "exchcd")


@query("p02_flag_universe", "SELECT permno, last_day(mthcaldt) AS jdate FROM t_msf JOIN (SELECT DISTINCT permno, jdate FROM t_flag_rows) f USING (permno) WHERE last_day(mthcaldt) = f.jdate")
def p02(t: Tables) -> DataFrame:
    return M.flag_universe(t.raw.msf).select("permno", F.last_day("mthcaldt").alias("jdate"))


@query("p03_standard_format", "SELECT gvkey, datadate FROM t_funda WHERE indfmt = 'INDL' AND datafmt = 'STD' AND popsrc = 'D' AND consol = 'C'")
def p03(t: Tables) -> DataFrame:
    return X.standard_format(t.raw.funda).select("gvkey", "datadate")


@query("p04_link_quality", "SELECT * FROM t_good_links")
def p04(t: Tables) -> DataFrame:
    return J.usable_links(t.raw.links, X.FAR_END)


@query("p05_positive_book_equity", "SELECT permno, ym, sic FROM t_annual WHERE be > 0 AND jdate_ltrd >= DATE '1997-01-01' - INTERVAL 25 MONTH AND jdate_ltrd <= DATE '2000-12-31'")
def p05(t: Tables) -> DataFrame:
    d = M.warm_window(t.base.annual, "jdate_ltrd", "1997-01-01", "2000-12-31", 25).where(c("be") > 0)
    return R.keep_last(d, ["permno", "ym"], ["jdate_ltrd", "datadate"]).select("permno", "ym", "sic")


@query("p06_exclude_financials", "SELECT permno, ym, sic FROM t_annual WHERE NOT (sic BETWEEN 6000 AND 6999)")
def p06(t: Tables) -> DataFrame:
    return t.base.annual.where(~c("sic").between(6000, 6999)).select("permno", "ym", "sic")


@query("p07_warm_window", "SELECT permno, mthcaldt FROM t_msf WHERE mthcaldt >= DATE '1998-07-01' - INTERVAL 25 MONTH AND mthcaldt <= DATE '1999-06-30'")
def p07(t: Tables) -> DataFrame:
    return M.warm_window(t.raw.msf, "mthcaldt", "1998-07-01", "1999-06-30", 25).select("permno", "mthcaldt")


@query("p08_penny_filter", "SELECT permno, jdate, prc FROM t_june WHERE prc >= 1", digits=None)
def p08(t: Tables) -> DataFrame:
    return M.june_rows(t.base.panel).where(c("prc") >= 1).select("permno", "jdate", "prc")


@query("p09_exchange_letters", "SELECT permno, mthcaldt, CASE exchcd WHEN 1 THEN 'N' WHEN 2 THEN 'A' WHEN 3 THEN 'Q' END AS primaryexch FROM t_monthly")
def p09(t: Tables) -> DataFrame:
    return M.with_exchange_letter(t.base.monthly.drop("primaryexch")).select("permno", "mthcaldt", "primaryexch")


@query("p10_industry_bucket", "SELECT permno, ym, floor(sic / 100)::INT AS sic2 FROM t_annual")
def p10(t: Tables) -> DataFrame:
    return t.base.annual.select("permno", "ym", S.industry_bucket(c("sic")).alias("sic2"))


@query(
    "p11_finite_values",
    "SELECT gvkey, datadate, CASE WHEN lct <> 0 THEN act / lct END AS x, CASE WHEN ib > 0 THEN ln(ib) END AS y FROM t_funda",
    "x y",
)
def p11(t: Tables) -> DataFrame:
    nan = F.lit(float("nan"))
    x = F.when(c("lct") == 0, F.lit(float("inf"))).otherwise(F.try_divide(c("act"), c("lct")))
    y = F.when(c("ib") > 0, F.log(c("ib"))).otherwise(nan)
    return t.raw.funda.select("gvkey", "datadate", S.finite(x).alias("x"), S.finite(y).alias("y"))


@query("p12_guarded_ratio", "SELECT gvkey, datadate, CASE WHEN abs(lct) > 1e-6::DOUBLE THEN (act - invt) / lct END AS quick FROM t_funda", "quick")
def p12(t: Tables) -> DataFrame:
    return t.raw.funda.select("gvkey", "datadate", S.safe_ratio(c("act") - c("invt"), c("lct"), 1e-6).alias("quick"))


@query(
    "p13_book_equity",
    """SELECT gvkey, datadate, nullif(seq + coalesce(txditc, 0) - coalesce(nullif(pstkrv, 0), nullif(pstkl, 0), nullif(pstk, 0), 0), 0) AS be,
      CASE WHEN seq + coalesce(txditc, 0) - coalesce(pstkrv, pstkl, pstk, 0) > 0 THEN seq + coalesce(txditc, 0) - coalesce(pstkrv, pstkl, pstk, 0) END AS be_positive
      FROM t_funda""",
    "be be_positive", 4,
)
def p13(t: Tables) -> DataFrame:
    items = [c(x) for x in ("seq", "txditc", "pstkrv", "pstkl", "pstk")]
    return t.raw.funda.select(
        "gvkey", "datadate", S.book_equity(*items).alias("be"), S.book_equity_positive(*items).alias("be_positive")
    )


@query("p14_current_ratio", "SELECT gvkey, datadate, CASE WHEN lct > 0 THEN act / lct END AS currat FROM t_funda", "currat")
def p14(t: Tables) -> DataFrame:
    return t.raw.funda.select("gvkey", "datadate", S.current_ratio(c("act"), c("lct")).alias("currat"))


@query("p15_industry_code", "SELECT f.gvkey, f.datadate, coalesce(sich, nullif(c.sic, '')::INT) AS sic FROM t_funda f LEFT JOIN t_company c USING (gvkey)")
def p15(t: Tables) -> DataFrame:
    return t.raw.funda.join(t.raw.company, "gvkey", "left").select("gvkey", "datadate", S.industry_code(c("sich"), c("sic")).alias("sic"))


@query("p16_market_equity", "SELECT permno, mthcaldt, abs(mthprc) * shrout AS me FROM t_msf", "me", 4)
def p16(t: Tables) -> DataFrame:
    return t.raw.msf.select("permno", "mthcaldt", S.market_equity(c("mthprc"), c("shrout")).alias("me"))


@query("p17_book_to_market", "SELECT p_permno AS permno, jdate, be * 1000 / dec_me AS beme FROM t_frame_annual", "beme", 6)
def p17(t: Tables) -> DataFrame:
    june = M.june_rows(t.base.panel).join(t.base.annual.select("permno", "ym", "be", "sic"), ["permno", "ym"])
    june = june.where((c("be") > 0) & ~c("sic").between(6000, 6999))
    return june.select("permno", "jdate", S.safe_ratio(c("be") * 1000.0, c("dec_me")).alias("beme"))


@query("p18_volume_adjustment", """SELECT permno, mthcaldt, vol / CASE WHEN exchcd = 3 AND mthcaldt < DATE '2001-02-01' THEN 2.0::DOUBLE
  WHEN exchcd = 3 AND mthcaldt < DATE '2002-01-01' THEN 1.8::DOUBLE WHEN exchcd = 3 AND mthcaldt < DATE '2004-01-01' THEN 1.6::DOUBLE ELSE 1 END AS vol_adj FROM t_monthly""", "vol_adj")
def p18(t: Tables) -> DataFrame:
    return t.base.monthly.select("permno", "mthcaldt", S.adjusted_volume(c("vol"), c("exchcd"), c("mthcaldt")).alias("vol_adj"))


@query("p19_liquidity_measures", "SELECT permno, jdate, turnover, ldolvol FROM t_liquidity", "turnover ldolvol")
def p19(t: Tables) -> DataFrame:
    return M.liquidity_panel(t.base.monthly).select("permno", "jdate", "turnover", "ldolvol")


@query("p23_long_short_leg", """SELECT l_suppkey AS signal, l_shipdate::DATE AS d, sum(CAST(l_quantity AS BIGINT))::DOUBLE / 100 AS ret
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2""", "ret")
def p23(t: Tables) -> DataFrame:
    d = t.read("lineitem").where(c("l_returnflag") == "R")
    d = d.groupBy(c("l_suppkey").alias("signal"), c("l_shipdate").cast("date").alias("d")).agg(F.sum(c("l_quantity").cast("long")).alias("q"))
    return d.select("signal", "d", (c("q").cast("double") / 100.0).alias("ret"))


@query("p24_spread_orientation", "SELECT permno, jdate, me - dec_me AS high_low, dec_me - me AS low_high FROM t_panel WHERE dec_me IS NOT NULL", "high_low low_high", 4)
def p24(t: Tables) -> DataFrame:
    d = t.base.panel.where(c("dec_me").isNotNull())
    return d.select(
        "permno", "jdate", S.orient(c("me"), c("dec_me"), "high_minus_low").alias("high_low"),
        S.orient(c("me"), c("dec_me"), "low_minus_high").alias("low_high"),
    )


@query("p25_column_aliases", 'SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_suppkey AS permno, l_quantity AS shares FROM lineitem')
def p25(t: Tables) -> DataFrame:
    d = t.read("lineitem").select("l_orderkey", "l_linenumber", c("l_suppkey").alias("PERM-No"), c("l_quantity").alias("Shr Out"))
    d = S.rename_by_alias(d, {"permno": ["perm_no"], "shares": ["shrout"], "orderkey": ["L_OrderKey"], "linenumber": ["l.linenumber"]})
    return S.normalise_columns(d)


# --- joins ----------------------------------------------------------------------------


@query("j01_left_equi_join", "SELECT a.permno, a.mthcaldt, b.vol FROM t_msf a LEFT JOIN t_volume b ON a.permno = b.permno AND a.mthcaldt = b.date")
def j01(t: Tables) -> DataFrame:
    vol = t.raw.volume.select("permno", c("date").alias("mthcaldt"), "vol")
    return t.raw.msf.select("permno", "mthcaldt").join(vol, ["permno", "mthcaldt"], "left")


@query("j02_interval_join", "SELECT a.permno, a.mthcaldt, n.shrcd, n.exchcd FROM t_msf a LEFT JOIN t_names n ON a.permno = n.permno AND a.mthcaldt BETWEEN n.namedt AND coalesce(n.nameendt, DATE '9999-12-31')")
def j02(t: Tables) -> DataFrame:
    left = t.raw.msf.select("permno", "mthcaldt")
    return J.interval_join(left, t.raw.names, ["permno"], "mthcaldt", "namedt", "nameendt", ["shrcd", "exchcd"])


@query("j02_open_orders_by_day", """SELECT flag, d, count(o.o_orderkey) AS open_orders, sum(o.o_orderkey)::BIGINT AS order_keys FROM (SELECT DISTINCT o_orderstatus AS flag, o_orderdate::DATE AS d FROM orders) k
  LEFT JOIN orders o ON o.o_orderstatus = flag AND d BETWEEN o.o_orderdate::DATE AND o.o_orderdate::DATE + (o.o_orderkey % 21)::INT GROUP BY 1, 2""")
def j02_dense(t: Tables) -> DataFrame:
    """Orders open on each day by status: a key has thousands of intervals."""
    orders = t.read("orders").select("o_orderstatus", "o_orderkey", c("o_orderdate").cast("date").alias("first"))
    spans = orders.select("o_orderstatus", "o_orderkey", "first", F.date_add("first", (c("o_orderkey") % 21).cast("int")).alias("last")).withColumnRenamed("o_orderstatus", "flag")
    days = orders.select(c("o_orderstatus").alias("flag"), c("first").alias("d")).distinct()
    met = J.banded_interval_join(days, spans, ["flag"], "d", "first", "last", ["o_orderkey"])
    return met.groupBy("flag", "d").agg(F.count("o_orderkey").alias("open_orders"), F.sum("o_orderkey").cast("long").alias("order_keys"))


@query("j03_link_join", "SELECT f.gvkey, l.permno, f.datadate FROM t_funda f JOIN t_good_links l USING (gvkey) WHERE make_date(year(f.datadate) + 1, 6, 30) BETWEEN l.linkdt AND l.linkenddt")
def j03(t: Tables) -> DataFrame:
    out = J.link_join(t.raw.funda.select("gvkey", "datadate"), J.usable_links(t.raw.links, X.FAR_END), D.fiscal_june(c("datadate")))
    return out.select("gvkey", "permno", "datadate")


@query("j04_asof_join", """SELECT permno, d, rdq, ltq FROM (
  SELECT m.permno, m.mthcaldt AS d, q.rdq, q.ltq, row_number() OVER (PARTITION BY m.permno, m.mthcaldt ORDER BY q.rdq DESC, q.datadate DESC, q.ltq DESC) AS rn
  FROM t_msf m JOIN (SELECT gvkey::BIGINT AS permno, rdq, datadate, ltq FROM t_fundq) q ON q.permno = m.permno AND q.rdq <= m.mthcaldt) x WHERE rn = 1""", "ltq", 2)
def j04(t: Tables) -> DataFrame:
    left = t.raw.msf.select("permno", c("mthcaldt").alias("d"))
    right = t.raw.fundq.select(c("gvkey").cast("long").alias("permno"), "rdq", "datadate", "ltq")
    return J.asof_join(left, right, ["permno"], "d", "rdq", ["datadate", "ltq"], ["rdq", "ltq"]).select("permno", "d", "rdq", "ltq")


@query("j04_asof_timestamps", """SELECT p.event_id, p.event_type, v.ts AS view_ts, v.view_id FROM events p
  ASOF JOIN (SELECT ts, event_type = 'view' AS is_view, max(event_id) AS view_id FROM events WHERE event_type = 'view' AND ts IS NOT NULL GROUP BY ts, event_type) v
  ON v.is_view = (p.event_type IS NOT NULL) AND p.ts >= v.ts WHERE p.event_type <> 'view'""")
def j04_timestamps(t: Tables) -> DataFrame:
    """The latest view of anybody before each other event: all rows share one key."""
    events = t.read("events")
    other = events.where(c("event_type") != "view").select("event_id", "event_type", "ts", F.lit(True).alias("k"))
    views = events.where(c("event_type") == "view").select(F.lit(True).alias("k"), c("ts").alias("view_ts"), c("event_id").alias("view_id"))
    out = J.asof_join(other, views, ["k"], "ts", "view_ts", ["view_id"], ["view_ts", "view_id"], ranges=True)
    return out.select("event_id", "event_type", "view_ts", "view_id")


@query("j05_left_join_company", "SELECT gvkey, f.datadate, c.sic FROM t_funda f LEFT JOIN t_company c USING (gvkey)")
def j05(t: Tables) -> DataFrame:
    return t.raw.funda.select("gvkey", "datadate").join(t.raw.company, "gvkey", "left")


@query("j06_anchor_join", "SELECT m.permno, m.ym, c.datadate FROM t_msf m JOIN t_anchors c ON m.permno = c.permno AND m.ym = c.ym")
def j06(t: Tables) -> DataFrame:
    m = t.raw.msf.select("permno", "ym")
    return m.join(X.annual_anchors(t.raw).select("permno", "ym", "datadate"), ["permno", "ym"])


@query("j07_june_join", "SELECT j.permno, j.ym, j.me, a.be FROM t_june j JOIN t_annual a ON j.permno = a.permno AND j.ym = a.ym", "me be", 4)
def j07(t: Tables) -> DataFrame:
    june = M.june_rows(t.base.panel).select("permno", "ym", "me")
    return june.join(t.base.annual.select("permno", "ym", "be"), ["permno", "ym"])


@query("j08_semi_join", "SELECT permno, ym, me FROM t_june j WHERE EXISTS (SELECT 1 FROM t_annual a WHERE a.permno = j.permno AND a.ym = j.ym AND a.be > 0)", "me", 4)
def j08(t: Tables) -> DataFrame:
    keys = t.base.annual.where(c("be") > 0).select("permno", "ym")
    return M.june_rows(t.base.panel).select("permno", "ym", "me").join(keys, ["permno", "ym"], "left_semi")


@query("j09_december_equity", "SELECT permno, jdate, dec_me FROM t_june", "dec_me", 4)
def j09(t: Tables) -> DataFrame:
    return M.june_rows(t.base.panel).select("permno", "jdate", "dec_me")


@query("j10_base_weights", "SELECT permno, jdate, mebase, wt FROM t_panel", "mebase wt", 4)
def j10(t: Tables) -> DataFrame:
    return t.base.panel.select("permno", "jdate", "mebase", "wt")


_SORTED = """SELECT p.*, s.med, b.q30, b.q70 FROM t_panel p LEFT JOIN (SELECT jdate, median(me) AS med FROM t_panel WHERE primaryexch = 'N' AND me > 0 GROUP BY 1) s USING (jdate)
  LEFT JOIN (SELECT jdate, max(v) FILTER (WHERE rn = round_even((n - 1) * 0.3::DOUBLE, 0) + 1) AS q30, max(v) FILTER (WHERE rn = round_even((n - 1) * 0.7::DOUBLE, 0) + 1) AS q70
  FROM (SELECT jdate, prc AS v, row_number() OVER (PARTITION BY jdate ORDER BY prc) AS rn, count(*) OVER (PARTITION BY jdate) AS n FROM t_panel WHERE primaryexch = 'N') r GROUP BY 1) b USING (jdate)"""


@query("j11_breakpoint_join", f"SELECT permno, jdate, med, q30, q70 FROM ({_SORTED}) x", "med q30 q70", 4)
def j11(t: Tables) -> DataFrame:
    return _sorted_panel(t).select("permno", "jdate", c("size_med").alias("med"), c("prc_q30").alias("q30"), c("prc_q70").alias("q70"))


@query("j12_labels_held_a_year", f"SELECT p.permno, p.jdate, l.port FROM t_panel p LEFT JOIN ({labelled_june('saleinv')}) l ON p.permno = l.permno AND p.ffyear = l.ffyear")
def j12(t: Tables) -> DataFrame:
    spec = REGISTRY["saleinv"]
    june = FA.june_frame(t.base, t.base.panel.withColumn("first_month", F.lit(None).cast("int")), [spec])
    labels = FA.june_labels(stage_table(june, "june"), [spec]).drop("jdate")
    held = t.base.panel.select("permno", "ffyear", "jdate").join(labels, ["permno", "ffyear"], "left")
    return held.select("permno", "jdate", F.get("labels", F.lit(0))["port"].alias("port"))


@query("j17_reindex", "SELECT k.date, x.n FROM t_calendar k LEFT JOIN (SELECT jdate AS date, count(*) AS n FROM t_june GROUP BY 1) x USING (date)")
def j17(t: Tables) -> DataFrame:
    counts = M.june_rows(t.base.panel).groupBy(c("jdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return J.reindex(counts, J.month_calendar(t.base.panel, "jdate"))


@query("j18_company_collapse", "SELECT permno, permco, jdate, me FROM t_company_rows", "me", 4)
def j18(t: Tables) -> DataFrame:
    d = M.common_share_universe(t.base.monthly).select(
        "permno", "permco", c("mthcaldt").alias("jdate"), S.market_equity(c("mthprc"), c("shrout")).alias("me")
    )
    return M.collapse_companies(d)


_UNPRICED = "CASE WHEN permno % 2 = 0 OR (permno + month(mthcaldt)) % 5 = 0 THEN NULL ELSE mthprc END"


@query("j18_unpriced_companies", f"""SELECT r.permno, r.permco, r.jdate, coalesce(s.total, 0) AS me
  FROM (SELECT permno, permco, mthcaldt AS jdate, abs({_UNPRICED}) * shrout AS me FROM t_monthly WHERE shrcd IN (10, 11) AND exchcd IN (1, 2, 3)) r
  JOIN (SELECT permco, mthcaldt AS jdate, sum(abs({_UNPRICED}) * shrout) AS total, max(abs({_UNPRICED}) * shrout) AS most FROM t_monthly WHERE shrcd IN (10, 11) AND exchcd IN (1, 2, 3) GROUP BY 1, 2) s
  ON r.permco = s.permco AND r.jdate = s.jdate WHERE r.me IS NOT DISTINCT FROM s.most""", "me", 4)
def j18_unpriced(t: Tables) -> DataFrame:
    """Companies keep their row in a month in which none of their securities has a price."""
    unpriced = (c("permno") % 2 == 0) | ((c("permno") + F.month("mthcaldt")) % 5 == 0)
    d = M.common_share_universe(t.base.monthly.withColumn("mthprc", F.when(~unpriced, c("mthprc")))).select(
        "permno", "permco", c("mthcaldt").alias("jdate"), S.market_equity(c("mthprc"), c("shrout")).alias("me")
    )
    return M.collapse_companies(d)


@query("j19_fallback_breakpoints", """SELECT a.jdate, coalesce(n.q30, a.q30) AS q30, coalesce(n.q70, a.q70) AS q70 FROM
  (SELECT jdate, max(v) FILTER (WHERE rn = round_even((n - 1) * 0.3::DOUBLE, 0) + 1) AS q30, max(v) FILTER (WHERE rn = round_even((n - 1) * 0.7::DOUBLE, 0) + 1) AS q70
   FROM (SELECT jdate, prc AS v, row_number() OVER (PARTITION BY jdate ORDER BY prc) AS rn, count(*) OVER (PARTITION BY jdate) AS n FROM t_panel) r GROUP BY 1) a LEFT JOIN
  (SELECT jdate, max(v) FILTER (WHERE rn = round_even((n - 1) * 0.3::DOUBLE, 0) + 1) AS q30, max(v) FILTER (WHERE rn = round_even((n - 1) * 0.7::DOUBLE, 0) + 1) AS q70
   FROM (SELECT jdate, prc AS v, row_number() OVER (PARTITION BY jdate ORDER BY prc) AS rn, count(*) OVER (PARTITION BY jdate) AS n FROM t_panel
     WHERE primaryexch = 'N' AND month(jdate) % 2 = 0) r GROUP BY 1) n USING (jdate)""", "q30 q70")
def j19(t: Tables) -> DataFrame:
    # Odd months have no exchange N name under this code, so they fall back.
    d = t.base.panel.select("jdate", "prc", F.when(F.month("jdate") % 2 == 0, c("primaryexch")).alias("primaryexch"))
    return P.quantiles_with_fallback(d, "prc")


# --- breakpoints, buckets, portfolio returns -----------------------------------------------


@query("a01_size_median", "SELECT jdate, median(me) AS sizemedn FROM t_panel WHERE primaryexch = 'N' AND me > 0 GROUP BY 1", "sizemedn", 4)
def a01(t: Tables) -> DataFrame:
    return P.size_median(t.base.panel)


_NEAR = """SELECT jdate, max(v) FILTER (WHERE rn = round_even((n - 1) * 0.3::DOUBLE, 0) + 1) AS q30, max(v) FILTER (WHERE rn = round_even((n - 1) * 0.7::DOUBLE, 0) + 1) AS q70
  FROM (SELECT jdate, me AS v, row_number() OVER (PARTITION BY jdate ORDER BY me) AS rn, count(*) OVER (PARTITION BY jdate) AS n FROM t_panel WHERE {}) r GROUP BY 1"""


@query("a02_nearest_quantiles", _NEAR.format("primaryexch = 'N'"), "q30 q70", 4)
def a02(t: Tables) -> DataFrame:
    return P.exchange_quantiles(t.base.panel, "me")


@query("a03_linear_quantiles", "SELECT jdate, quantile_cont(me, 0.3) AS q30, quantile_cont(me, 0.7) AS q70 FROM t_panel WHERE primaryexch = 'N' GROUP BY 1", "q30 q70", 4)
def a03(t: Tables) -> DataFrame:
    return P.exchange_quantiles(t.base.panel, "me", quantiles=P.LINEAR_30_70)


@query("a04_whole_sample_quantiles", _NEAR.format("TRUE"), "q30 q70", 4)
def a04(t: Tables) -> DataFrame:
    return P.exchange_quantiles(t.base.panel, "me", exch=None)


def _sorted_panel(t: Tables) -> DataFrame:
    d = t.base.panel.select("permno", "jdate", "primaryexch", "me", "prc", "mthret", "wt", "ffmonth")
    bp = P.wide_breakpoints(d, {"size": ((c("primaryexch") == "N") & (c("me") > 0), c("me")), "prc": (c("primaryexch") == "N", c("prc"))}, medians=["size"])
    return d.join(bp, "jdate", "left")


@query("a05_assign_2x3", f"""SELECT permno, jdate, CASE WHEN me <= med THEN 'S' WHEN me > med THEN 'B' END AS szport,
  CASE WHEN prc <= q30 THEN 'L' WHEN prc <= q70 THEN 'M' WHEN prc > q70 THEN 'H' END AS chport FROM ({_SORTED}) x""")
def a05(t: Tables) -> DataFrame:
    d = P.assign_2x3(_sorted_panel(t), value="prc", median="size_med", q30="prc_q30", q70="prc_q70")
    return d.select("permno", "jdate", "szport", "chport")


@query("a06_assign_tails", f"SELECT permno, jdate, CASE WHEN prc <= q30 THEN 'L' WHEN prc >= q70 THEN 'H' END AS port FROM ({_SORTED}) x")
def a06(t: Tables) -> DataFrame:
    return _sorted_panel(t).select("permno", "jdate", P.tail_bucket(c("prc"), c("prc_q30"), c("prc_q70")).alias("port"))


@query("a07_assign_flag", f"SELECT permno, jdate, CASE WHEN me <= med THEN 'S' WHEN me > med THEN 'B' END || CASE WHEN ffmonth <= 6 THEN 'H' ELSE 'L' END AS port FROM ({_SORTED}) x")
def a07(t: Tables) -> DataFrame:
    port = F.concat(P.size_bucket(c("me"), c("size_med")), P.flag_bucket(c("ffmonth") <= 6))
    return _sorted_panel(t).select("permno", "jdate", port.alias("port"))


_A08 = ", ".join(f"sum(mthret * wt) FILTER (WHERE port = '{p}') / sum(wt) FILTER (WHERE port = '{p}') AS \"{p}\"" for p in P.SIX)


@query("a08_value_weighted_returns", f"""SELECT jdate, {_A08} FROM (SELECT jdate, mthret, wt,
  (CASE WHEN me <= med THEN 'S' ELSE 'B' END) || CASE WHEN prc <= q30 THEN 'L' WHEN prc <= q70 THEN 'M' ELSE 'H' END AS port FROM ({_SORTED}) x WHERE wt > 0) y GROUP BY 1""", " ".join(P.SIX))
def a08(t: Tables) -> DataFrame:
    d = P.assign_2x3(_sorted_panel(t), value="prc", median="size_med", q30="prc_q30", q70="prc_q70")
    return P.value_weighted_returns(d)


@query("a09_two_leg_spread", f"""SELECT jdate, sum(mthret * wt) FILTER (WHERE prc > q30 AND prc >= q70) / sum(wt) FILTER (WHERE prc > q30 AND prc >= q70)
  - sum(mthret * wt) FILTER (WHERE prc <= q30) / sum(wt) FILTER (WHERE prc <= q30) AS spread FROM ({_SORTED}) x WHERE wt > 0 GROUP BY 1""", "spread")
def a09(t: Tables) -> DataFrame:
    d = _sorted_panel(t).where(c("wt") > 0).withColumn("port", P.tail_bucket(c("prc"), c("prc_q30"), c("prc_q70")))
    legs = d.groupBy("jdate").agg(*P.port_means(c("port"), c("mthret"), c("wt"), P.TAILS))
    return legs.select("jdate", S.orient(c("H"), c("L"), "high_minus_low").alias("spread"))


@query("a10_event_spread", """SELECT jdate, sum(mthret * wt) FILTER (WHERE ev) / sum(wt) FILTER (WHERE ev) - sum(mthret * wt) FILTER (WHERE NOT ev) / sum(wt) FILTER (WHERE NOT ev) AS spread
  FROM (SELECT *, prc > 1400 AS ev FROM t_panel WHERE wt > 0) x GROUP BY 1""", "spread")
def a10(t: Tables) -> DataFrame:
    d = t.base.panel.where(c("wt") > 0).withColumn("port", F.when(c("prc") > 1400, "E").otherwise("N"))
    legs = d.groupBy("jdate").agg(*P.port_means(c("port"), c("mthret"), c("wt"), P.EVENT))
    return legs.select("jdate", (c("E") - c("N")).alias("spread"))


@query("a12_industry_demeaned", """SELECT permno, ym, sale - median(sale) OVER (PARTITION BY jdate_ltrd, floor(sic / 100)) AS sale_ia, emp - median(emp) OVER (PARTITION BY jdate_ltrd, floor(sic / 100)) AS emp_ia
  FROM t_annual WHERE sic IS NOT NULL UNION ALL SELECT permno, ym, NULL, NULL FROM t_annual WHERE sic IS NULL""", "sale_ia emp_ia", 4)
def a12(t: Tables) -> DataFrame:
    d = t.base.annual.select("permno", "ym", "jdate_ltrd", "sic", c("sale").alias("sale_ia"), c("emp").alias("emp_ia"))
    return FA.demean_by_industry(d, ["sale_ia", "emp_ia"], date="jdate_ltrd").select("permno", "ym", "sale_ia", "emp_ia")


@query("a13_month_calendar", "SELECT max(l_shipdate::DATE) AS date FROM lineitem GROUP BY date_trunc('month', l_shipdate)")
def a13(t: Tables) -> DataFrame:
    return J.month_calendar(t.read("lineitem").select(c("l_shipdate").cast("date").alias("d")), "d")


@query("a14_first_month", "SELECT permno, min(year(mthcaldt) * 12 + month(mthcaldt))::INT AS first_month FROM t_msf GROUP BY 1")
def a14(t: Tables) -> DataFrame:
    return t.raw.msf.groupBy("permno").agg(F.min(D.month_number(c("mthcaldt"))).alias("first_month"))


@query("a15_event_flag", "SELECT permno, ffyear::INT AS ffyear, coalesce(divi, FALSE) AS starts_paying, coalesce(divo, FALSE) AS stops_paying FROM t_payers")
def a15(t: Tables) -> DataFrame:
    return payer_events(t.base.annual)


@query("a16_duplicate_collapse", "SELECT l_suppkey AS k, l_shipdate::DATE AS d, count(*) AS n_rows, avg(l_discount) AS x FROM lineitem GROUP BY 1, 2", "x")
def a16(t: Tables) -> DataFrame:
    d = t.read("lineitem").select(c("l_suppkey").alias("k"), c("l_shipdate").cast("date").alias("d"), c("l_discount").alias("x"))
    return R.duplicates(d, ["k", "d"], "x")


# --- row windows -----------------------------------------------------------------------


@query("w01_lag_growth", "SELECT gvkey, datadate, sgr FROM t_annual_core", "sgr")
def w01(t: Tables) -> DataFrame:
    return X.annual_core(t.raw.funda, t.raw.company).select("gvkey", "datadate", "sgr")


@query("w02_latest_per_month", "SELECT permno, ym, datadate, gvkey FROM t_anchors")
def w02(t: Tables) -> DataFrame:
    return X.annual_anchors(t.raw).select("permno", "ym", "datadate", "gvkey")


@query("w03_asof_pick", """SELECT m.permno, m.ym, q.rdq, q.datadate FROM t_msf m
  ASOF JOIN (SELECT gvkey::BIGINT AS permno, rdq, max(datadate) AS datadate FROM t_fundq WHERE rdq IS NOT NULL GROUP BY 1, 2) q ON q.permno = m.permno AND m.mthcaldt >= q.rdq""")
def w03(t: Tables) -> DataFrame:
    """Latest report known at the trading date, however old."""
    q = t.raw.fundq.where(c("rdq").isNotNull()).select(c("gvkey").cast("long").alias("permno"), "rdq", "datadate")
    m = t.raw.msf.select("permno", "ym", "mthcaldt")
    return J.asof_join(m, q, ["permno"], "mthcaldt", "rdq", ["datadate"], ["rdq", "datadate"]).select("permno", "ym", "rdq", "datadate")


@query("w04_keep_last", "SELECT o_custkey, o_orderdate::DATE AS d, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1")
def w04(t: Tables) -> DataFrame:
    d = t.read("orders").select("o_custkey", c("o_orderdate").cast("date").alias("d"), "o_orderkey")
    return R.keep_last(d, ["o_custkey"], ["d", "o_orderkey"])


@query("w05_cumulative_product", "SELECT permno, jdate, cumretx FROM t_panel", "cumretx")
def w05(t: Tables) -> DataFrame:
    d = t.base.panel.select("permno", "jdate", "ffyear", (1.0 + c("mthretx")).alias("g"))
    return d.select("permno", "jdate", cumulative_product(c("g"), by_entity(["permno", "ffyear"], "jdate")).alias("cumretx"))


@query("w06_lag_row", "SELECT permno, jdate, lag(me) OVER (PARTITION BY permno ORDER BY jdate) AS me_lag FROM t_panel", "me_lag", 4)
def w06(t: Tables) -> DataFrame:
    return t.base.panel.select("permno", "jdate", F.lag("me").over(by_entity("permno", "jdate")).alias("me_lag"))


@query("w07_seeded_lag", "SELECT permno, jdate, lme FROM t_panel", "lme", 4)
def w07(t: Tables) -> DataFrame:
    w = by_entity("permno", "jdate")
    seeded = F.when(F.row_number().over(w) == 1, c("me") / (1.0 + c("mthretx"))).otherwise(F.lag("me").over(w))
    return t.base.panel.select("permno", "jdate", seeded.alias("lme"))


@query("w08_w09_momentum", "SELECT permno, jdate, mom6m, mom36m FROM t_momentum", "mom6m mom36m")
def w08(t: Tables) -> DataFrame:
    return M.momentum_panel(t.base.panel).select("permno", "jdate", "mom6m", "mom36m")


@query("w10_w12_liquidity_windows", "SELECT permno, jdate, turn, dolvol, std_dolvol, std_turn FROM t_liquidity", "turn dolvol std_dolvol std_turn")
def w10(t: Tables) -> DataFrame:
    return M.liquidity_panel(t.base.monthly).select("permno", "jdate", "turn", "dolvol", "std_dolvol", "std_turn")


@query("w13_w14_trailing_quarters", "SELECT q.permno, q.ym, t.ttm_ibq, t.ttm_dpq, t.ltq_l4 FROM t_quarterly q LEFT JOIN t_ttm t USING (permno, datadate)", "ttm_ibq ttm_dpq ltq_l4", 2)
def w13(t: Tables) -> DataFrame:
    return quarterly_characteristics(t.base.quarterly).select("permno", "ym", "ttm_ibq", "ttm_dpq", "ltq_l4")


@query("w15_anchor_lag", "SELECT permno, ym, lag_currat, lag_at, CASE WHEN abs(lag_currat) > 0 THEN currat / lag_currat - 1 END AS pchcurrat FROM t_chars", "lag_currat lag_at pchcurrat", 6)
def w15(t: Tables) -> DataFrame:
    w = by_entity("permno", "ym")
    lag = F.lag("currat").over(w)
    return t.base.annual.select(
        "permno", "ym", lag.alias("lag_currat"), F.lag("at").over(w).alias("lag_at"), S.pct_change(c("currat"), lag).alias("pchcurrat")
    )


@query("w16_status_change", """SELECT permno, datadate, pays AND NOT coalesce(before, TRUE) AS starts, NOT pays AND coalesce(before, FALSE) AS stops FROM
  (SELECT *, lag(pays) OVER (PARTITION BY permno ORDER BY datadate) AS before FROM (SELECT permno, datadate, coalesce(dvt > 0, FALSE) AS pays FROM t_annual) x) y""")
def w16(t: Tables) -> DataFrame:
    d = t.base.annual.select("permno", "datadate", F.coalesce(c("dvt") > 0, F.lit(False)).alias("pays"))
    before = F.lag("pays").over(by_entity("permno", "datadate"))
    return d.select(
        "permno", "datadate", (c("pays") & ~F.coalesce(before, F.lit(True))).alias("starts"),
        (~c("pays") & F.coalesce(before, F.lit(False))).alias("stops"),
    )


@query("w20_age_months", "SELECT permno, mthcaldt, (year(mthcaldt) * 12 + month(mthcaldt) - min(year(mthcaldt) * 12 + month(mthcaldt)) OVER (PARTITION BY permno))::INT AS age FROM t_msf")
def w20(t: Tables) -> DataFrame:
    n = D.month_number(c("mthcaldt"))
    return t.raw.msf.select("permno", "mthcaldt", (n - F.min(n).over(Window.partitionBy("permno"))).alias("age"))


@query("w21_filing_count", "SELECT gvkey, datadate, (row_number() OVER (PARTITION BY gvkey ORDER BY datadate) - 1)::INT AS filings FROM t_funda WHERE indfmt = 'INDL'")
def w21(t: Tables) -> DataFrame:
    return company_book_equity(t.raw.funda).select("gvkey", "datadate", "filings")


# --- sorts and set operations ---------------------------------------------------------------


@query("o01_ordered_output", "SELECT permno, mthcaldt, mthret FROM t_msf ORDER BY mthcaldt, permno", "mthret")
def o01(t: Tables) -> DataFrame:
    return t.raw.msf.select("permno", "mthcaldt", "mthret").orderBy("mthcaldt", "permno")


@query("o04_union_all", """SELECT permno, mthcaldt, mthret, NULL::DOUBLE AS vol FROM t_msf UNION ALL SELECT permno, date, NULL, vol FROM t_volume""", "mthret vol")
def o04(t: Tables) -> DataFrame:
    return R.stack_tables([t.raw.msf.select("permno", "mthcaldt", "mthret"), t.raw.volume.withColumnRenamed("date", "mthcaldt")])


@query("o05_exact_duplicates", "SELECT DISTINCT l_suppkey, l_returnflag, l_quantity FROM lineitem")
def o05(t: Tables) -> DataFrame:
    return t.read("lineitem").select("l_suppkey", "l_returnflag", "l_quantity").dropDuplicates()


@query("o06_union_sets", "SELECT permno FROM t_names WHERE shrcd = 12 UNION SELECT lpermno FROM t_links WHERE linkprim = 'J'")
def o06(t: Tables) -> DataFrame:
    a = t.raw.names.where(c("shrcd") == 12).select("permno")
    return R.union_sets(a, t.raw.links.where(c("linkprim") == "J").select(c("lpermno").alias("permno")))


@query("o07_common_rows", "SELECT permno FROM t_names INTERSECT SELECT lpermno FROM t_links WHERE linktype = 'LC'")
def o07(t: Tables) -> DataFrame:
    return R.common_rows(t.raw.names.select("permno"), t.raw.links.where(c("linktype") == "LC").select(c("lpermno").alias("permno")))


@query("o08_set_difference", """SELECT permno, 'missing' AS status FROM (SELECT lpermno AS permno FROM t_links WHERE linktype = 'LC' EXCEPT SELECT permno FROM t_names WHERE shrcd = 11)
  UNION ALL SELECT permno, 'extra' FROM (SELECT permno FROM t_names WHERE shrcd = 11 EXCEPT SELECT lpermno FROM t_links WHERE linktype = 'LC')""")
def o08(t: Tables) -> DataFrame:
    have = t.raw.names.where(c("shrcd") == 11).select("permno")
    return R.missing_and_extra(have, t.raw.links.where(c("linktype") == "LC").select(c("lpermno").alias("permno")), "permno")
