"""DuckDB statements for the factor catalogue, written independently of the plans."""

from __future__ import annotations

from catalog.sql_tables import table, with_tables

table("t_june", "SELECT * FROM t_panel WHERE month(jdate) = 6 AND dec_me IS NOT NULL")

table("t_first", """
SELECT permno, min(year(jdate) * 12 + month(jdate)) AS first_month FROM t_panel WHERE wt IS NOT NULL GROUP BY 1
""")

table("t_chars", """
SELECT *, lag(currat) OVER w AS lag_currat, lag(quick) OVER w AS lag_quick, lag(saleinv) OVER w AS lag_saleinv,
  lag(gm) OVER w AS lag_gm, lag(sale) OVER w AS lag_sale, lag(deprate) OVER w AS lag_deprate, lag("at") OVER w AS lag_at
FROM (SELECT *, (act - invt) / nullif(lct, 0) AS quick, sale / nullif(invt, 0) AS saleinv, sale - cogs AS gm,
        dp / nullif(ppent, 0) AS deprate FROM t_annual) x
WINDOW w AS (PARTITION BY permno ORDER BY ym)
""")

table("t_ttm", """
SELECT permno, datadate,
  CASE WHEN count(ibq) OVER w4 >= 4 THEN sum(ibq) OVER w4 END AS ttm_ibq,
  CASE WHEN count(dpq) OVER w4 >= 4 THEN sum(dpq) OVER w4 END AS ttm_dpq,
  lag(ltq, 4) OVER (PARTITION BY permno ORDER BY datadate) AS ltq_l4
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY permno, datadate ORDER BY rdq DESC, ym DESC) AS rn FROM t_quarterly) q WHERE rn = 1) o
WINDOW w4 AS (PARTITION BY permno ORDER BY datadate ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
""")

NOT_FIN = "NOT ({} BETWEEN 6000 AND 6999)"

table("t_frame_annual", f"""
SELECT j.permno AS p_permno, j.jdate, j.primaryexch, j.me, j.dec_me, j.prc, a.*,
  lag(a.emp) OVER w AS june_lag_emp, lag(a.invt) OVER w AS june_lag_invt, lag(a.txt) OVER w AS june_lag_txt,
  lag(a."at") OVER w AS june_lag_at, floor(a.sic / 100)::INT AS sic2
FROM t_june j JOIN t_chars a ON j.permno = a.permno AND j.ym = a.ym
WHERE a.be > 0 AND {NOT_FIN.format('a.sic')}
WINDOW w AS (PARTITION BY j.permno ORDER BY j.jdate)
""")

table("t_frame_quarterly", f"""
SELECT j.jdate, j.primaryexch, j.me, j.dec_me, q.*, t.ttm_ibq, t.ttm_dpq, t.ltq_l4
FROM t_june j JOIN t_quarterly q ON j.permno = q.permno AND j.ym = q.ym
JOIN t_annual a ON j.permno = a.permno AND j.ym = a.ym
LEFT JOIN t_ttm t ON q.permno = t.permno AND q.datadate = t.datadate
WHERE a.be > 0 AND {NOT_FIN.format('q.sic')}
""")

table("t_frame_price", "SELECT * FROM t_frame_annual WHERE prc >= 1")
table("t_frame_beme", "SELECT *, be * 1000.0 / nullif(dec_me, 0) AS beme FROM t_frame_annual WHERE dec_me <> 0")
table("t_frame_everyone", "SELECT j.*, f.first_month FROM t_june j LEFT JOIN t_first f USING (permno)")

EPS = "1e-6::DOUBLE"


def guarded(num: str, den: str, eps: bool = False) -> str:
    return f"CASE WHEN abs({den}) > {EPS if eps else '0'} THEN ({num}) / ({den}) END"


def change(x: str, before: str, eps: bool = False) -> str:
    return f"({guarded(x, before, eps)} - 1)"


def industry(v: str) -> str:
    return f"({v}) - median({v}) OVER (PARTITION BY jdate, sic2)"


# frame, value, orientation (+1 high minus low, -1 low minus high), extra sample and label conditions
JUNE: dict[str, dict] = {
    "smb_ff93": dict(frame="beme", v="beme", spread="size", sample="v > 0", valid="v > 0 AND currat IS NOT NULL"),
    "hml_ff93": dict(frame="beme", v="beme", sign=1, sample="v > 0", valid="v > 0 AND currat IS NOT NULL"),
    "currat_2x3": dict(frame="beme", v="currat", sign=-1, out="currat"),
    "pchcurrat": dict(v=change("currat", "lag_currat"), sign=-1),
    "quick_2x3": dict(v="quick", sign=-1, out="quick"),
    "pchquick": dict(v=change("quick", "lag_quick"), sign=-1),
    "pchsaleinv": dict(v=change("saleinv", "lag_saleinv"), sign=-1),
    "pchgm_pchsale": dict(v=f"{change('gm', 'lag_gm', True)} - {change('sale', 'lag_sale', True)}", sign=1, fallback=True),
    "pchdepr": dict(v=change("deprate", "lag_deprate"), sign=1),
    "saleinv": dict(v="saleinv", sign=1),
    "salecash": dict(v=guarded("sale", "che"), sign=1),
    "salerec": dict(v=guarded("sale", "rect"), sign=1),
    "acc": dict(v=guarded("ib - oancf", '(("at" + lag_at) / 2)'), sign=-1),
    "lev_2x3": dict(frame="quarterly", v=guarded("ltq * 1000.0", "me"), sign=1, out="lev"),
    "pps": dict(frame="price", v="1 / prc", sign=1),
    "cashdebt": dict(frame="quarterly", v=guarded("ttm_ibq + ttm_dpq", "((ltq + ltq_l4) / 2)"), sign=1),
    "depr": dict(frame="quarterly", v=guarded("ttm_dpq", "ppentq"), sign=1),
    "convind": dict(v="CASE WHEN coalesce(dcvt, 0) > 0 THEN 1 ELSE 0 END", sign=-1, flag=True, zero=True),
    "IPO": dict(frame="everyone", v="CASE WHEN year(jdate) * 12 + month(jdate) - first_month < 60 THEN 1 ELSE 0 END", sign=1, flag=True),
    "cfp_ia": dict(v=industry(guarded("coalesce(oancf, ib + dp)", "dec_me", True)), sign=1),
    "chempia": dict(v=industry(change("emp", "june_lag_emp")), sign=-1),
    "mve_ia": dict(v=industry("ln(me)"), sign=-1),
    "adm": dict(v=guarded("xad", "dec_me", True), sign=-1),
    "rdm": dict(v=guarded("xrd", "dec_me", True), sign=1),
    "rds": dict(v=guarded("xrd", "sale", True), sign=1),
    "chinv": dict(v=guarded("invt - june_lag_invt", "june_lag_at"), sign=-1),
    "chtx": dict(v=guarded("txt - june_lag_txt", "june_lag_at"), sign=1),
}


def nearest(sample: str, date: str = "jdate") -> str:
    """q30/q70 per date of the rows (date, v): order statistic at the rounded position."""
    return f"""
SELECT {date}, max(v) FILTER (WHERE rn = round_even((n - 1) * 0.3::DOUBLE, 0) + 1) AS q30,
  max(v) FILTER (WHERE rn = round_even((n - 1) * 0.7::DOUBLE, 0) + 1) AS q70
FROM (SELECT {date}, v, row_number() OVER (PARTITION BY {date} ORDER BY v) AS rn, count(*) OVER (PARTITION BY {date}) AS n
      FROM ({sample}) s WHERE v IS NOT NULL) r
GROUP BY 1"""


VW = "sum(mthret * wt) FILTER (WHERE port = '{0}') / sum(wt) FILTER (WHERE port = '{0}')"


def six_spread(sign: int | None, size: bool = False, zero: bool = False) -> str:
    p = {n: f"({VW.format(n)})" for n in ("SL", "SM", "SH", "BL", "BM", "BH")}
    if size:
        return f"({p['SL']} + {p['SM']} + {p['SH']}) / 3 - ({p['BL']} + {p['BM']} + {p['BH']}) / 3"
    high, low = f"(({p['BH']} + {p['SH']}) / 2)", f"(({p['BL']} + {p['SL']}) / 2)"
    out = f"{high} - {low}" if sign == 1 else f"{low} - {high}"
    return f"CASE WHEN {high} IS NULL AND {low} IS NOT NULL THEN 0 ELSE {out} END" if zero else out


def rounded(name: str, source: str, calendar: str = "t_calendar") -> str:
    return (
        f'SELECT k.date, round(f.x, 8) + 0.0::DOUBLE AS "{name}" FROM (SELECT date FROM {calendar}) k '
        f"LEFT JOIN ({source}) f ON k.date = f.jdate"
    )


def labelled_june(key: str) -> str:
    d = JUNE[key]
    frame = f"SELECT *, {d['v']} AS v FROM t_frame_{d.get('frame', 'annual')}"
    everyone = d.get("frame") == "everyone"
    nyse = "TRUE" if everyone else "primaryexch = 'N'"
    size = f"SELECT jdate, median(me) AS med FROM fr WHERE me > 0 AND {nyse} GROUP BY 1"
    valid = d.get("valid", "TRUE")
    if d.get("flag"):
        char = "CASE WHEN v >= 0.5 THEN 'H' ELSE 'L' END"
        bp = ""
        cols = ""
    else:
        cond = f"me > 0 AND {d.get('sample', 'TRUE')}"
        bp_n = nearest(f"SELECT jdate, v FROM fr WHERE primaryexch = 'N' AND {cond}")
        if d.get("fallback"):
            bp_a = nearest(f"SELECT jdate, v FROM fr WHERE {cond}")
            bp_n = (
                f"SELECT a.jdate, coalesce(n.q30, a.q30) AS q30, coalesce(n.q70, a.q70) AS q70 "
                f"FROM ({bp_a}) a LEFT JOIN ({bp_n}) n USING (jdate)"
            )
        bp = f"LEFT JOIN ({bp_n}) b ON fr.jdate = b.jdate"
        char = "CASE WHEN v <= q30 THEN 'L' WHEN v <= q70 THEN 'M' WHEN v > q70 THEN 'H' END"
        cols = ""
    return f"""
WITH fr AS MATERIALIZED ({frame})
SELECT permno, year(fr.jdate) AS ffyear,
  CASE WHEN me > 0 AND v IS NOT NULL AND ({valid}) THEN (CASE WHEN me <= med THEN 'S' WHEN me > med THEN 'B' END) || ({char}) END AS port
FROM fr LEFT JOIN ({size}) s ON fr.jdate = s.jdate {bp}{cols}"""


def june_factor(key: str) -> str:
    d = JUNE[key]
    spread = six_spread(d.get("sign"), d.get("spread") == "size", d.get("zero", False))
    body = f"""
SELECT p.jdate, {spread} AS x FROM t_panel p
JOIN ({labelled_june(key)}) l ON p.permno = l.permno AND p.ffyear = l.ffyear
WHERE p.wt > 0 AND l.port IS NOT NULL GROUP BY 1"""
    return with_tables(rounded(d.get("out", key), body))


# --- monthly sorts, tails, events ---------------------------------------------------

table("t_momentum", """
SELECT *, CASE WHEN count(*) OVER w6 >= 6 THEN exp(sum(ln(greatest(1 + mthret, 1e-6::DOUBLE))) OVER w6) - 1 END AS mom6m,
  CASE WHEN count(*) OVER w35 >= 35 THEN product(1 + mthret) OVER w35 - 1 END AS mom36m
FROM t_panel
WINDOW w6 AS (PARTITION BY permno ORDER BY jdate ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
  w35 AS (PARTITION BY permno ORDER BY jdate ROWS BETWEEN 36 PRECEDING AND 2 PRECEDING)
""")

_DIV = """CASE WHEN exchcd = 3 AND mthcaldt < DATE '2001-02-01' THEN 2.0::DOUBLE WHEN exchcd = 3 AND mthcaldt < DATE '2002-01-01' THEN 1.8::DOUBLE
  WHEN exchcd = 3 AND mthcaldt < DATE '2004-01-01' THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END"""


def _liquidity(screen: str, turnover: str, volume: str) -> str:
    return f"""
SELECT *, lag(me) OVER w AS wt,
  CASE WHEN count(turnover) OVER w6 >= 3 THEN avg(turnover) OVER w6 END AS turn,
  CASE WHEN count(ldolvol) OVER w12 >= 9 THEN avg(ldolvol) OVER w12 END AS dolvol,
  CASE WHEN count(ldolvol) OVER w12 >= 9 THEN stddev_samp(ldolvol) OVER w12 END AS std_dolvol,
  CASE WHEN count(turnover) OVER w12 >= 9 THEN stddev_samp(turnover) OVER w12 END AS std_turn
FROM (
  SELECT permno, mthcaldt AS jdate, primaryexch, mthret, abs(mthprc) * shrout AS me,
    CASE WHEN shrout > 0 THEN {turnover} END AS turnover,
    CASE WHEN ({volume}) * abs(mthprc) > 0 THEN ln(({volume}) * abs(mthprc)) END AS ldolvol
  FROM t_monthly WHERE {screen}) x
WINDOW w AS (PARTITION BY permno ORDER BY jdate),
  w6 AS (PARTITION BY permno ORDER BY jdate ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
  w12 AS (PARTITION BY permno ORDER BY jdate ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"""


table("t_liquidity", _liquidity("shrcd IN (10, 11) AND exchcd IN (1, 2, 3)", f"(vol / ({_DIV})) / shrout", f"vol / ({_DIV})"))
table("t_turnover", _liquidity("shrcd IN (10, 11)", f"(vol / shrout) / ({_DIV})", "vol"))

COMPLETE = "mthret IS NOT NULL AND me IS NOT NULL AND wt IS NOT NULL"
MONTHLY: dict[str, dict] = {
    "mom36m": dict(source="t_momentum", member=f"v IS NOT NULL AND {COMPLETE}", sign=1, valid="me > 0"),
    "turn": dict(source="t_turnover", member=f"v IS NOT NULL AND {COMPLETE}", sign=1, valid="me IS NOT NULL", positive="TRUE"),
    "dolvol": dict(source="t_liquidity", member="v IS NOT NULL", sign=-1, valid="me > 0"),
    "std_dolvol": dict(source="t_liquidity", member="v IS NOT NULL", sign=1, valid="me > 0"),
    "std_turn": dict(source="t_liquidity", member="v IS NOT NULL", sign=1, valid="me > 0"),
}


def monthly_labels(key: str) -> str:
    d = MONTHLY[key]
    bp = nearest(f"SELECT jdate, v FROM fr WHERE primaryexch = 'N' AND {d.get('positive', 'me > 0')}")
    return f"""
WITH fr AS MATERIALIZED (SELECT * FROM (SELECT *, {key} AS v FROM {d['source']}) z WHERE {d['member']})
SELECT fr.jdate, mthret, wt, CASE WHEN {d['valid']} THEN (CASE WHEN me <= med THEN 'S' WHEN me > med THEN 'B' END) ||
  (CASE WHEN v <= q30 THEN 'L' WHEN v <= q70 THEN 'M' WHEN v > q70 THEN 'H' END) END AS port
FROM fr LEFT JOIN (SELECT jdate, median(me) AS med FROM fr WHERE primaryexch = 'N' AND me > 0 GROUP BY 1) s ON fr.jdate = s.jdate
LEFT JOIN ({bp}) b ON fr.jdate = b.jdate"""


def monthly_factor(key: str) -> str:
    d = MONTHLY[key]
    body = f"""
SELECT jdate, {six_spread(d['sign'])} AS x FROM ({monthly_labels(key)}) l
WHERE wt > 0 AND mthret IS NOT NULL AND port IS NOT NULL GROUP BY 1"""
    if key == "turn":
        return with_tables(f'SELECT jdate AS date, round(x, 8) + 0.0::DOUBLE AS turn FROM ({body}) f')
    return with_tables(rounded(key, body))


def tails_factor(key: str) -> str:
    if key == "mom6m":
        source, sign = "SELECT jdate, mthret, wt, mom6m AS v FROM t_momentum", 1
    else:
        source, sign = (
            "SELECT p.jdate, p.mthret, p.wt, a.sgr AS v FROM t_panel p JOIN t_annual a ON p.permno = a.permno AND p.ffyear = year(a.jdate_ltrd)",
            -1,
        )
    h, low = f"({VW.format('H')})", f"({VW.format('L')})"
    spread = f"{h} - {low}" if sign == 1 else f"{low} - {h}"
    body = f"""
WITH fr AS MATERIALIZED (SELECT * FROM ({source}) z WHERE wt > 0 AND v IS NOT NULL)
SELECT jdate, {spread} AS x FROM (
  SELECT fr.jdate, mthret, wt, CASE WHEN v <= q30 THEN 'L' WHEN v >= q70 THEN 'H' END AS port
  FROM fr JOIN ({nearest('SELECT jdate, v FROM fr')}) b ON fr.jdate = b.jdate) l
GROUP BY 1"""
    return with_tables(rounded(key, body))


table("t_payers", """
SELECT permno, year(ym) AS ffyear, max(pays AND NOT before) AS divi, max(NOT pays AND before) AS divo
FROM (SELECT permno, ym, pays, lag(pays) OVER (PARTITION BY permno ORDER BY datadate) AS before
      FROM (SELECT *, coalesce(dvt > 0, FALSE) AS pays FROM t_annual) x) y
GROUP BY 1, 2
""")


def event_factor(key: str) -> str:
    body = f"""
SELECT jdate, ({VW.format('E')}) - ({VW.format('N')}) AS x FROM (
  SELECT p.jdate, p.mthret, p.wt, CASE WHEN coalesce(e.{key}, FALSE) THEN 'E' ELSE 'N' END AS port
  FROM t_panel p LEFT JOIN t_payers e ON p.permno = e.permno AND p.ffyear = e.ffyear WHERE p.wt > 0) l
GROUP BY 1"""
    return with_tables(rounded(key, body))


def factor_sql(key: str) -> str:
    if key in JUNE:
        return june_factor(key)
    if key in MONTHLY:
        return monthly_factor(key)
    if key in ("mom6m", "sgr"):
        return tails_factor(key)
    return event_factor(key)


ALL_KEYS = [*JUNE, *MONTHLY, "mom6m", "sgr", "divi", "divo"]

table("t_flag_rows", """
SELECT permno, permco, last_day(mthcaldt)::DATE AS jdate, primaryexch, coalesce(mthret, 0) AS mthret,
  coalesce(mthretx, 0) AS mthretx, mthprc * shrout AS me
FROM t_msf WHERE sharetype = 'NS' AND securitytype = 'EQTY' AND securitysubtype = 'COM' AND usincflg = 'Y'
  AND issuertype IN ('ACOR', 'CORP') AND primaryexch IN ('N', 'A', 'Q') AND conditionaltype = 'RW' AND tradingstatusflg = 'A'
""")

table("t_flag_weights", """
SELECT *, product(1 + mthretx) OVER (PARTITION BY permno, ffyear ORDER BY jdate ROWS UNBOUNDED PRECEDING) AS cumretx,
  CASE WHEN row_number() OVER w = 1 THEN me / (1 + mthretx) ELSE lag(me) OVER w END AS lme
FROM (
  SELECT DISTINCT u.permno, u.permco, u.jdate, u.primaryexch, u.mthret, u.mthretx, s.me_sum AS me,
    year(date_trunc('month', u.jdate) - INTERVAL 6 MONTH) AS ffyear, month(date_trunc('month', u.jdate) - INTERVAL 6 MONTH) AS ffmonth
  FROM t_flag_rows u JOIN (SELECT jdate, permco, max(me) AS me, sum(me) AS me_sum FROM t_flag_rows GROUP BY 1, 2) s
    ON u.jdate = s.jdate AND u.permco = s.permco AND u.me = s.me) x
WINDOW w AS (PARTITION BY permno ORDER BY jdate)
""")

table("t_flag_panel", """
SELECT p.permno, p.jdate, p.primaryexch, p.mthret, p.me, p.ffyear, d.me AS dec_me,
  CASE WHEN ffmonth = 1 THEN lme ELSE mebase * lcum END AS wt
FROM (
  SELECT a.*, b.lme AS mebase, lag(a.cumretx) OVER (PARTITION BY a.permno ORDER BY a.jdate) AS lcum
  FROM t_flag_weights a LEFT JOIN (SELECT permno, ffyear, lme FROM t_flag_weights WHERE ffmonth = 1) b USING (permno, ffyear)) p
LEFT JOIN (SELECT permno, ffyear, me FROM t_flag_weights WHERE ffmonth = 6) d USING (permno, ffyear)
""")
