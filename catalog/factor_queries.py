"""One query per registered factor, the legacy variant and the full bundle."""

from __future__ import annotations

from dataclasses import replace

from catalog.registry import ORACLES, QUERIES, Tables, query, round_doubles
from catalog.sql_factors import ALL_KEYS, factor_sql
from crosspanel.plans.factors import REGISTRY, build_available_factors, build_factor, build_factors
from crosspanel.plans.legacy import legacy_three_factor, legacy_firm_counts

NUMBERS = {key: f"f{i:02d}" for i, key in enumerate(REGISTRY, start=1)}


def _register(key: str) -> None:
    name = f"{NUMBERS[key]}_{key.lower()}"
    QUERIES[name] = lambda t: round_doubles(build_factor(t.base, key), 8)
    ORACLES[name] = factor_sql(key)


for _key in REGISTRY:
    _register(_key)

_NAMES = [REGISTRY[k].name for k in ALL_KEYS]
_BUNDLE = "SELECT date, {} FROM {}".format(
    ", ".join(f'"{n}"' for n in _NAMES),
    " FULL JOIN ".join(
        f"({factor_sql(k)}) f{i}" + ("" if i == 0 else " USING (date)") for i, k in enumerate(ALL_KEYS)
    ),
)


@query("f38_all_factors")
def all_factors(t: Tables):
    return build_factors(t.base)


ORACLES["f38_all_factors"] = _BUNDLE


_VOLUME = [k for k in ALL_KEYS if REGISTRY[k].chain == "monthly" and REGISTRY[k].frame in ("liquidity", "turnover")]


def _without_volume(t: Tables):
    return build_available_factors(replace(t.base, monthly=t.base.monthly.drop("vol")))


@query("f38_without_volume")
def without_volume(t: Tables):
    """A base without trading volume still gives every other factor."""
    return _without_volume(t)[0]


ORACLES["f38_without_volume"] = "SELECT * EXCLUDE ({}) FROM ({}) b".format(", ".join(f'"{REGISTRY[k].name}"' for k in _VOLUME), _BUNDLE)


@query("f38_skipped_factors", "SELECT factor, CASE WHEN (SELECT count(*) FROM t_months) > 0 THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION' END AS reason FROM (VALUES {}) v(factor)".format(", ".join(f"('{REGISTRY[k].name}')" for k in _VOLUME)))
def skipped_factors(t: Tables):
    """The factors left out for the missing column, with the reason."""
    return _without_volume(t)[1]


START, END = "1999-01-01", "2000-12-31"


def _windowed(key: str) -> str:
    """The factor's SQL with inputs cut at its own warm-up and output at the window."""
    warm = 13 if REGISTRY[key].chain == "monthly" and key != "mom36m" else REGISTRY[key].warm_months

    def since(column: str, months: int) -> str:
        return f"{column} BETWEEN DATE '{START}' - INTERVAL {months} MONTH AND DATE '{END}'"

    sql = factor_sql(key).replace("WHERE shrcd IN (10, 11)", f"WHERE {since('mthcaldt', warm)} AND shrcd IN (10, 11)")
    sql = sql.replace("FROM t_annual) x) y", f"FROM t_annual WHERE {since('datadate', warm + 36)}) x) y")
    return f"SELECT * FROM ({sql}) w WHERE date BETWEEN DATE '{START}' AND DATE '{END}'"


@query("f38_all_factors_windowed")
def all_factors_windowed(t: Tables):
    """Every factor over a date window, each with its own warm-up history."""
    return build_factors(t.base, start=START, end=END)


ORACLES["f38_all_factors_windowed"] = "SELECT date, {} FROM {}".format(
    ", ".join(f'"{n}"' for n in _NAMES),
    " FULL JOIN ".join(f"({_windowed(k)}) f{i}" + ("" if i == 0 else " USING (date)") for i, k in enumerate(ALL_KEYS)),
)


_LEGACY_SOURCE = """
WITH be AS MATERIALIZED (
  SELECT gvkey, datadate, row_number() OVER (PARTITION BY gvkey ORDER BY datadate) - 1 AS cnt,
    CASE WHEN seq + coalesce(txditc, 0) - coalesce(pstkrv, pstkl, pstk, 0) > 0
      THEN seq + coalesce(txditc, 0) - coalesce(pstkrv, pstkl, pstk, 0) END AS be
  FROM t_funda WHERE indfmt = 'INDL' AND datafmt = 'STD' AND popsrc = 'D' AND consol = 'C'),
linked AS MATERIALIZED (
  SELECT l.permno, make_date(year(b.datadate) + 1, 6, 30) AS jdate, b.be, b.cnt
  FROM be b JOIN t_good_links l USING (gvkey)
  WHERE make_date(year(b.datadate) + 1, 6, 30) BETWEEN l.linkdt AND l.linkenddt),
fr AS MATERIALIZED (
  SELECT p.permno, p.jdate, p.primaryexch, p.me, l.be * 1000 / p.dec_me AS v, l.cnt
  FROM t_flag_panel p JOIN linked l ON p.permno = l.permno AND p.jdate = l.jdate
  WHERE month(p.jdate) = 6 AND p.dec_me IS NOT NULL),
bp AS MATERIALIZED (
  SELECT jdate, median(me) AS med, quantile_cont(v, 0.3) AS q30, quantile_cont(v, 0.7) AS q70
  FROM fr WHERE primaryexch = 'N' AND v > 0 AND me > 0 AND cnt >= 1 GROUP BY 1),
lab AS MATERIALIZED (
  SELECT fr.permno, year(fr.jdate) AS ffyear, (CASE WHEN me <= med THEN 'S' WHEN me > med THEN 'B' END) ||
    (CASE WHEN v <= q30 THEN 'L' WHEN v <= q70 THEN 'M' WHEN v > q70 THEN 'H' END) AS port
  FROM fr JOIN bp USING (jdate) WHERE v > 0 AND me > 0 AND cnt >= 1),
held AS MATERIALIZED (
  SELECT p.jdate, p.mthret, p.wt, lab.port FROM t_flag_panel p JOIN lab USING (permno, ffyear)
  WHERE p.wt > 0 AND lab.port IS NOT NULL)
"""


def _legacy(select: str) -> str:
    from catalog.sql_tables import with_tables

    full = with_tables("SELECT * FROM t_funda, t_good_links, t_flag_panel")
    ctes = full[: full.rindex("SELECT * FROM t_funda")]
    return ctes.rstrip() + ",\n" + _LEGACY_SOURCE.strip().removeprefix("WITH ") + select


def _vw(p: str) -> str:
    return f"(sum(mthret * wt) FILTER (WHERE port = '{p}') / sum(wt) FILTER (WHERE port = '{p}'))"


@query("f37_legacy_three_factor")
def legacy(t: Tables):
    return legacy_three_factor(t.raw)


ORACLES["f37_legacy_three_factor"] = _legacy(f"""
SELECT jdate AS date, round(({_vw('BH')} + {_vw('SH')}) / 2 - ({_vw('BL')} + {_vw('SL')}) / 2, 8) + 0.0::DOUBLE AS whml,
  round(({_vw('SL')} + {_vw('SM')} + {_vw('SH')}) / 3 - ({_vw('BL')} + {_vw('BM')} + {_vw('BH')}) / 3, 8) + 0.0::DOUBLE AS wsmb
FROM held GROUP BY 1""")


@query("a11_firm_counts")
def firm_counts(t: Tables):
    return legacy_firm_counts(t.raw)


_CNT = ", ".join(f"count(mthret) FILTER (WHERE port = '{p}') AS {p.lower()}" for p in ("SL", "SM", "SH", "BL", "BM", "BH"))
ORACLES["a11_firm_counts"] = _legacy(f"""
SELECT *, sh + bh + sl + bl AS hml, bl + bm + bh + sl + sm + sh AS total FROM (SELECT jdate AS date, {_CNT} FROM held GROUP BY 1) c""")
