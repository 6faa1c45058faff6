"""Series alignment, comparison, backtests, file formats and the panel store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from catalog.registry import Tables, query
from catalog.sql_tables import table
from crosspanel.functions.dates import month_key
from crosspanel.operators import compare as C, joins as J, moments as MO, performance as B, rows as R
from crosspanel.operators.ordered import average_ranks
from crosspanel.session import ensure_checkpoint_dir
from crosspanel.sources import files as FI
from crosspanel.sources.store import PanelStore
from crosspanel.streaming import incremental as INC

c = F.col
BRANDS = [f"Brand{i}" for i in range(1, 26)]

table("t_dates", "SELECT max(l_shipdate::DATE) AS date, date_trunc('month', max(l_shipdate))::DATE AS ym FROM lineitem GROUP BY date_trunc('month', l_shipdate)")
table("t_rf", "SELECT date, 0.001::DOUBLE + ((year(date) * 12 + month(date)) % 5)::DOUBLE * 0.0005::DOUBLE AS rf FROM t_dates")


def _brand(where: str) -> str:
    return f"""SELECT factor, date, (c - before)::DOUBLE / (10 * (c + before))::DOUBLE AS ret FROM (
  SELECT *, lag(c) OVER (PARTITION BY factor ORDER BY ym) AS before FROM (
    SELECT replace(p_brand, '#', '') AS factor, date_trunc('month', l_shipdate)::DATE AS ym, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS c
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where} GROUP BY 1, 2) x) y JOIN t_dates USING (ym) WHERE before IS NOT NULL"""


table("t_factors", _brand("TRUE"))
table("t_factors_open", _brand("l_linestatus = 'O'"))
table("t_assets", """SELECT permno AS asset, permno // 6 AS block, date, r - rf AS ret FROM (
  SELECT permno, mthcaldt AS date, (cents - lag(cents) OVER w)::DOUBLE / (10 * (cents + lag(cents) OVER w))::DOUBLE AS r
  FROM t_months WINDOW w AS (PARTITION BY permno ORDER BY ym)) x JOIN t_rf USING (date) WHERE r IS NOT NULL""")
table("t_meta", """SELECT replace(p_brand, '#', '') AS factor, 1990 + k AS year_pub, 1985 + k AS year_end, 5 + (k * 7) % 20 AS min_stk6, k AS position
  FROM (SELECT DISTINCT p_brand, replace(p_brand, 'Brand#', '')::INT AS k FROM part) x""")
table("t_pairs", "SELECT factor, date, a.ret AS a, b.ret AS b FROM t_factors a JOIN t_factors_open b USING (factor, date)")


# --- filters and alignment ------------------------------------------------------------


@query("p20_excess_return", "SELECT factor, date, ret - rf AS ret FROM t_factors JOIN t_rf USING (date)", "ret")
def p20(t: Tables) -> DataFrame:
    return t.research.factors.join(t.research.rf, "date").select("factor", "date", (c("ret") - c("rf")).alias("ret"))


@query("p21_eligible_blocks", "SELECT a.asset, a.date, a.ret FROM t_assets a JOIN t_meta m ON a.block % 25 + 1 = m.position WHERE m.min_stk6 >= 10", "ret")
def p21(t: Tables) -> DataFrame:
    ids = t.research.metadata.where(c("min_stk6") >= 10).select(c("position").cast("long").alias("position"))
    d = t.research.assets.withColumn("position", c("block") % 25 + 1)
    return d.join(ids, "position", "left_semi").select("asset", "date", "ret")


@query("p22_control_test_split", "SELECT factor, CASE WHEN year_pub < 2012 THEN 'control' ELSE 'test' END AS role FROM t_meta")
def p22(t: Tables) -> DataFrame:
    return t.research.metadata.select("factor", F.when(c("year_pub") < 2012, "control").otherwise("test").alias("role"))


_PIVOT = ", ".join(f"max(ret) FILTER (WHERE factor = '{b}') AS {b}" for b in BRANDS)


@query("j13_outer_merge_series", f"SELECT date, {_PIVOT} FROM t_factors GROUP BY 1", " ".join(BRANDS))
def j13(t: Tables) -> DataFrame:
    return J.merge_series(t.research.factors, BRANDS, value="ret")


def _two_wide(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = J.merge_series(t.research.factors.where(F.year("date") >= 1997), BRANDS[:3], value="ret")
    b = J.merge_series(t.research.factors_open.where(F.year("date") <= 2000), BRANDS[1:5], value="ret")
    return a, b


_A3 = ", ".join(f"max(ret) FILTER (WHERE factor = '{b}') AS {b}" for b in BRANDS[:3])
_B4 = ", ".join(f"max(ret) FILTER (WHERE factor = '{b}') AS {b}" for b in BRANDS[1:5])
_TWO = f"(SELECT date, {_A3} FROM t_factors WHERE year(date) >= 1997 GROUP BY 1) a {{}} JOIN (SELECT date, {_B4} FROM t_factors_open WHERE year(date) <= 2000 GROUP BY 1) b USING (date)"


@query("j14_overlay", f"""SELECT date, a.Brand1, coalesce(a.Brand2, b.Brand2) AS Brand2, coalesce(a.Brand3, b.Brand3) AS Brand3, b.Brand4, b.Brand5
  FROM {_TWO.format('FULL')} WHERE date <= DATE '2001-06-30'""", "Brand1 Brand2 Brand3 Brand4 Brand5")
def j14(t: Tables) -> DataFrame:
    a, b = _two_wide(t)
    return J.overlay(a, b, "date", end="2001-06-30")


@query("j15_inner_merge", f"SELECT date, a.Brand1, a.Brand2, a.Brand3, b.Brand2 AS Brand2__open, b.Brand3 AS Brand3__open, b.Brand4, b.Brand5 FROM {_TWO.format('INNER')}",
       "Brand1 Brand2 Brand3 Brand2__open Brand3__open Brand4 Brand5")
def j15(t: Tables) -> DataFrame:
    a, b = _two_wide(t)
    return J.inner_merge({"all": a, "open": b})


@query("j16_align_common_dates", "SELECT * FROM t_pairs", "a b")
def j16(t: Tables) -> DataFrame:
    return C.paired(t.research.factors, t.research.factors_open)


@query("j20_metadata_alignment", """SELECT f.factor, m.year_pub, CASE WHEN m.factor IS NULL THEN 'missing' ELSE 'matched' END AS status
  FROM (SELECT DISTINCT factor FROM t_factors) f LEFT JOIN (SELECT * FROM t_meta WHERE year_pub < 2012) m USING (factor)""")
def j20(t: Tables) -> DataFrame:
    names = t.research.factors.select("factor").distinct()
    meta = t.research.metadata.where(c("year_pub") < 2012).select("factor", "year_pub")
    return J.align_metadata(names, meta)


@query("a17_complete_series", "SELECT asset, 82 - count(*) AS n_missing FROM t_assets WHERE date > (SELECT min(date) FROM t_dates) GROUP BY 1".replace("82", "(SELECT count(*) - 1 FROM t_dates)"))
def a17(t: Tables) -> DataFrame:
    days = t.research.factors.select("date").distinct()
    return C.missing_counts(t.research.assets, days, "asset")


@query("a18_drop_empty_rows", "SELECT permno, mthcaldt, mthret, vol FROM t_monthly WHERE mthret IS NOT NULL OR vol IS NOT NULL", digits=None)
def a18(t: Tables) -> DataFrame:
    return R.drop_all_null(t.base.monthly.select("permno", "mthcaldt", "mthret", "vol"), ["mthret", "vol"])


@query("a19_delta_summary", "SELECT factor, count(*) AS rows_compared, min(a - b) AS delta_min, max(a - b) AS delta_max, avg(a - b) AS delta_mean FROM t_pairs GROUP BY 1",
       "delta_min delta_max delta_mean")
def a19(t: Tables) -> DataFrame:
    return C.delta_summary(C.paired(t.research.factors, t.research.factors_open))


_METRICS = """SELECT factor, n, r AS pearson, rho AS spearman, r * r AS r2, rmse, mae, mape, bias, std_diff, 2 * r * sqrt(va) * sqrt(vb) / (va + vb + (ma - mb) ** 2) AS ccc FROM (
  SELECT factor, count(*) AS n, corr(a, b) AS r, corr(ra, rb) AS rho, sqrt(avg((a - b) ** 2)) AS rmse, avg(abs(a - b)) AS mae,
    avg(abs(a - b) / greatest(abs(b), 1e-12::DOUBLE)) AS mape, avg(a - b) AS bias, stddev_samp(a - b) AS std_diff,
    var_samp(a) AS va, var_samp(b) AS vb, avg(a) AS ma, avg(b) AS mb
  FROM (SELECT *, rank() OVER (PARTITION BY factor ORDER BY a) + (count(*) OVER (PARTITION BY factor, a) - 1) / 2.0::DOUBLE AS ra,
          rank() OVER (PARTITION BY factor ORDER BY b) + (count(*) OVER (PARTITION BY factor, b) - 1) / 2.0::DOUBLE AS rb FROM t_pairs) x GROUP BY 1) y"""
_METRIC_COLS = "pearson spearman r2 rmse mae mape bias std_diff ccc"


@query("a20_replication_metrics", _METRICS, _METRIC_COLS, 6)
def a20(t: Tables) -> DataFrame:
    return C.replication_metrics(C.paired(t.research.factors, t.research.factors_open))


@query("a20_average_ranks", """SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value NULLS FIRST) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS value_rank,
  rank() OVER (PARTITION BY event_type ORDER BY day) + (count(*) OVER (PARTITION BY event_type, day) - 1) / 2.0::DOUBLE AS day_rank
  FROM (SELECT event_id, event_type, value, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events WHERE ts IS NOT NULL) e""", digits=None)
def a20_ranks(t: Tables) -> DataFrame:
    """Average ranks of events within their type, a few groups that grow with the table."""
    d = t.read("events").where(c("ts").isNotNull()).select("event_id", "event_type", "value", F.unix_date(c("ts").cast("date")).alias("day"))
    return average_ranks(d, ["event_type"], ["value", "day"]).select("event_id", c("_rank_value").alias("value_rank"), c("_rank_day").alias("day_rank"))


_ZSCORE = """(SELECT factor, date, (a - avg(a) OVER w) / stddev_samp(a) OVER w AS a, (b - avg(b) OVER w) / stddev_samp(b) OVER w AS b FROM t_pairs
  WINDOW w AS (PARTITION BY factor)) zs"""


@query("a20_replication_metrics_standardised", _METRICS.replace("FROM t_pairs", f"FROM {_ZSCORE}").replace(" mae, mape, bias, std_diff,", " mae, std_diff,"), _METRIC_COLS.replace("mape ", "").replace("bias ", ""), 6)
def a20z(t: Tables) -> DataFrame:
    d = C.replication_metrics(C.paired(t.research.factors, t.research.factors_open), standardise=True)
    # Standardised series have no bias beyond rounding noise and no scale to be relative to.
    return d.drop("mape", "bias")


@query("a21_single_comparison", """SELECT factor, count(*) AS obs, corr(a, b) AS corr, avg(abs(a - b)) AS mae, avg((a - b) ** 2) AS mse, sqrt(avg((a - b) ** 2)) AS rmse,
  avg(a - b) AS mean_diff, median(a - b) AS median_diff FROM t_pairs GROUP BY 1""", "corr mae mse rmse mean_diff median_diff")
def a21(t: Tables) -> DataFrame:
    return C.single_comparison(t.research.factors, t.research.factors_open)


@query("o02_top_factors", f"SELECT * FROM ({_METRICS}) ORDER BY rmse DESC, factor LIMIT 10", _METRIC_COLS, 6)
def o02(t: Tables) -> DataFrame:
    return R.top_k(C.replication_metrics(C.paired(t.research.factors, t.research.factors_open)), "rmse", 10, False, "factor")


@query("o03_metric_threshold", f"SELECT * FROM ({_METRICS}) WHERE pearson > 0.6", _METRIC_COLS, 6)
def o03(t: Tables) -> DataFrame:
    return C.replication_metrics(C.paired(t.research.factors, t.research.factors_open)).where(c("pearson") > 0.6)


# --- performance -----------------------------------------------------------------------

_PATH = """SELECT *, max(cumulative) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING) AS running_max FROM (
  SELECT *, product(1 + ret) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING) AS cumulative FROM ({src}) s) p"""


@query("w17_drawdown", f"SELECT factor, date, cumulative, running_max, (running_max - cumulative) / running_max AS drawdown FROM ({_PATH.format(k='factor', src='SELECT * FROM t_factors')}) x",
       "cumulative running_max drawdown")
def w17(t: Tables) -> DataFrame:
    return B.drawdown_path(t.research.factors, ["factor"]).select("factor", "date", "cumulative", "running_max", "drawdown")


@query("w18_cumulative_log", "SELECT factor, date, sum(ln(1 + ret)) OVER (PARTITION BY factor ORDER BY date ROWS UNBOUNDED PRECEDING) AS cumulative_log FROM t_factors WHERE ret > -1", "cumulative_log")
def w18(t: Tables) -> DataFrame:
    return B.cumulative_log_path(t.research.factors, ["factor"]).select("factor", "date", "cumulative_log")


@query("w19_resample_last", """SELECT event_type, date, close / before - 1 AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY event_type ORDER BY date) AS before FROM (
  SELECT event_type, date_trunc('day', ts)::DATE AS date, arg_max(value, ts) AS close FROM events GROUP BY 1, 2) x) y WHERE before <> 0""", "ret", 6)
def w19(t: Tables) -> DataFrame:
    d = B.period_returns(t.read("events"), "event_type", "ts", "value", period=c("ts").cast("date"))
    return d.select("event_type", "date", "ret")


_STATS = """SELECT factor, period, min(date) AS start_date, max(date) AS end_date, count(*) AS n_periods, avg(ret) AS mean_return, stddev_samp(ret) AS std_return,
  arg_max(cumulative, date) AS final_value, max((running_max - cumulative) / running_max) AS max_drawdown FROM ({path}) z GROUP BY 1, 2"""
_BACKTEST = """SELECT s.*, rf.mean_rf, mean_return * 12 AS annualized_return, std_return * sqrt(12) AS annualized_std, mean_rf * 12 AS annualized_rf,
  (mean_return * 12 - mean_rf * 12) / (std_return * sqrt(12)) AS sharpe_ratio, final_value - 1 AS total_return
FROM ({stats}) s JOIN (SELECT s2.factor, s2.period, avg(r.rf) AS mean_rf FROM ({stats}) s2 JOIN t_rf r ON r.date BETWEEN s2.start_date AND s2.end_date GROUP BY 1, 2) rf USING (factor, period)"""
_B_COLS = "mean_return std_return final_value max_drawdown mean_rf annualized_return annualized_std annualized_rf sharpe_ratio total_return"


def _backtest(src: str) -> str:
    return _BACKTEST.format(stats=_STATS.format(path=_PATH.format(k="factor, period", src=src)))


@query("b01_backtest_summary", _backtest("SELECT *, 'Full sample' AS period FROM t_factors"), _B_COLS, 6)
def b01(t: Tables) -> DataFrame:
    return B.backtest(t.research.factors, t.research.rf)


@query("b02_backtest_periods", _backtest("SELECT *, CASE WHEN date <= DATE '1999-12-31' THEN 'Start - 2000' ELSE '2000 - 2008' END AS period FROM t_factors"), _B_COLS, 6)
def b02(t: Tables) -> DataFrame:
    return B.backtest(t.research.factors, t.research.rf, B.REPORT_PERIODS)


def _benchmarks(t: Tables) -> DataFrame:
    return t.research.factors.where(c("factor").isin("Brand1", "Brand2")).withColumnRenamed("factor", "benchmark")


@query("b03_benchmark_correlation", """SELECT a.factor, b.factor AS benchmark, p.period, count(*) AS n_observations, corr(a.ret, b.ret) AS correlation
  FROM t_factors a JOIN t_factors b USING (date) JOIN (VALUES ('Start - 2000', DATE '1900-01-01', DATE '1999-12-31'), ('2000 - 2008', DATE '2000-01-01', DATE '2007-12-31')) p(period, s, e)
    ON last_day(a.date) BETWEEN p.s AND p.e WHERE b.factor IN ('Brand1', 'Brand2') GROUP BY 1, 2, 3""", "correlation", 6)
def b03(t: Tables) -> DataFrame:
    return B.benchmark_correlation(t.research.factors, _benchmarks(t), B.REPORT_PERIODS)


def _index_pairs(t: Tables) -> DataFrame:
    x = t.research.factors.where(c("factor") == "Brand1").select("date", c("ret").alias("x"))
    return t.research.factors.where(c("factor") != "Brand1").select("factor", "date", c("ret").alias("y")).join(x, "date")


def _single_index(centre: str, scale: str) -> str:
    return f"""SELECT factor, n, alpha, alpha * 12 AS alpha_annualized, beta, r_squared, sqrt(mse * (1.0 / n + {centre} ** 2 / {scale})) AS se_alpha, sqrt(mse / sxx) AS se_beta,
  alpha / sqrt(mse * (1.0 / n + {centre} ** 2 / {scale})) AS t_alpha, beta / sqrt(mse / sxx) AS t_beta FROM (
  SELECT a.factor, count(*) AS n, regr_slope(a.ret, x.ret) AS beta, regr_intercept(a.ret, x.ret) AS alpha, regr_r2(a.ret, x.ret) AS r_squared, avg(x.ret) AS mx, avg(a.ret) AS my,
    regr_sxx(a.ret, x.ret) AS sxx, regr_syy(a.ret, x.ret) AS syy, (regr_syy(a.ret, x.ret) - regr_slope(a.ret, x.ret) * regr_sxy(a.ret, x.ret)) / (count(*) - 2) AS mse
  FROM t_factors a JOIN t_factors x USING (date) WHERE x.factor = 'Brand1' AND a.factor <> 'Brand1' GROUP BY 1) y"""


_REG = "alpha alpha_annualized beta r_squared se_alpha se_beta t_alpha t_beta"


@query("b04_single_index", _single_index("mx", "sxx"), _REG, 6)
def b04(t: Tables) -> DataFrame:
    return B.single_index(_index_pairs(t), ["factor"])


@query("b04_single_index_report", _single_index("my", "syy"), _REG, 6)
def b04r(t: Tables) -> DataFrame:
    return B.single_index(_index_pairs(t), ["factor"], textbook_se=False)


def _two_sided(t: str) -> str:
    """Student-t tail of ``t`` with n - 2 degrees of freedom, by the continued fraction of the incomplete beta function."""
    df = "(n - 2.0::DOUBLE)"
    x, rest = f"({df} / ({df} + {t} ** 2))", f"({t} ** 2 / ({df} + {t} ** 2))"
    direct = f"{x} < ({df} / 2 + 1) / ({df} / 2 + 2.5)"
    a, b, y = (f"(CASE WHEN {direct} THEN {u} ELSE {v} END)" for u, v in ((f"{df} / 2", "0.5::DOUBLE"), ("0.5::DOUBLE", f"{df} / 2"), (x, rest)))
    m = "ceil(k / 2.0)"
    num = f"CASE k % 2 WHEN 1 THEN {m} * ({b} - {m}) * {y} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m})) ELSE -({a} + {m}) * ({a} + {b} + {m}) * {y} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1)) END"
    first = f"1 / (1 - ({a} + {b}) * {y} / ({a} + 1))"
    steps = f"range(1, (2 * (100 + 3 * ceil(sqrt(greatest({a}, {b}))))::BIGINT) + 1)"
    step = "lambda s, y: list_transform([1 / (1 + y[1] * s[2])], lambda d: [1 + y[1] / s[1], d, s[3] * d * (1 + y[1] / s[1])])[1]"
    h = f"list_reduce(list_prepend([1::DOUBLE, {first}, {first}], list_transform({steps}, lambda k: [{num}])), {step})[3]"
    tail = f"exp(lgamma({df} / 2 + 0.5) - lgamma({df} / 2) - lgamma(0.5) + {df} / 2 * ln({x}) + 0.5 * ln({rest})) * {h} / {a}"
    return f"CASE WHEN {t} = 0 THEN 1 WHEN {direct} THEN {tail} ELSE 1 - {tail} END"


@query("b04_p_values", f"SELECT *, {_two_sided('t_alpha')} AS p_alpha, {_two_sided('t_beta')} AS p_beta FROM ({_single_index('mx', 'sxx')}) r", _REG + " p_alpha p_beta", 6)
def b04p(t: Tables) -> DataFrame:
    return B.with_p_values(B.single_index(_index_pairs(t), ["factor"]))


@query("b06_report_table", """SELECT factor, period, round(avg(ret) * 1200, 2) + 0.0::DOUBLE AS annual_return_pct, round(stddev_samp(ret) * sqrt(12) * 100, 2) + 0.0::DOUBLE AS annual_std_pct
  FROM (SELECT *, 'Full sample' AS period FROM t_factors) x GROUP BY 1, 2""", "annual_return_pct annual_std_pct", 2)
def b06(t: Tables) -> DataFrame:
    d = B.backtest(t.research.factors, t.research.rf)
    return d.select(
        "factor", "period", (c("annualized_return") * 100).alias("annual_return_pct"), (c("annualized_std") * 100).alias("annual_std_pct")
    )


@query("e15_average_test", "SELECT factor, avg(ret) AS avg, avg(ret) / stddev_samp(ret) * sqrt(count(*)) AS tstat_avg FROM t_factors GROUP BY 1", "avg tstat_avg", 6)
def e15(t: Tables) -> DataFrame:
    return B.series_average_test(t.research.factors)


@query("e26_statistic_difference", """SELECT factor, a, b, a - b AS difference, 100 * (a - b) / b AS diff_pct FROM
  (SELECT factor, avg(ret) / stddev_samp(ret) * sqrt(count(*)) AS a FROM t_factors GROUP BY 1) x JOIN (SELECT factor, avg(ret) / stddev_samp(ret) * sqrt(count(*)) AS b FROM t_factors_open GROUP BY 1) y USING (factor)""",
       "a b difference diff_pct", 4)
def e26(t: Tables) -> DataFrame:
    a = B.series_average_test(t.research.factors).select("factor", c("tstat_avg").alias("a"))
    b = B.series_average_test(t.research.factors_open).select("factor", c("tstat_avg").alias("b"))
    return C.statistic_difference(a.join(b, "factor"))


# --- files ------------------------------------------------------------------------------


def _folder(t: Tables, label: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


# Files hold every series on every date, missing values included.
_LONG = """SELECT date, factor, ret AS value FROM ((SELECT DISTINCT date FROM t_factors) d CROSS JOIN (SELECT DISTINCT factor FROM t_factors) f)
  LEFT JOIN t_factors USING (date, factor)"""


def _wide(t: Tables) -> DataFrame:
    return J.merge_series(t.research.factors, BRANDS, value="ret")


@query("s15_embedded_table", _LONG, "value")
def s15(t: Tables) -> DataFrame:
    """A data table between prose and a second table; only the first is read."""
    data = _wide(t).select(
        F.concat_ws(",", F.date_format("date", "yyyyMMdd"), *[F.coalesce(c(b).cast("string"), F.lit("")) for b in BRANDS]).alias("line"),
        (F.lit(10) + F.datediff("date", F.lit("1990-01-01").cast("date"))).alias("n"),
    )
    prose = t.spark.createDataFrame(
        [(0, "Monthly series, see notes"), (1, ""), (2, ",".join(["Date", *BRANDS])), (10**6, ""), (10**6 + 1, " Annual, Brand1"), (10**6 + 2, "1999,1.0")],
        "n int, line string",
    )
    path = _folder(t, "embedded")
    FI.write_text_lines(prose.select("n", "line").unionByName(data), path, "n")
    return FI.read_embedded_table(t.spark, path, ["date", "brand1"])


@query("s16_spaced_text", "SELECT date, CASE WHEN month(date) <> 3 THEN ret END AS value FROM t_factors WHERE factor = 'Brand1'", "value")
def s16(t: Tables) -> DataFrame:
    d = t.research.factors.where(c("factor") == "Brand1")
    value = F.when(F.month("date") == 3, F.lit("-99")).otherwise(c("ret").cast("string"))
    lines = d.select(
        F.concat(F.lit("  "), F.date_format("date", "yyyyMMdd"), F.lit("   "), value).alias("line"),
        F.datediff("date", F.lit("1990-01-01").cast("date")).alias("n"),
    )
    head = t.spark.createDataFrame([(0, "% Month  Traded")], "n int, line string")
    path = _folder(t, "spaced")
    FI.write_text_lines(head.select("line", "n").unionByName(lines), path, "n")
    return FI.read_spaced_text(t.spark, path, ["date", "value"])


@query("s17_wide_matrix", "SELECT date, replace(factor, 'Brand', '')::INT - 1 AS col_idx, ret / 100 AS value FROM t_factors", "value", 10)
def s17(t: Tables) -> DataFrame:
    path = _folder(t, "matrix")
    wide = J.merge_series(t.research.factors, BRANDS, value="ret")
    wide.withColumn("date", F.date_format("date", "yyyyMMdd")).write.csv(path, header=False)
    return FI.read_wide_matrix(t.spark, path, len(BRANDS), scale=0.01).where(c("value").isNotNull())


def _factor_file(t: Tables) -> str:
    path = _folder(t, "factor-file")
    wide = _wide(t).join(t.research.rf, "date").select("date", "rf", *BRANDS, (c("rf") * 1.0).alias("RF_"))
    wide.toDF("date", "rate", *BRANDS, "RF").write.csv(path, header=True)
    return path


@query("s18_factor_csv", f"{_LONG} UNION ALL SELECT date, 'rf', rf FROM t_rf WHERE date > (SELECT min(date) FROM t_dates)", "value")
def s18(t: Tables) -> DataFrame:
    long, rf = FI.read_factor_csv(t.spark, _factor_file(t))
    return long.unionByName(rf.select("date", F.lit("rf").alias("factor"), c("rf").alias("value")))


@query("s19_gather_files", _LONG, "value")
def s19(t: Tables) -> DataFrame:
    wide, paths = _wide(t), []
    for names in (BRANDS[:1], BRANDS[1:2], BRANDS[2:]):
        path = _folder(t, "gather")
        bad = t.spark.createDataFrame([("not a date",)], "Date string")
        wide.select(c("date").cast("string").alias("Date"), *names).unionByName(bad, allowMissingColumns=True).write.csv(path, header=True)
        paths.append(path)
    return FI.gather_factor_files(t.spark, paths)


@query("s20_csv_sink", f"SELECT date, {_PIVOT} FROM t_factors GROUP BY 1", " ".join(BRANDS))
def s20(t: Tables) -> DataFrame:
    path = _folder(t, "sink")
    FI.write_factor_csv(_wide(t), path, single_file=True)
    return t.spark.read.schema("date date, " + ", ".join(f"{b} double" for b in BRANDS)).csv(path, header=True)


# --- partitioned store ---------------------------------------------------------------------

_COLS = ["permno", "permco", "mthcaldt", "mthret", "mthprc"]


def _store(t: Tables, years: tuple[int, int] | None = None) -> PanelStore:
    store = PanelStore(t.spark, _folder(t, "store"))
    d = t.raw.msf.select(*_COLS)
    if years is not None:
        d = d.where(F.year("mthcaldt").between(*years))
    store.replace_years(d, "msf", "mthcaldt", "panel|v1", F.lit("2024-01-01").cast("timestamp"))
    return store


@query("s05_read_years", "SELECT permno, mthcaldt, mthret FROM t_msf WHERE year(mthcaldt) IN (1996, 1999)", digits=None)
def s05(t: Tables) -> DataFrame:
    return _store(t).read_years("msf", [1996, 1999], ["permno", "mthcaldt", "mthret"])


@query("s06_replace_years", "SELECT permno, permco, mthcaldt, CASE WHEN year(mthcaldt) <> 1998 THEN mthret END AS mthret, mthprc FROM t_msf", digits=None)
def s06(t: Tables) -> DataFrame:
    store = _store(t)
    again = t.raw.msf.where(F.year("mthcaldt") == 1998).select(*_COLS).withColumn("mthret", F.lit(None).cast("double"))
    store.replace_years(again, "msf", "mthcaldt", "panel|v2")
    return t.spark.read.parquet(store.path("msf")).drop("year").select(*_COLS)


@query("s07_incremental_fill", "SELECT permno, permco, mthcaldt, mthret, mthprc FROM t_msf WHERE mthcaldt <= DATE '1999-06-30' OR mthcaldt > DATE '1999-06-30'", digits=None)
def s07(t: Tables) -> DataFrame:
    store = PanelStore(t.spark, _folder(t, "store"))
    d = t.raw.msf.select(*_COLS)
    store.replace_years(d.where(c("mthcaldt") <= F.lit("1999-06-30").cast("date")), "msf", "mthcaldt", "first")
    INC.incremental_fill(store, d, "msf", "mthcaldt", ["permno", "permco"], "second")
    return t.spark.read.parquet(store.path("msf")).select(*_COLS)


@query("s08_stale_years", "SELECT * FROM (VALUES (1995), (1996), (2001)) v(year)")
def s08(t: Tables) -> DataFrame:
    """Years 1997-2000 were loaded ten days before the check, the others never."""
    store = _store(t, (1997, 2000))
    return store.stale_years("msf", [1995, 1996, 1997, 1998, 1999, 2000, 2001], 30, F.lit("2024-01-11").cast("timestamp"))


@query("s09_load_manifest", """SELECT 'msf' AS "table", year(mthcaldt)::INT AS year, count(*) AS rows, max(mthcaldt) AS max_date, sha1('panel|v1') AS spec_sha FROM t_msf GROUP BY 2""")
def s09(t: Tables) -> DataFrame:
    return _store(t).manifest("msf").select("table", "year", "rows", "max_date", "spec_sha")


@query("s10_fingerprints", "SELECT year(mthcaldt)::INT AS year, count(*) AS rows, max(mthcaldt) AS max_date, 'permno,permco,mthcaldt,mthret,mthprc' AS schema FROM t_msf GROUP BY 1")
def s10(t: Tables) -> DataFrame:
    return _store(t).fingerprints("msf", "mthcaldt")


@query("s11_cache_diagnosis", "SELECT 'missing_year' AS issue, y::VARCHAR AS item FROM (VALUES (1994), (1995), (2000), (2001)) v(y) UNION ALL SELECT 'missing_column', 'vol'")
def s11(t: Tables) -> DataFrame:
    return _store(t, (1996, 1999)).diagnose("msf", 1994, 2001, ["permno", "mthret", "vol"])


@query("s12_project_from_store", "SELECT permno, mthret FROM t_msf WHERE mthcaldt BETWEEN DATE '1996-03-15' AND DATE '1999-08-15'", digits=None)
def s12(t: Tables) -> DataFrame:
    from crosspanel.sources.store import ScanRequest

    return _store(t).project(ScanRequest("msf", ("permno", "mthret"), "mthcaldt", "1996-03-15", "1999-08-15"))


# --- moment matrices ---------------------------------------------------------------------

_CORR = """SELECT a.factor AS row_name, b.factor AS col_name, corr(a.ret, b.ret) AS correlation FROM
  (SELECT * FROM t_factors WHERE factor IN ({f}) AND date IN (SELECT date FROM t_factors WHERE factor IN ({f}) GROUP BY 1 HAVING count(*) = {n})) a
  JOIN (SELECT * FROM t_factors WHERE factor IN ({f})) b USING (date) GROUP BY 1, 2"""


@query("a24_b05_correlation_matrix", _CORR.format(f=", ".join(f"'{b}'" for b in BRANDS), n=len(BRANDS)), "correlation", 6)
def a24(t: Tables) -> DataFrame:
    return MO.correlation_matrix(t.research.factors, BRANDS)


@query("a22_complete_case_covariance", _CORR.format(f=", ".join(f"'{b}'" for b in BRANDS), n=len(BRANDS)).replace("corr(", "covar_samp(").replace("correlation", "covariance"), "covariance", 10)
def a22(t: Tables) -> DataFrame:
    return MO.covariance_matrix(t.research.factors, BRANDS)


@query("a23_mean_variance", "SELECT factor, avg(ret) AS mean, var_pop(ret) AS var_pop, var_samp(ret) AS var_samp FROM t_factors GROUP BY 1", "mean var_pop var_samp", 8)
def a23(t: Tables) -> DataFrame:
    return MO.mean_variance(t.research.factors, "factor")


@query("a25_span_clip", f"""SELECT date, factor, ret FROM t_factors WHERE date >= DATE '1997-01-01' AND date BETWEEN (SELECT min(date) FROM t_factors WHERE year(date) >= 1997) AND (SELECT max(date) FROM t_factors_open WHERE year(date) <= 2000)""", digits=None)
def a25(t: Tables) -> DataFrame:
    a = t.research.factors.where(F.year("date") >= 1997)
    b = t.research.factors_open.where(F.year("date") <= 2000)
    spans = R.stack_tables([x.agg(F.min("date").alias("first"), F.max("date").alias("last")) for x in (a, b)])
    return J.clip_to_common_span(a, spans, "date").select("date", "factor", "ret")


@query("d01_exchange_month_ends", """SELECT date_trunc('month', d)::DATE AS ym, max(d)::DATE AS last_trading_day FROM (
  SELECT unnest(generate_series(ym, last_day(ym), INTERVAL 1 DAY)) AS d FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS ym FROM orders) m) x
  WHERE isodow(d) < 6 AND d <> DATE '1999-05-31' GROUP BY 1""")
def exchange_month_ends(t: Tables) -> DataFrame:
    """Order months mapped to the last exchange trading day of their month."""
    from crosspanel.functions.trading_days import last_trading_days

    months = t.read("orders").select(month_key(c("o_orderdate").cast("date")).alias("ym")).distinct()
    return last_trading_days(months)
