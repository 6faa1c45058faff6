import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions.dates import parse_mixed_date
from crosspanel.functions.distributions import student_t_two_sided
from crosspanel.functions.trading_days import last_trading_days
from crosspanel.operators import compare as C, performance as B


def test_student_t_known_values(spark):
    # Two-sided tail areas from published tables.
    known = [(2.0, 10.0, 0.07339), (-2.571, 5.0, 0.04998), (12.706, 1.0, 0.05), (1.96, 1e6, 0.05), (0.0, 3.0, 1.0), (float("nan"), 3.0, None), (None, 3.0, None), (1.0, 0.0, None)]
    rows = spark.createDataFrame(known, "t double, df double, p double").withColumn("got", student_t_two_sided(F.col("t"), F.col("df"))).collect()
    for r in rows:
        assert r.got is None if r.p is None else r.got == pytest.approx(r.p, abs=2e-4)


def test_student_t_closed_forms(spark):
    """One and two degrees of freedom have closed forms; tails stay accurate far out."""
    rows = spark.createDataFrame([(float(x),) for x in (0.01, 0.5, 1, 3, 40, 1e4)], "t double")
    for r in rows.select("t", student_t_two_sided(F.col("t"), F.lit(1.0)).alias("one"), student_t_two_sided(F.col("t"), F.lit(2.0)).alias("two")).collect():
        assert r.one == pytest.approx(2 / np.pi * np.arctan(1 / r.t), rel=1e-9)
        root = np.sqrt(2 + r.t**2)
        assert r.two == pytest.approx(2 / (root * (root + r.t)), rel=1e-9)


def test_last_trading_days(spark):
    # Month ends moved by weekends, Good Friday, Memorial Day and New Year's Eve.
    want = {
        dt.date(2024, 3, 1): dt.date(2024, 3, 28),
        dt.date(2021, 5, 1): dt.date(2021, 5, 28),
        dt.date(2020, 5, 1): dt.date(2020, 5, 29),
        dt.date(2012, 10, 1): dt.date(2012, 10, 31),
        dt.date(2004, 2, 1): dt.date(2004, 2, 27),
        dt.date(2022, 12, 1): dt.date(2022, 12, 30),
    }
    d = spark.createDataFrame([(k,) for k in want], "ym date")
    assert {r.ym: r.last_trading_day for r in last_trading_days(d).collect()} == want


def test_easter(spark):
    from crosspanel.functions.trading_days import easter_sunday

    want = {1997: (3, 30), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2019: (4, 21), 2024: (3, 31), 2038: (4, 25)}
    d = spark.createDataFrame([(y,) for y in want], "y int")
    got = {r.y: (r.e.month, r.e.day) for r in d.select("y", easter_sunday(F.col("y")).alias("e")).collect()}
    assert got == want


def test_mixed_dates(spark):
    d = spark.createDataFrame([("2020-01-31",), ("20200131",), ("202001",), ("20200131.0",), ("junk",), (None,)], "s string")
    got = [r.d for r in d.select(parse_mixed_date(F.col("s")).alias("d")).collect()]
    assert got == [dt.date(2020, 1, 31), dt.date(2020, 1, 31), dt.date(2020, 1, 1), dt.date(2020, 1, 31), None, None]


def series(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    days = pd.date_range("1998-01-31", periods=n, freq="ME")
    a, b = rng.normal(0.01, 0.04, n), rng.normal(0.01, 0.04, n)
    b = 0.7 * a + 0.3 * b
    mk = lambda x: spark.createDataFrame([("f", d.date(), float(v)) for d, v in zip(days, x)], "factor string, date date, ret double")
    return days, a, b, mk(a), mk(b)


def test_backtest_against_pandas(spark):
    days, a, _, A, _ = series(spark)
    rf = spark.createDataFrame([(d.date(), 0.002) for d in days], "date date, rf double")
    row = B.backtest(A, rf).collect()[0]
    cum = np.cumprod(1 + a)
    peak = np.maximum.accumulate(cum)
    assert row.final_value == pytest.approx(cum[-1])
    assert row.max_drawdown == pytest.approx(((peak - cum) / peak).max())
    assert row.sharpe_ratio == pytest.approx((a.mean() * 12 - 0.024) / (a.std(ddof=1) * np.sqrt(12)))
    periods = {r.period: r.n_periods for r in B.backtest(A, rf, B.REPORT_PERIODS).collect()}
    assert periods == {"Start - 2000": 24, "2000 - 2008": 36}


def test_regression_both_error_formulas(spark):
    _, x, y, X, Y = series(spark)
    pairs = C.paired(X, Y).select("factor", F.col("a").alias("x"), F.col("b").alias("y"))
    row = B.with_p_values(B.single_index(pairs, ["factor"])).collect()[0]
    n = len(x)
    design = np.column_stack([np.ones(n), x])
    coef = np.linalg.lstsq(design, y, rcond=None)[0]
    resid = y - design @ coef
    cov = np.linalg.inv(design.T @ design) * (resid @ resid / (n - 2))
    assert (row.alpha, row.beta) == (pytest.approx(coef[0]), pytest.approx(coef[1]))
    assert (row.se_alpha, row.se_beta) == (pytest.approx(np.sqrt(cov[0, 0])), pytest.approx(np.sqrt(cov[1, 1])))
    assert 0 < row.p_beta < 1e-6
    report = B.single_index(pairs, ["factor"], textbook_se=False).collect()[0]
    mse = resid @ resid / (n - 2)
    assert report.se_alpha == pytest.approx(np.sqrt(mse * (1 / n + y.mean() ** 2 / (y.var(ddof=1) * (n - 1)))))


@pytest.mark.parametrize("z", [False, True])
def test_replication_metrics(spark, z):
    _, a, b, A, Bf = series(spark)
    row = C.replication_metrics(C.paired(A, Bf), standardise=z).collect()[0]
    if z:
        a, b = (a - a.mean()) / a.std(ddof=1), (b - b.mean()) / b.std(ddof=1)
    err = a - b
    assert row.n == len(a)
    assert row.rmse == pytest.approx(np.sqrt((err**2).mean()))
    assert row.spearman == pytest.approx(pd.Series(a).rank().corr(pd.Series(b).rank()))
    ccc = 2 * np.cov(a, b)[0, 1] / (a.var(ddof=1) + b.var(ddof=1) + (a.mean() - b.mean()) ** 2)
    assert row.ccc == pytest.approx(ccc)


def test_tied_ranks(spark):
    d = spark.createDataFrame([("f", 1.0, 1.0), ("f", 1.0, 2.0), ("f", 3.0, 2.0), ("f", 4.0, 5.0)], "factor string, a double, b double")
    row = C.replication_metrics(d).collect()[0]
    assert row.spearman == pytest.approx(pd.Series([1, 1, 3, 4.0]).rank().corr(pd.Series([1, 2, 2, 5.0]).rank()))


def test_period_returns_and_log_path(spark):
    rows = [("s", dt.datetime(2020, m, d), float(v)) for m, d, v in ((1, 3, 10), (1, 30, 20), (2, 5, 7), (2, 27, 30), (3, 2, 15))]
    d = spark.createDataFrame(rows, "k string, ts timestamp, p double")
    got = {r.date: r.ret for r in B.period_returns(d, "k", "ts", "p").collect()}
    assert got == {dt.date(2020, 2, 1): 0.5, dt.date(2020, 3, 1): -0.5}
    s = spark.createDataFrame([("f", dt.date(2020, 1, 1), 0.1), ("f", dt.date(2020, 2, 1), -1.0), ("f", dt.date(2020, 3, 1), 0.2)], "factor string, date date, ret double")
    out = B.cumulative_log_path(s, ["factor"]).orderBy("date").collect()
    assert [r.cumulative_log for r in out] == [pytest.approx(np.log(1.1)), pytest.approx(np.log(1.1) + np.log(1.2))]
