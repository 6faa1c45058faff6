import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosspanel.functions.scalars import orient
from crosspanel.operators import sorts as P
from crosspanel.operators.joins import month_calendar

JUNE, JULY = dt.date(2020, 6, 30), dt.date(2020, 7, 31)


@pytest.fixture(scope="module")
def snapshot(spark):
    rows = [
        (JUNE, "N", 100.0, 0.1), (JUNE, "N", 200.0, 0.5), (JUNE, "N", 300.0, 1.0), (JUNE, "Q", 400.0, 0.9),
        (JULY, "N", 50.0, 0.2), (JULY, "N", 80.0, 0.4), (JULY, "N", 90.0, 0.6), (JULY, "N", 100.0, 0.8),
    ]
    return spark.createDataFrame(rows, "jdate date, primaryexch string, me double, beme double")


def test_breakpoints_and_labels(snapshot):
    size = {r.jdate: r.sizemedn for r in P.size_median(snapshot).collect()}
    assert size == {JUNE: 200.0, JULY: 85.0}
    value = {r.jdate: (r.q30, r.q70) for r in P.exchange_quantiles(snapshot, "beme").collect()}
    assert value == {JUNE: (0.5, 0.5), JULY: (0.4, 0.6)}
    d = snapshot.join(P.size_median(snapshot), "jdate").join(P.exchange_quantiles(snapshot, "beme"), "jdate")
    got = {(r.jdate, r.me): (r.szport, r.chport) for r in P.assign_2x3(d).collect()}
    assert got[(JUNE, 100.0)] == ("S", "L")
    assert got[(JULY, 100.0)] == ("B", "H")
    # The non-NYSE name is labelled although it sets no breakpoint.
    assert got[(JUNE, 400.0)] == ("B", "H")


def test_wide_breakpoints_match_single_samples(snapshot):
    nyse = F.col("primaryexch") == "N"
    wide = {r.jdate: r for r in P.wide_breakpoints(snapshot, {"size": (nyse, F.col("me")), "bm": (nyse, F.col("beme"))}, medians=["size"]).collect()}
    assert wide[JULY].size_med == 85.0 and wide[JUNE].bm_q30 == 0.5 and wide[JULY].bm_q70 == 0.6


def test_value_weighted_returns(spark):
    returns = {"SL": 0.01, "SM": 0.02, "SH": -0.01, "BL": 0.005, "BM": 0.004, "BH": 0.003}
    rows = [(JUNE, r, 1.0, p[0], p[1]) for p, r in returns.items() for _ in range(3)]
    # Null label, zero weight, null weight and null return never count.
    rows += [(JUNE, 9.0, 1.0, None, "L"), (JUNE, 9.0, 0.0, "S", "L"), (JUNE, 9.0, None, "S", "L"), (JUNE, None, 1.0, "S", "L")]
    d = spark.createDataFrame(rows, "jdate date, mthret double, wt double, szport string, chport string")
    out = P.value_weighted_returns(d)
    assert out.columns == ["jdate", "SL", "SM", "SH", "BL", "BM", "BH"]
    row = out.collect()[0]
    for p, r in returns.items():
        assert row[p] == pytest.approx(r)


def test_absent_bucket_is_null(spark):
    d = spark.createDataFrame([(JUNE, 0.1, 2.0, "S", "L")], "jdate date, mthret double, wt double, szport string, chport string")
    row = P.value_weighted_returns(d).collect()[0]
    assert row.SL == pytest.approx(0.1) and row.BH is None


def test_calendar(spark):
    days = [dt.date(2020, 1, 30), dt.date(2020, 1, 31), dt.date(2020, 2, 27), dt.date(2020, 2, 28), dt.date(2020, 3, 31)]
    d = spark.createDataFrame([(x,) for x in [*days, None]], "d date")
    assert sorted(r.date for r in month_calendar(d, "d").collect()) == [days[1], days[3], days[4]]


def test_fallback_breakpoints(spark):
    rows = [(JUNE, "Q", 1.0), (JUNE, "Q", 2.0), (JUNE, "Q", 3.0), (JULY, "N", 5.0), (JULY, "Q", 100.0)]
    d = spark.createDataFrame(rows, "jdate date, primaryexch string, v double")
    got = {r.jdate: (r.q30, r.q70) for r in P.quantiles_with_fallback(d, "v").collect()}
    assert got == {JUNE: (2.0, 2.0), JULY: (5.0, 5.0)}


def test_orientation(spark):
    d = spark.createDataFrame([(3.0, 1.0)], "h double, l double")
    row = d.select(orient(F.col("h"), F.col("l"), "high_minus_low").alias("a"), orient(F.col("h"), F.col("l"), "low_minus_high").alias("b")).collect()[0]
    assert (row.a, row.b) == (2.0, -2.0)
    with pytest.raises(ValueError):
        orient(F.col("h"), F.col("l"), "sideways")
