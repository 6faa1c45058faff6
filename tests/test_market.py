import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosspanel.plans import factors as FA, market as M
from crosspanel.plans.extracts import BaseTables
from crosspanel.plans.factors import REGISTRY, FactorSpec, build_factor, register_factor, with_panel

SCHEMA = "permno long, permco long, mthcaldt date, primaryexch string, mthret double, mthretx double, shrout double, mthprc double"


def month_end(i):
    y, m = 1999 + (i + 4) // 12, (i + 4) % 12 + 1
    return (dt.date(y + m // 12, m % 12 + 1, 1)) - dt.timedelta(days=1)


def test_weights_follow_the_july_june_year(spark):
    # One security, May 1999 to August 2000, with a gap in December 1999.
    rows = [(1, 1, month_end(i), "N", 0.01, 0.1, 10.0, -(5.0 + i)) for i in range(16) if i != 7]
    panel = {r.jdate: r for r in M.market_panel(spark.createDataFrame(rows, SCHEMA)).collect()}
    first = panel[month_end(0)]
    assert first.lme == pytest.approx(50.0 / 1.1)
    july = panel[dt.date(1999, 7, 31)]
    june = panel[dt.date(1999, 6, 30)]
    assert july.wt == pytest.approx(june.me) and june.me == pytest.approx(60.0)
    assert panel[dt.date(1999, 9, 30)].wt == pytest.approx(june.me * 1.1 * 1.1)
    assert panel[dt.date(2000, 6, 30)].dec_me is None
    # Before the first July there is no base, so no weight.
    assert june.wt is None


def test_company_collapse_keeps_ties_and_sums(spark):
    d = dt.date(2000, 6, 30)
    rows = [(1, 7, d, 30.0), (2, 7, d, 20.0), (3, 8, d, 5.0), (4, 8, d, 5.0), (4, 8, d, 5.0)]
    out = M.collapse_companies(spark.createDataFrame(rows, "permno long, permco long, jdate date, me double"))
    got = sorted((r.permno, r.me) for r in out.collect())
    # The duplicate row counts in the sum, as exact duplicates drop only afterwards.
    assert got == [(1, 50.0), (3, 15.0), (4, 15.0)]


def test_missing_returns_are_zero_only_in_the_june_chain(spark):
    rows = [(1, 1, month_end(i), "N", None if i == 2 else 0.1, 0.0, 10.0, 5.0) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.mthret for r in M.market_panel(df).orderBy("jdate").collect()] == [0.1, 0.1, 0.0, 0.1]
    liq = M.liquidity_panel(df.withColumn("vol", F.lit(1.0)).withColumn("exchcd", F.lit(1)))
    assert [r.mthret for r in liq.orderBy("jdate").collect()] == [0.1, 0.1, None, 0.1]


def test_registry_is_closed_under_duplicates():
    assert len(REGISTRY) == 36
    with pytest.raises(ValueError):
        register_factor(FactorSpec("saleinv", "june", lambda: F.col("saleinv")))
    with pytest.raises(KeyError):
        build_factor(None, "no_such_factor")


@pytest.fixture(scope="module")
def base(spark):
    from catalog.registry import tables_for

    return tables_for(spark, "/root/testdata/sf0.01").base


def test_opposite_orientation_flips_the_sign(base):
    spec = REGISTRY["saleinv"]
    flipped = FactorSpec("flip", "june", spec.value, FA.LMH)
    wide = FA.build_factors(base, ["saleinv", "flip"], registry={"saleinv": spec, "flip": flipped})
    pairs = [(r.saleinv, r.flip) for r in wide.collect() if r.saleinv is not None]
    assert pairs and all(a == pytest.approx(-b) for a, b in pairs)


def test_window_keeps_the_values_of_the_full_history(base):
    full = {r.date: r.saleinv for r in build_factor(base, "saleinv").collect()}
    part = {r.date: r.saleinv for r in build_factor(base, "saleinv", "1999-01-01", "2000-06-30").collect()}
    assert len(part) == 18 and min(part) >= dt.date(1999, 1, 1)
    for d, v in part.items():
        assert v == pytest.approx(full[d], rel=1e-9)


def test_labels_partition_the_valid_names(base):
    spec = REGISTRY["saleinv"]
    june = FA.june_frame(base, FA._with_first_month(base.panel), [spec])
    labels = FA.june_labels(june, [spec])
    n = {r.permno: len(r.labels) for r in labels.collect()}
    assert set(n.values()) <= {0, 1}
    valid = june.where(F.col("v_saleinv").isNotNull() & (F.col("me") > 0)).count()
    assert labels.where(F.size("labels") == 1).count() == valid


def test_zero_denominators_give_null_not_errors(spark):
    # A total loss in the first month and a zero price stay in the panel as missing.
    rows = [(1, 1, month_end(0), "N", -1.0, -1.0, 10.0, 5.0), (1, 1, month_end(1), "N", 0.0, 0.0, 10.0, 0.0), (1, 1, month_end(2), "N", 0.0, 0.0, 0.0, 5.0)]
    out = M.market_panel(spark.createDataFrame(rows, SCHEMA)).orderBy("jdate").collect()
    assert out[0].lme is None and out[1].me == 0.0
    d = spark.createDataFrame(rows, SCHEMA).withColumn("vol", F.lit(3.0)).withColumn("exchcd", F.lit(3))
    liq = M.liquidity_panel(d).orderBy("jdate").collect()
    assert [r.turnover is None for r in liq] == [False, False, True]
    assert [r.ldolvol is None for r in liq] == [False, True, False]


def test_companies_without_a_price_stay_with_equity_zero(spark):
    d = dt.date(2000, 6, 30)
    rows = [(1, 7, d, None), (2, 7, d, None), (3, 8, d, 5.0), (4, 8, d, None), (5, 9, None, None)]
    out = M.collapse_companies(spark.createDataFrame(rows, "permno long, permco long, jdate date, me double"))
    assert sorted((r.permno, r.me) for r in out.collect()) == [(1, 0.0), (2, 0.0), (3, 5.0)]
