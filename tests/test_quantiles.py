import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from crosspanel.operators import quantiles as Q
from crosspanel.operators.quantiles import Quantile, grouped_median, grouped_quantiles

SPECS = [Quantile("q30", 0.3), Quantile("q70", 0.7), Quantile("med", 0.5, "linear"), Quantile("l30", 0.3, "linear")]


def expected(values):
    v = np.sort(np.asarray(values, float))
    n = len(v)
    near = lambda q: v[int(np.rint((n - 1) * q))]
    return near(0.3), near(0.7), np.median(v), np.quantile(v, 0.3)


def check(df, pdf):
    got = {r.k: (r.q30, r.q70, r.med, r.l30) for r in df.collect()}
    for k, g in pdf.dropna().groupby("k"):
        assert got[k] == pytest.approx(expected(g.v), rel=1e-12)
    assert set(got) == set(pdf.dropna().k)


@pytest.mark.parametrize("bad", [False, True])
def test_exact_with_good_and_misleading_sketches(spark, monkeypatch, bad):
    """Groups of every size, and brackets that miss nearly all ranks at first."""
    if bad:
        monkeypatch.setattr(Q, "_first_brackets", lambda rows, keys, targets, accuracy: rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.array(*[F.struct(F.max("_v").alias("low"), (F.max("_v") + 1).alias("high")) for _ in targets]).alias("_b")))
    rng = np.random.default_rng(1)
    parts = [pd.DataFrame({"k": k, "v": rng.normal(size=n)}) for k, n in (("a", 4001), ("b", 750), ("c", 3), ("d", 1))]
    # One value owns a third of a group; one group is a single value.
    tied = pd.DataFrame({"k": "t", "v": np.where(rng.random(3000) < 0.35, 0.25, rng.normal(size=3000))})
    flat = pd.DataFrame({"k": "f", "v": np.full(500, 7.0)})
    nulls = pd.DataFrame({"k": "n", "v": [None, 1.0, 2.0, float("nan")]})
    pdf = pd.concat([*parts, tied, flat, nulls], ignore_index=True)
    df = spark.createDataFrame(pdf.astype({"v": float})).repartition(5)
    check(grouped_quantiles(df, ["k"], "v", SPECS, accuracy=40 if bad else 400), pdf)


def test_ranks_in_ever_smaller_gaps(spark, monkeypatch):
    """A sketch that shows only the least value of a gap still ends with the exact rank."""
    monkeypatch.setattr(Q.F, "percentile_approx", lambda column, points, accuracy: F.transform(points, lambda p: F.min(column)))
    pdf = pd.DataFrame({"k": "x", "v": [1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 9.0]})
    rows = spark.createDataFrame(pdf)
    monkeypatch.setattr(Q, "_first_brackets", lambda rows, keys, targets, accuracy: rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.struct(F.min("_v").alias("low"), F.min("_v").alias("high")) for _ in targets]).alias("_b")))
    check(grouped_quantiles(rows, ["k"], "v", SPECS), pdf)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60))
def test_small_groups(spark, values):
    pdf = pd.DataFrame({"k": "x", "v": [float(x) for x in values]})
    check(grouped_quantiles(spark.createDataFrame(pdf), ["k"], "v", SPECS), pdf)


def test_half_even_position(spark):
    # (n - 1) * 0.3 = 1.5 for n = 6 rounds to 2; (n - 1) * 0.7 = 3.5 rounds to 4.
    d = spark.createDataFrame([("a", float(i)) for i in range(6)], "k string, v double")
    row = grouped_quantiles(d, ["k"], "v", SPECS[:2]).collect()[0]
    assert (row.q30, row.q70) == (2.0, 3.0 if np.rint(5 * 0.7) == 3 else 4.0)


def test_median(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, v double")
    assert {r.k: r.median for r in grouped_median(d, ["k"], "v").collect()} == {"a": 1.5, "b": 5.0}
