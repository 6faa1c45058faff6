import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import joins as J, rows as R


def day(n):
    return dt.date(2000, 1, 1) + dt.timedelta(days=n)


def test_interval_join_open_end_and_overlap(spark):
    left = spark.createDataFrame([(1, day(5)), (1, day(50)), (2, day(5))], "k int, d date")
    right = spark.createDataFrame([(1, day(0), day(10), "a"), (1, day(5), None, "b")], "k int, s date, e date, x string")
    out = J.interval_join(left, right, ["k"], "d", "s", "e", ["x"])
    assert sorted((r.k, r.d, r.x or "") for r in out.collect()) == [(1, day(5), "a"), (1, day(5), "b"), (1, day(50), "b"), (2, day(5), "")]


def test_banded_join_equals_plain_join(spark):
    rng = random.Random(8)
    left = [(rng.choice([0, 0, 0, 1, 2, None]), day(rng.randrange(400)) if rng.random() < 0.95 else None, i) for i in range(300)] + [(0, day(7), 1000)] * 2
    right = []
    for i in range(250):
        s = rng.randrange(400)
        right.append((rng.choice([0, 0, 1, 3]), day(s) if i % 20 else None, None if i % 9 == 0 else day(s + rng.choice([0, 1, 5, 63, 64, 300, -2])), f"x{i}"))
    L = spark.createDataFrame(left, "k int, d date, id int")
    R_ = spark.createDataFrame(right, "k int, s date, e date, x string")
    for how in ("left", "inner"):
        got, want = ([tuple(r) for r in f(L, R_, ["k"], "d", "s", "e", ["x"], how=how).collect()] for f in (J.banded_interval_join, J.interval_join))
        assert sorted(got, key=str) == sorted(want, key=str)
    assert J.banded_interval_join(L, R_.limit(0), ["k"], "d", "s", "e", ["x"]).count() == len(left)


def test_candidates_of_a_dense_key_stay_near_the_matches(spark):
    """One key with 10,000 intervals and a million rows: rows that meet, against rows that match."""
    spans = spark.range(10_000).select(F.lit(1).alias("k"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 5000).cast("int")).alias("s"), F.col("id").alias("x"))
    spans = spans.withColumn("e", F.date_add("s", (F.col("x") % 3).cast("int")))
    rows = spark.range(1_000_000).select(F.lit(1).alias("k"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 5000).cast("int")).alias("d"))
    out = J.banded_interval_join(rows, spans, ["k"], "d", "s", "e", ["x"], how="inner")
    matches = out.count()
    assert matches == rows.groupBy("d").count().join(spans, F.expr("d BETWEEN s AND e")).agg(F.sum("count")).first()[0]
    met = J.banded_interval_join(rows, spans, ["k"], "d", "s", "e", ["x"], how="candidates").count()
    assert matches <= met <= 4 * matches


@pytest.mark.parametrize("ranges", [False, True])
@pytest.mark.parametrize("unique", [False, True])
def test_asof_join_against_brute_force(spark, unique, ranges):
    rng = random.Random(3)
    # Key 0 owns most rows on both sides.
    keys = lambda n: [0 if rng.random() < 0.6 else rng.randrange(1, 5) for _ in range(n)]
    right = [(k, day(rng.randrange(60)), rng.randrange(4), i) for i, k in enumerate(keys(150))]
    right.append((0, None, 0, 999))
    left = [(k, day(rng.randrange(70)), i) for i, k in enumerate(keys(120))]
    if unique:
        left = list({(k, d): (k, d, i) for k, d, i in left}.values())
    L = spark.createDataFrame(left, "k int, d date, id int")
    Rt = spark.createDataFrame(right, "k int, r date, tie int, v int")
    out = J.asof_join(L, Rt, ["k"], "d", "r", ["tie", "v"], ["r", "v"], left_unique=unique, ranges=ranges)
    got = sorted((x.id, x.k, x.d, x.r, x.v) for x in out.collect())
    want = []
    for k, d, i in left:
        hits = [(r, t, v) for kk, r, t, v in right if kk == k and r is not None and r <= d]
        if hits:
            r, _, v = max(hits)
            want.append((i, k, d, r, v))
    assert got == sorted(want)


def test_links(spark):
    links = spark.createDataFrame(
        [("g1", 1, "LC", "P", day(0), None), ("g1", 2, "NR", "P", day(0), None), ("g2", 3, "LU", "J", day(0), day(9))],
        "gvkey string, lpermno long, linktype string, linkprim string, linkdt date, linkenddt date",
    )
    kept = J.usable_links(links, "2001-12-31").collect()
    assert [(r.permno, r.linkenddt) for r in kept] == [(1, dt.date(2001, 12, 31))]


def test_overlay_and_merges(spark):
    a = spark.createDataFrame([(day(1), 1.0, None), (day(2), None, None)], "date date, x double, y double")
    b = spark.createDataFrame([(day(1), 9.0, 5.0), (day(3), 7.0, None)], "date date, x double, y double")
    got = {r.date: (r.x, r.y) for r in J.overlay(a, b, "date").collect()}
    assert got == {day(1): (1.0, 5.0), day(3): (7.0, None)}
    merged = J.inner_merge({"a": a, "b": b})
    assert set(merged.columns) == {"date", "x", "y", "x__b", "y__b"}
    assert [(r.date, r.x, r.x__b) for r in merged.collect()] == [(day(1), 1.0, 9.0)]


def test_keep_last_and_reports(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, o int, v string")
    assert sorted((r.k, r.v or "") for r in R.keep_last(d, ["k"], ["o"]).collect()) == [(1, "b"), (2, "")]
    assert sorted((r.k, r.v or "") for r in R.keep_first(d, ["k"], ["o"]).collect()) == [(1, "a"), (2, "")]
    have = spark.createDataFrame([("x",), ("y",)], "f string")
    want = spark.createDataFrame([("y",), ("z",)], "f string")
    assert sorted(tuple(r) for r in R.missing_and_extra(have, want, "f").collect()) == [("x", "extra"), ("z", "missing")]


def test_reindex(spark):
    cal = spark.createDataFrame([(day(1),), (day(2),)], "date date")
    s = spark.createDataFrame([(day(1), 1.0)], "date date, v double")
    assert {r.date: r.v for r in J.reindex(s, cal).collect()} == {day(1): 1.0, day(2): None}
