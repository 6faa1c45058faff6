"""Range-partitioned ranks and carried values against direct computations."""

import random

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import ordered as O

ROWS = "k string, t long, u long, v int"


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_carry_last_equals_a_scan(spark, parts):
    rng = random.Random(parts)
    # One key owns most rows, values are rare, so carries cross several ranges.
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), t, t % 3, t if rng.random() < 0.05 else None) for t in range(600)]
    got = O.carry_last(spark.createDataFrame(rows, ROWS), ["k"], ["t", "u"], "v", "last", parts).collect()
    last, want = {}, []
    for k, t, u, v in rows:
        if k is not None:
            last[k] = v if v is not None else last.get(k)
            want.append((k, t, u, v, last[k]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert O.carry_last(spark.createDataFrame([], ROWS), ["k"], ["t", "u"], "v", "last", parts).count() == 0


def test_one_key_is_spread_over_the_ranges(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    sizes = [r[1] for r in O.ranged(rows, ["k"], ["t"], 8).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5_000


@pytest.mark.parametrize("parts", [1, 4])
def test_average_ranks_with_ties_and_nulls(spark, parts):
    rng = random.Random(9)
    value = lambda: rng.choice([None, 0.0, -0.0, 1.5, float(rng.randrange(40)), rng.random()])
    rows = [(rng.choice(["x", "x", "x", "y", None]), value(), value(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, a double, b double, id int")
    got = {r.id: (r._rank_a, r._rank_b) for r in O.average_ranks(df, ["g"], ["a", "b"], parts=parts).collect()}
    below = lambda x, y: y is not None and (x is None or x < y)

    def rank(g, v, at):
        mates = [r[at] for r in rows if r[0] == g]
        return sum(below(m, v) for m in mates) + (sum(m == v for m in mates) + 1) / 2

    assert got == {i: (rank(g, a, 1), rank(g, b, 2)) for g, a, b, i in rows}
    assert O.average_ranks(df.limit(0), ["g"], ["a"]).count() == 0
