import datetime as dt
import re
from collections import defaultdict

from crosspanel.sources import derived as D

SCHEMA = "l_suppkey long, l_shipdate timestamp, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_discount double, l_tax double"


def lines():
    rows = []
    for i in range(400):
        day = dt.datetime(1998, 1, 1) + dt.timedelta(days=(i * 37) % 500)
        rows.append((i % 3, day, "RANX"[i % 4], "OFP"[i % 3], float(i % 50), 100.0 + i, (i % 11) / 100, (i % 9) / 100))
    rows += rows[:5]
    # Nulls in the key, the date, the flags and the price.
    rows += [(None, rows[0][1], "R", "O", 1.0, 5.0, 0.1, 0.1), (1, None, "A", "F", 2.0, 6.0, 0.1, 0.1), (2, rows[3][1], None, None, 3.0, 7.0, 0.0, 0.0)]
    return rows + [(7, rows[1][1], "R", "F", 4.0, None, 0.1, 0.1)]


def cents(*factors):
    out = 100.0
    for x in factors:
        if x is None:
            return None
        out *= x
    return int(out + 0.5)


def added(values):
    known = [v for v in values if v is not None]
    return sum(known) if known else None


def start(day, months):
    return None if day is None else dt.date(day.year, (day.month - 1) // months * months + 1, 1)


def test_months_and_quarters_equal_sums_of_the_lines(spark):
    rows = lines()
    sums = D.line_sums(spark.createDataFrame(rows, SCHEMA).repartition(3)).cache()
    by_month, by_quarter = defaultdict(list), defaultdict(list)
    for r in rows:
        by_month[r[0], start(r[1], 1)].append(r)
        by_quarter[r[0], start(r[1], 3)].append(r)
    months = {(r.permno, r.ym): r for r in D.monthly_sums(sums).collect()}
    assert months.keys() == by_month.keys() and D.monthly_sums(sums).count() == len(months)
    for key, group in by_month.items():
        last = max((r[1].date() for r in group if r[1]), default=None)
        assert tuple(months[key])[2:] == (added(cents(r[5]) for r in group), int(sum(r[4] for r in group)), len(group), last)
    quarters = {(r.k, r.period): r for r in D.quarter_sums(sums).collect()}
    assert quarters.keys() == by_quarter.keys() and D.quarter_sums(sums).count() == len(quarters)
    for key, group in by_quarter.items():
        money = {"c": [cents(r[5]) for r in group], "disc": [cents(r[5], r[6]) for r in group], "tax": [cents(r[5], r[7]) for r in group]}

        def part(name, place, letter, money=money, group=group):
            return added(v if r[place] == letter else 0 for v, r in zip(money[name], group, strict=True))

        q = quarters[key].asDict()
        assert (q["c_all"], q["disc"], q["tax"], q["n"]) == (added(money["c"]), added(money["disc"]), added(money["tax"]), len(group))
        for name, place in (("c", 2), ("c", 3), ("disc", 2), ("tax", 2)):
            for letter in "RANOF":
                if f"{name}_{letter.lower()}" in q and (letter in "OF") == (place == 3):
                    assert q[f"{name}_{letter.lower()}"] == part(name, place, letter)


def test_lines_travel_once_and_unsummed(spark, tmp_path):
    spark.createDataFrame(lines(), SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(3).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    written = {}
    stage, D.stage_table = D.stage_table, lambda df, label: written.setdefault(label, df)
    try:
        D.raw_tables(spark, str(tmp_path))
    finally:
        D.stage_table = stage
    assert len(written) == 1
    plan = next(iter(written.values()))._jdf.queryExecution().executedPlan().toString()
    # Read upwards, the only shuffle comes before the first sum.
    steps = re.findall(r"Exchange|HashAggregate", "\n".join(reversed(plan.splitlines())))
    assert steps[0] == "Exchange" and steps.count("Exchange") == 1
