"""Exact order statistics per group, without gathering a group in one task.

A cross-section (all securities of a month) has no size bound, so sorting it in
one window task does not scale.  The plan works with brackets, one per wanted rank:

1. one partially aggregated pass gives each group's size and a mergeable sketch of
   the wanted quantiles; a bracket reaches four times the sketch's error, and two
   ranks at least, to either side of its rank;
2. rows outside every bracket collapse to counts per gap, rows inside to counts per
   distinct value, both by partial aggregation, so ties cost one row;
3. a running count over what is left picks the order statistics.

The counts of the gaps are exact.  A rank that turns out to lie in a gap gets a new
bracket there, from a sketch of the rows of that gap, and its group goes through steps
2 and 3 again.  A bracket holds at least one value of its gap, so gaps shrink until every
rank is inside: the result is exact however bad a sketch is, for groups of every size.

The group statistics of step 1 are written before step 2, so the planner knows their
true size: a small table is broadcast and the rows are not shuffled by group at all,
a large one (very many groups) gets a shuffled join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosspanel.session import stage_table


INFINITE = float("inf")
#: Steps of the sketch by which a gap is bracketed anew.
GRID = 64


@dataclass(frozen=True)
class Quantile:
    """``nearest`` takes the order statistic at the half-even rounded position,
    ``linear`` interpolates between the two neighbours of the position."""

    name: str
    q: float
    method: str = "nearest"

    def __post_init__(self) -> None:
        if self.method not in ("nearest", "linear"):
            raise ValueError(f"unknown quantile method {self.method!r}")


MEDIAN = Quantile("median", 0.5, "linear")


def _ranks(q: Quantile, n: Column) -> list[Column]:
    """The ranks (from 1) that a quantile of ``n`` values needs."""
    pos = (n - 1).cast("double") * F.lit(float(q.q))
    if q.method == "nearest":
        return [(F.rint(pos) + 1).cast("long")]
    return [(F.floor(pos) + 1).cast("long"), (F.ceil(pos) + 1).cast("long")]


def _first_brackets(rows: DataFrame, keys: list[str], targets: list[Quantile], accuracy: int) -> DataFrame:
    """(keys, _n, _b): size and a (low, high) bracket per target."""
    slack = 4.0 / accuracy
    points = sorted({p for t in targets for p in (max(t.q - slack, 0.0), min(t.q + slack, 1.0))})
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(p) for p in points]), F.lit(accuracy)).alias("_p"))
    wide = F.col("_n") * slack >= 2

    def wall(p: float, open_: float) -> Column:
        inner = 0.0 < p < 1.0
        return F.when(wide, F.col("_p")[points.index(p)]).otherwise(F.lit(open_)) if inner else F.lit(open_)

    sides = [F.struct(wall(max(t.q - slack, 0.0), -INFINITE).alias("low"), wall(min(t.q + slack, 1.0), INFINITE).alias("high")) for t in targets]
    return stats.select(*keys, "_n", F.array(*sides).alias("_b"))


def _located(rows: DataFrame, brackets: DataFrame, keys: list[str], targets: list[Quantile], ranks: list[tuple[Quantile, int]]) -> DataFrame:
    """(keys, _n, _hit, _gap): per target its value, or the gap in which its rank lies."""
    count = len(targets)
    v, sides = F.col("_v"), [F.col("_b")[i] for i in range(count)]
    inside = F.lit(False)
    for b in sides:
        inside = inside | ((v >= b["low"]) & (v <= b["high"]))
    # A row outside is known by the nearest bracket end below it.
    anchor = F.greatest(F.lit(None).cast("double"), *[F.when(v > b["high"], b["high"]) for b in sides])
    kept = rows.join(brackets, keys).select(*keys, "_n", F.when(inside, v).otherwise(anchor).alias("_a"), F.when(inside, 0).otherwise(1).alias("_outside"))
    counts = kept.groupBy(*keys, "_n", "_a", "_outside").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.col("_a").asc_nulls_first(), "_outside")
    placed = counts.withColumns({"_hi": F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("_a").over(w)})
    hits, gaps = [], []
    for q, k in ranks:
        rank = _ranks(q, F.col("_n"))[k]
        here = (F.col("_hi") - F.col("_c") < rank) & (rank <= F.col("_hi"))
        hits.append(F.max(F.when(here & (F.col("_outside") == 0), F.col("_a"))))
        gap = F.struct(F.col("_a").alias("left"), F.col("_next").alias("right"), ((rank - (F.col("_hi") - F.col("_c")) - 0.5) / F.col("_c")).alias("share"))
        gaps.append(F.max(F.when(here & (F.col("_outside") == 1), gap)))
    return placed.groupBy(*keys, "_n").agg(F.array(*hits).alias("_hit"), F.array(*gaps).alias("_gap"))


def _new_brackets(rows: DataFrame, missed: DataFrame, brackets: DataFrame, keys: list[str], accuracy: int) -> DataFrame:
    """Brackets of the groups in ``missed``, those of missed ranks taken anew inside their gaps."""
    gaps = missed.select(*keys, F.posexplode("_gap").alias("_t", "_g")).where(F.col("_g").isNotNull()).select(*keys, "_t", "_g.*")
    beyond = (F.col("left").isNull() | (F.col("_v") > F.col("left"))) & (F.col("right").isNull() | (F.col("_v") < F.col("right")))
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    sketch = rows.join(gaps, keys).where(beyond).groupBy(*keys, "_t", "share").agg(F.percentile_approx("_v", grid, F.lit(accuracy)).alias("_p"))
    # One step of the grid more on either side than the share asks for.
    low = F.greatest(F.floor(F.col("share") * GRID) - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil(F.col("share") * GRID) + 1, F.lit(GRID)).cast("int")
    found = sketch.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_t", F.struct(F.get("_p", low).alias("low"), F.get("_p", high).alias("high"))))).alias("_new"))
    merged = F.transform("_b", lambda b, i: F.coalesce(F.try_element_at("_new", i), b))
    return found.join(brackets, keys).select(*keys, "_n", merged.alias("_b"))


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[Quantile], accuracy: int = 400) -> DataFrame:
    """One row per group with a column per requested quantile; nulls and NaN are ignored."""
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ranks = [(q, k) for q in quantiles for k in range(1 if q.method == "nearest" else 2)]
    targets = [q for q, _ in ranks]
    brackets = stage_table(_first_brackets(rows, keys, targets, accuracy), "groups")
    found = stage_table(_located(rows, brackets, keys, targets, ranks), "ranks")
    parts = []
    while True:
        open_ = F.exists("_gap", lambda g: g.isNotNull())
        parts.append(found.where(~open_))
        missed = found.where(open_)
        if missed.isEmpty():
            break
        brackets = stage_table(_new_brackets(rows, missed, brackets, keys, accuracy), "groups")
        found = stage_table(_located(rows, brackets, keys, targets, ranks), "ranks")
    values: list[Column] = []
    for q in quantiles:
        at = [F.col("_hit")[i] for i, t in enumerate(ranks) if t[0] is q]
        if q.method == "nearest":
            values.append(at[0].alias(q.name))
        else:
            pos = (F.col("_n") - 1).cast("double") * F.lit(float(q.q))
            values.append((at[0] + (at[1] - at[0]) * (pos - F.floor(pos))).alias(q.name))
    return reduce(DataFrame.unionByName, parts).select(*keys, *values, F.col("_n").alias("n_obs"))


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group (mean of the two middle values when even)."""
    return grouped_quantiles(df, keys, value, [Quantile(name, 0.5, "linear")]).drop("n_obs")
