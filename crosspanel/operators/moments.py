"""Moment matrices of long return tables.

Nothing here pairs rows with rows.  A gram matrix is accumulated inside each input
partition over Arrow batches and shuffled as one packed triangle a key and task; asset-factor
covariances are plain partial aggregates over a table that is wide in the (few,
named) factors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

FLUSH_KEYS = 256
LANES = 64
#: Seeds and assets whose fold moments a task holds at once.
SEED_BLOCK, ASSET_BLOCK = 10, 256


def wide_series(long: DataFrame, names: Sequence[str], date: str = "date", name: str = "factor", value: str = "ret") -> DataFrame:
    """One row per date, one column per named series."""
    picked = [F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    return long.where(F.col(name).isin(list(names))).groupBy(date).agg(*picked)


def vector(names: Sequence[str]) -> Column:
    return F.array(*[F.col(n).cast("double") for n in names])


def packed(m: np.ndarray) -> np.ndarray:
    """Upper triangles of the last two axes, row by row."""
    i, j = np.triu_indices(m.shape[-1])
    return m[..., i, j]


def unpacked(state: np.ndarray) -> np.ndarray:
    """The symmetric matrix of a packed triangle."""
    size = int(np.sqrt(2 * len(state)))
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = state
    return m + np.triu(m, 1).T


def merge_states(parts: DataFrame, keys: Sequence[str], states: Sequence[str]) -> DataFrame:
    """Sums of packed matrices per key, as full matrices in row-major arrays.

    ``parts`` has one row a key and task.  They are added up as they stream by, first within
    ``LANES`` lanes a key, then over the lanes, so no task receives the states of all others.
    """
    keys = list(keys)
    fields = [parts.schema[k] for k in keys]
    array = [T.StructField(s, T.ArrayType(T.DoubleType())) for s in states]

    def adder(by: list[str], full: bool):
        def rows(key: tuple, sums: list[np.ndarray]) -> pa.RecordBatch:
            values = [unpacked(x).ravel() if full else x for x in sums]
            return pa.RecordBatch.from_arrays([*[pa.array([k], t) for k, t in zip(key, kinds, strict=True)], *[pa.array([v], pa.list_(pa.float64())) for v in values]], names)

        names = [*by, *states]
        kinds: list[pa.DataType] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, sums = None, None
            for batch in batches:
                kinds[:] = [batch.schema.field(k).type for k in by]
                columns = [batch.column(k).to_pylist() for k in by]
                for i in range(batch.num_rows):
                    key = tuple(c[i] for c in columns)
                    state = [batch.column(s)[i].values.to_numpy(zero_copy_only=False) for s in states]
                    if key == at:
                        sums = [x + y for x, y in zip(sums, state, strict=True)]
                        continue
                    if at is not None:
                        yield rows(at, sums)
                    at, sums = key, state
            if at is not None:
                yield rows(at, sums)

        return run

    lane = T.StructField("_lane", T.IntegerType())
    some = parts.withColumn("_lane", F.spark_partition_id() % LANES).repartition("_lane", *keys).sortWithinPartitions("_lane", *keys)
    some = some.mapInArrow(adder(["_lane", *keys], False), T.StructType([lane, *fields, *array])).drop("_lane")
    every = some.repartition(*keys).sortWithinPartitions(*keys) if keys else some.repartition(1)
    return every.mapInArrow(adder(keys, True), T.StructType([*fields, *array]))


def gram_rows(df: DataFrame, keys: Sequence[str], vec: str, out: str = "gram") -> DataFrame:
    """Sums of x_i x_j per key, index 0 being the constant 1, as one row-major array a key.

    Rows with a null in the vector must be filtered by the caller.
    """
    keys = list(keys)
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def emit(acc: dict) -> pd.DataFrame:
        return pd.DataFrame([(*key, packed(m)) for key, m in acc.items()], columns=[*keys, out])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, g in groups:
                if not len(g):
                    continue
                key = key if isinstance(key, tuple) else (key,)
                x = np.vstack(g[vec].to_numpy())
                x = np.hstack([np.ones((len(x), 1)), x])
                part = x.T @ x
                acc[key] = acc[key] + part if key in acc else part
                if len(acc) >= FLUSH_KEYS:
                    yield emit(acc)
                    acc = {}
        if acc:
            yield emit(acc)

    return merge_states(df.select(*keys, vec).mapInPandas(partial, schema), keys, [out])


def gram(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """The same sums cell by cell: (keys, i, j, s)."""
    flat = gram_rows(df, keys, vec, "_m").select(*keys, F.sqrt(F.size("_m")).cast("int").alias("_size"), F.posexplode("_m").alias("_k", "s"))
    return flat.select(*keys, F.floor(F.col("_k") / F.col("_size")).cast("int").alias("i"), (F.col("_k") % F.col("_size")).alias("j"), "s")


def _pair_table(long: DataFrame, names: Sequence[str], name: str, value: str, out: str, entry) -> DataFrame:
    """Matrix entries over the dates on which every named series has a value.

    ``entry`` builds an entry from the gram accessor, both positions and the count.
    """
    complete = wide_series(long, names, name=name, value=value).dropna(how="any", subset=list(names))
    m = gram_rows(complete.select(vector(names).alias("v")), [], "v", "m")
    p = len(names)
    spots = F.sequence(F.lit(1), F.lit(p))
    cells = m.select("m", F.explode(spots).alias("i")).select("m", "i", F.explode(spots).alias("j"))

    def at(i: Column, j: Column) -> Column:
        return F.get("m", i * (p + 1) + j)

    labels = F.array(*[F.lit(x) for x in names])
    value_of = entry(at, F.col("i"), F.col("j"), at(F.lit(0), F.lit(0)))
    return cells.select(F.element_at(labels, F.col("i")).alias("row_name"), F.element_at(labels, F.col("j")).alias("col_name"), value_of.alias(out))


def _centred_sum(at, i: Column, j: Column, n: Column) -> Column:
    zero = F.lit(0)
    return at(i, j) - at(zero, i) * at(zero, j) / n


def covariance_matrix(long: DataFrame, names: Sequence[str], name: str = "factor", value: str = "ret") -> DataFrame:
    """Complete-case sample covariances as (row_name, col_name, covariance)."""
    return _pair_table(long, names, name, value, "covariance", lambda at, i, j, n: F.try_divide(_centred_sum(at, i, j, n), n - 1))


def correlation_matrix(long: DataFrame, names: Sequence[str], name: str = "factor", value: str = "ret") -> DataFrame:
    """Complete-case correlations as (row_name, col_name, correlation)."""

    def entry(at, i: Column, j: Column, n: Column) -> Column:
        sd = F.sqrt(_centred_sum(at, i, i, n) * _centred_sum(at, j, j, n))
        return F.when(sd > 0, _centred_sum(at, i, j, n) / sd)

    return _pair_table(long, names, name, value, "correlation", entry)


def mean_variance(long: DataFrame, name: str = "factor", value: str = "ret") -> DataFrame:
    """Null-skipping mean and both variances."""
    return long.groupBy(name).agg(
        F.avg(value).alias("mean"), F.var_pop(value).alias("var_pop"), F.var_samp(value).alias("var_samp")
    )


def asset_covariances(assets: DataFrame, wide: DataFrame, controls: Sequence[str], tests: Sequence[str]) -> DataFrame:
    """Per asset: mean return and covariances with controls and test factors.

    Controls use the dates on which all controls exist, each test factor its own
    dates.  Output: (asset, er, cov_h array, cov_g array).
    """
    all_h = F.lit(True)
    for h in controls:
        all_h = all_h & F.col(h).isNotNull()
    d = assets.select("asset", "date", "ret").join(wide, "date", "left")
    d = d.withColumn("_rh", F.when(all_h, F.col("ret")))
    return d.groupBy("asset").agg(
        F.avg("ret").alias("er"),
        F.array(*[F.covar_samp("_rh", h) for h in controls]).alias("cov_h"),
        F.array(*[F.covar_samp("ret", g) for g in tests]).alias("cov_g"),
    )


@dataclass(frozen=True)
class FoldCalendar:
    """Dates with their factor values and, for every seed, their folds.

    Its size is that of the calendar times factors and seeds; neither grows with the assets.
    """

    dates: list
    factors: np.ndarray  # dates x factors
    seeds: list[int]
    folds: np.ndarray  # seeds x dates
    count: int  # of folds

    def indicators(self, some: slice) -> np.ndarray:
        """(seed, fold) x date matrix of a block of seeds."""
        block = self.folds[some]
        return (block[:, None, :] == np.arange(self.count)[None, :, None]).reshape(-1, len(self.dates)).astype(float)


def fold_calendar(wide: DataFrame, folds: DataFrame, names: Sequence[str]) -> FoldCalendar:
    """Collect the calendar of ``folds`` (date, seed, fold); every factor has a value on its dates."""
    by_seed = F.array_sort(F.collect_list(F.struct("seed", "fold"))).alias("folds")
    rows = wide.join(folds.groupBy("date").agg(by_seed), "date").select("date", vector(names).alias("f"), "folds.seed", "folds.fold").orderBy("date").collect()
    seeds = list(rows[0].seed) if rows else []
    table = np.array([r.fold for r in rows], dtype=int).reshape(len(rows), len(seeds)).T
    return FoldCalendar([r.date for r in rows], np.array([r.f for r in rows], dtype=float).reshape(len(rows), len(names)), seeds, table, int(table.max(initial=-1)) + 1)


def fold_vectors(returns: np.ndarray, calendar: FoldCalendar, some: slice) -> tuple[np.ndarray, np.ndarray]:
    """[mean, covariances] of assets outside and inside each fold: (seed, fold) x asset x factor.

    All folds of a block of seeds come from one product of returns, times the factors, with the
    indicator matrix.  A fold of a single date has no covariance (NaN).
    """
    inside = calendar.indicators(some)
    k = calendar.factors.shape[1]
    weights = (inside[:, :, None] * np.concatenate([np.ones((len(calendar.dates), 1)), calendar.factors], axis=1)[None]).transpose(1, 0, 2)
    sums = (returns @ weights.reshape(len(calendar.dates), -1)).reshape(len(returns), len(inside), 1 + k).transpose(1, 0, 2)
    per_seed = sums.reshape(-1, calendar.count, *sums.shape[1:]).sum(axis=1).repeat(calendar.count, axis=0)
    n, f = inside.sum(axis=1), inside @ calendar.factors

    def vectors(s: np.ndarray, n: np.ndarray, f: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            n = np.where(n > 0, n, np.nan)[:, None, None]
            cov = (s[:, :, 1:] - s[:, :, :1] * f[:, None, :] / n) / np.where(n > 1, n - 1, np.nan)
            return np.concatenate([s[:, :, :1] / n, cov], axis=2)

    return vectors(per_seed - sums, len(calendar.dates) - n, calendar.factors.sum(axis=0) - f), vectors(sums, n, f)


def fold_asset_grams(assets: DataFrame, calendar: FoldCalendar) -> DataFrame:
    """(seed, fold, m_train, m_test): grams over assets of [1, mean, covariances] of both sides of a fold.

    An asset is one row with its returns; rows aren't repeated by seed or fold.  A task adds up
    the grams of its assets a few seeds at a time.  Needs complete assets on the calendar.
    """
    spark = assets.sparkSession
    days = spark.createDataFrame([(d,) for d in calendar.dates], assets.select("date").schema)
    rows = assets.join(days, "date", "left_semi").groupBy("asset").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "ret"))), lambda x: x["ret"]).alias("r"))
    schema = "seed int, fold int, m_train array<double>, m_test array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.vstack(pdf["r"].to_numpy()) for pdf in batches if len(pdf)]
        if not held:
            return
        returns = np.vstack(held)
        for first in range(0, len(calendar.seeds), SEED_BLOCK):
            some = slice(first, first + SEED_BLOCK)
            seeds = calendar.seeds[some]
            sums = [0.0, 0.0]
            for at in range(0, len(returns), ASSET_BLOCK):
                for side, v in enumerate(fold_vectors(returns[at : at + ASSET_BLOCK], calendar, some)):
                    v = np.concatenate([np.ones((*v.shape[:2], 1)), v], axis=2)
                    sums[side] = sums[side] + packed(v.transpose(0, 2, 1) @ v)
            yield pd.DataFrame({"seed": np.repeat(seeds, calendar.count), "fold": np.tile(np.arange(calendar.count), len(seeds)), "m_train": list(sums[0]), "m_test": list(sums[1])})

    return merge_states(rows.select("r").mapInPandas(run, schema), ["seed", "fold"], ["m_train", "m_test"])
