"""Performance analytics on return series: backtests, drawdowns, regressions."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crosspanel.functions.distributions import student_t_two_sided
from crosspanel.functions.dates import month_end, month_key
from crosspanel.functions.frames import by_entity, cumulative_product, running_max
from crosspanel.operators.joins import align

# The named sub-periods of the published report.
REPORT_PERIODS = (
    ("Start - 2000", None, "1999-12-31"),
    ("2000 - 2008", "2000-01-01", "2007-12-31"),
    ("2008 - 2020", "2008-01-01", "2019-12-31"),
    ("2020 - End", "2020-01-01", None),
)
FULL_SAMPLE = (("Full sample", None, None),)


def period_table(spark: SparkSession, periods: Sequence[tuple[str, str | None, str | None]]) -> DataFrame:
    rows = [(n, s or "0001-01-01", e or "9999-12-31") for n, s, e in periods]
    d = spark.createDataFrame(rows, "period string, s string, e string")
    return d.select("period", F.col("s").cast("date").alias("from"), F.col("e").cast("date").alias("to"))


def split_periods(df: DataFrame, periods: Sequence[tuple[str, str | None, str | None]], date: str = "date") -> DataFrame:
    """Tag rows with every named period their date falls into.

    The periods are a short literal list, so they become an array on the row and
    need no join.
    """
    tags = []
    for name, start, end in periods:
        inside: Column = F.lit(True)
        if start is not None:
            inside = inside & (F.col(date) >= F.lit(start).cast("date"))
        if end is not None:
            inside = inside & (F.col(date) <= F.lit(end).cast("date"))
        tags.append(F.when(inside, F.lit(name)))
    return df.withColumn("period", F.explode(F.array_compact(F.array(*tags))))


def drawdown_path(returns: DataFrame, keys: Sequence[str], ret: str = "ret", date: str = "date") -> DataFrame:
    """Compounded value, running maximum and drawdown per date."""
    w = by_entity(list(keys), date)
    d = returns.withColumn("cumulative", cumulative_product(1.0 + F.col(ret), w))
    d = d.withColumn("running_max", running_max(F.col("cumulative"), w))
    return d.withColumn("drawdown", F.try_divide(F.col("running_max") - F.col("cumulative"), F.col("running_max")))


def backtest(returns: DataFrame, rf: DataFrame, periods: Sequence[tuple[str, str | None, str | None]] = FULL_SAMPLE, name: str = "factor", ret: str = "ret") -> DataFrame:
    """Performance table per series and period.

    The mean risk-free rate covers the dates between the series' first and last
    date in the period.
    """
    tagged = split_periods(returns.where(F.col(ret).isNotNull()), periods)
    path = drawdown_path(tagged, [name, "period"], ret)
    stats = path.groupBy(name, "period").agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count(F.lit(1)).alias("n_periods"),
        F.avg(ret).alias("mean_return"),
        F.stddev_samp(ret).alias("std_return"),
        F.max_by("cumulative", "date").alias("final_value"),
        F.max("drawdown").alias("max_drawdown"),
    )
    # Running sum and count per calendar date, so a mean over a span takes two lookups by date.
    # Ends of spans without a rate of their own carry the sums so far.
    order = Window.orderBy("date")
    ends = stats.select(F.explode(F.array("start_date", "end_date")).alias("date")).distinct()
    dates = rf.select("date", "rf").unionByName(ends.select("date", F.lit(None).cast("double").alias("rf")))
    running = dates.groupBy("date").agg(F.coalesce(F.sum("rf"), F.lit(0.0)).alias("s"), F.count("rf").alias("n")).select(
        "date", "s", "n", F.sum("s").over(order).alias("upto"), F.sum("n").over(order).alias("count")
    )
    begin = running.select(F.col("date").alias("start_date"), (F.col("upto") - F.col("s")).alias("_s0"), (F.col("count") - F.col("n")).alias("_n0"))
    end = running.select(F.col("date").alias("end_date"), F.col("upto").alias("_s1"), F.col("count").alias("_n1"))
    spans = stats.select(name, "period", "start_date", "end_date")
    mean_rf = spans.join(begin, "start_date").join(end, "end_date").select(name, "period", F.try_divide(F.col("_s1") - F.col("_s0"), F.col("_n1") - F.col("_n0")).alias("mean_rf"))
    d = stats.join(mean_rf, [name, "period"], "left")
    ann_ret, ann_std, ann_rf = F.col("mean_return") * 12, F.col("std_return") * F.sqrt(F.lit(12.0)), F.col("mean_rf") * 12
    return d.select(
        "*",
        ann_ret.alias("annualized_return"),
        ann_std.alias("annualized_std"),
        ann_rf.alias("annualized_rf"),
        F.when(ann_std > 0, (ann_ret - ann_rf) / ann_std).alias("sharpe_ratio"),
        (F.col("final_value") - 1.0).alias("total_return"),
    )


def benchmark_correlation(series: DataFrame, benchmarks: DataFrame, periods: Sequence[tuple[str, str | None, str | None]] = FULL_SAMPLE, name: str = "factor", bench: str = "benchmark") -> DataFrame:
    """Correlation with each benchmark on month-end aligned common dates."""
    s = series.select(name, month_end(F.col("date")).alias("date"), F.col("ret").alias("x"))
    b = benchmarks.select(bench, month_end(F.col("date")).alias("date"), F.col("ret").alias("y"))
    both = split_periods(align(s, b, ["date"]), periods)
    return both.groupBy(name, bench, "period").agg(F.count(F.lit(1)).alias("n_observations"), F.corr("x", "y").alias("correlation"))


def single_index(pairs: DataFrame, by: Sequence[str], y: str = "y", x: str = "x", textbook_se: bool = True) -> DataFrame:
    """Regression y = alpha + beta x per group, from closed-form moments.

    ``textbook_se=False`` reproduces the published report, whose intercept error
    uses the mean and variance of the dependent variable instead of the regressor.
    """
    d = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        F.regr_sxx(F.col(y), F.col(x)).alias("_sxx"),
        F.regr_syy(F.col(y), F.col(x)).alias("_syy"),
        F.regr_sxy(F.col(y), F.col(x)).alias("_sxy"),
    ).where(F.col("n") > 2)
    beta = F.try_divide("_sxy", "_sxx")
    m = m.withColumn("beta", beta).withColumn("alpha", F.col("_my") - F.col("beta") * F.col("_mx"))
    mse = (F.col("_syy") - F.col("beta") * F.col("_sxy")) / (F.col("n") - 2)
    centre, scale = (F.col("_mx"), F.col("_sxx")) if textbook_se else (F.col("_my"), F.col("_syy"))
    m = m.withColumn("se_beta", F.sqrt(F.try_divide(mse, F.col("_sxx"))))
    m = m.withColumn("se_alpha", F.sqrt(mse * (1.0 / F.col("n") + F.try_divide(centre * centre, scale))))
    m = m.withColumn("t_alpha", F.when(F.col("se_alpha") > 0, F.col("alpha") / F.col("se_alpha")))
    m = m.withColumn("t_beta", F.when(F.col("se_beta") > 0, F.col("beta") / F.col("se_beta")))
    return m.select(
        *by,
        "n",
        "alpha",
        (F.col("alpha") * 12).alias("alpha_annualized"),
        "beta",
        F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx") * F.col("_syy")).alias("r_squared"),
        "se_alpha",
        "se_beta",
        "t_alpha",
        "t_beta",
    )


def with_p_values(regression: DataFrame) -> DataFrame:
    """Two-sided Student-t p-values of a regression table, as expressions on its rows."""
    df = (F.col("n") - 2).cast("double")
    return regression.withColumns({f"p_{k}": student_t_two_sided(F.col(f"t_{k}"), df) for k in ("alpha", "beta")})


def period_returns(prices: DataFrame, key: str, ts: str, price: str, period: Column | None = None, out: str = "date") -> DataFrame:
    """Last price of each period and its change on the previous period's."""
    bucket = month_key(F.col(ts).cast("date")) if period is None else period
    last = prices.groupBy(key, bucket.alias(out)).agg(F.max_by(price, ts).alias("close"))
    w = Window.partitionBy(key).orderBy(out)
    before = F.lag("close").over(w)
    return last.withColumn("ret", F.when(before != 0, F.col("close") / before - 1.0)).where(F.col("ret").isNotNull())


def cumulative_log_path(returns: DataFrame, keys: Sequence[str], ret: str = "ret", date: str = "date") -> DataFrame:
    """Running sum of log returns; returns of -100% or less are left out."""
    d = returns.where(F.col(ret) > -1.0)
    w = by_entity(list(keys), date).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("cumulative_log", F.sum(F.log1p(ret)).over(w))


def series_average_test(returns: DataFrame, name: str = "factor", ret: str = "ret") -> DataFrame:
    """Mean and its t-statistic."""
    m = returns.groupBy(name).agg(F.avg(ret).alias("avg"), F.stddev_samp(ret).alias("_s"), F.count(ret).alias("n"))
    return m.select(name, "avg", (F.try_divide("avg", "_s") * F.sqrt(F.col("n"))).alias("tstat_avg"))
