"""Factor-testing queries: moments, selections, risk prices and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.registry import Tables, query
from catalog.sql_tables import table
from crosspanel.plans import double_selection as DS

c = F.col
CONTROLS = [f"Brand{i}" for i in range(1, 22)]
TESTS = [f"Brand{i}" for i in range(22, 26)]
THREE = CONTROLS[:3]
FOUR = CONTROLS[:4]
LAMBDA1, LAMBDA2 = 5e-9, 1e-10
#: As many random fold assignments as the published job averages.
CV_SEEDS = range(1, 201)


def inputs(t: Tables, controls=CONTROLS, tests=TESTS) -> DS.SelectionInputs:
    cache = t.__dict__.setdefault("_selection", {})
    key = (tuple(controls), tuple(tests))
    if key not in cache:
        cache[key] = DS.prepare(tested_factors(t), t.research.assets, controls, tests)
    return cache[key]


def tested_factors(t: Tables) -> DataFrame:
    """The factors, the last test factor with a short history of its own."""
    return t.research.factors.where(~((c("factor") == "Brand25") & (c("date") < F.lit("1995-01-01").cast("date"))))


_H = ", ".join(f"'{b}'" for b in CONTROLS)
_G = ", ".join(f"'{b}'" for b in TESTS)
table("t_sel", "SELECT * FROM t_factors WHERE NOT (factor = 'Brand25' AND date < DATE '1995-01-01')")
table("t_asset_months", "SELECT date FROM t_assets GROUP BY 1 HAVING count(ret) = (SELECT count(DISTINCT asset) FROM t_assets)")
table("t_h_dates", f"SELECT date FROM t_sel WHERE factor IN ({_H}) GROUP BY 1 HAVING count(*) = {len(CONTROLS)}")
table("t_cov", f"""SELECT a.asset, f.factor, covar_samp(a.ret, f.ret) AS cov FROM t_assets a JOIN t_sel f USING (date)
  WHERE date IN (SELECT date FROM t_asset_months) AND (factor IN ({_G}) OR factor IN ({_H}) AND date IN (SELECT date FROM t_h_dates)) GROUP BY 1, 2""")


@query("e01_asset_factor_covariances", "SELECT asset, factor, cov FROM t_cov", "cov", 10)
def e01(t: Tables) -> DataFrame:
    x = inputs(t)
    names = F.array(*[F.lit(n) for n in CONTROLS + TESTS])
    return x.asset_cov.select("asset", F.explode(F.arrays_zip(names.alias("factor"), F.concat("cov_h", "cov_g").alias("cov"))).alias("e")).select("asset", "e.factor", "e.cov")


@query("e02_penalty_loadings", f"""SELECT factor, raw / avg(raw) OVER () AS penalty FROM (
  SELECT factor, avg(cov ** 2) / any_value(v) ** 2 AS raw FROM t_cov JOIN (SELECT factor, var_pop(ret) AS v FROM t_factors GROUP BY 1) s USING (factor)
  WHERE factor IN ({_H}) GROUP BY 1) x""", "penalty", 6)
def e02(t: Tables) -> DataFrame:
    return DS.penalty_loadings(inputs(t))


@query("e03_e04_cross_section_selection")
def e03(t: Tables) -> DataFrame:
    x = inputs(t)
    d = DS.cross_section_selection(x, DS.constant_tuning(x, LAMBDA1, LAMBDA2))
    return d.select("test", DS.names_of(x, c("sel1")).alias("sel1"), DS.names_of(x, c("sel2")).alias("sel2"), "err1", "err2")


@query("e05_series_selection")
def e05(t: Tables) -> DataFrame:
    x = inputs(t)
    d = DS.series_selection(x, [100])
    return d.select("test", DS.names_of(x, c("sel3")).alias("sel3"), DS.names_of(x, c("sel3_min")).alias("sel3_min"))


table("t_full_dates_any", "SELECT DISTINCT date FROM t_factors")


@query("e06_fold_sizes", f"""SELECT s.seed, f.fold, count(*) AS n FROM (SELECT (row_number() OVER () - 1) % 10 AS fold FROM t_full_dates_any) f, (SELECT unnest(range({CV_SEEDS.start}, {CV_SEEDS.stop}))::INT AS seed) s GROUP BY 1, 2""")
def e06(t: Tables) -> DataFrame:
    """Fold sizes per seed; which dates share a fold depends on the hash."""
    d = DS.assign_folds(t.research.factors.select("date").distinct(), CV_SEEDS)
    return d.groupBy("seed", c("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"))



# One control: the price regression has two regressors and a closed form.
table("t_two", """SELECT er.asset, er, h.cov AS ch, g.cov AS cg FROM
  (SELECT asset, avg(ret) AS er FROM t_assets GROUP BY 1) er
  JOIN (SELECT a.asset, covar_samp(a.ret, f.ret) AS cov FROM t_assets a JOIN t_sel f USING (date) WHERE f.factor = 'Brand1' AND date IN (SELECT date FROM t_asset_months) GROUP BY 1) h USING (asset)
  JOIN (SELECT a.asset, covar_samp(a.ret, f.ret) AS cov FROM t_assets a JOIN t_sel f USING (date) WHERE f.factor = 'Brand25' AND date IN (SELECT date FROM t_asset_months) GROUP BY 1) g USING (asset)""")
table("t_two_dates", "SELECT date, max(ret) FILTER (WHERE factor = 'Brand1') AS h, max(ret) FILTER (WHERE factor = 'Brand25') AS g FROM t_sel WHERE factor IN ('Brand1', 'Brand25') GROUP BY 1 HAVING count(*) = 2")
_TWO_SQL = """
SELECT 'Brand25' AS test, months, lg AS lambdag, sqrt(mzz / (zz / months) ** 2 / months / months) AS se,
  lg / sqrt(mzz / (zz / months) ** 2 / months / months) AS tstat, vg * lg AS gamma, er - lg * mcg - lh * mch AS intercept FROM (
  SELECT count(*) AS months, any_value(lg) AS lg, any_value(lh) AS lh, any_value(er) AS er, any_value(mcg) AS mcg, any_value(mch) AS mch, var_pop(g) AS vg,
    sum((g - b * h) ** 2) AS zz, sum((1 - lg * g - lh * h) ** 2 * (g - b * h) ** 2) AS mzz
  FROM t_two_dates,
    (SELECT (vhh * veg - vgh * veh) / (vgg * vhh - vgh ** 2) AS lg, (vgg * veh - vgh * veg) / (vgg * vhh - vgh ** 2) AS lh, er, mcg, mch FROM (
      SELECT var_pop(cg) AS vgg, var_pop(ch) AS vhh, covar_pop(cg, ch) AS vgh, covar_pop(cg, er) AS veg, covar_pop(ch, er) AS veh, avg(er) AS er, avg(cg) AS mcg, avg(ch) AS mch FROM t_two) q) l,
    (SELECT sum(g * h) / sum(h * h) AS b FROM t_two_dates) z) x"""


@query("e07_e09_one_control_price", _TWO_SQL, "lambdag se tstat gamma intercept", 5)
def e07(t: Tables) -> DataFrame:
    x = inputs(t, ["Brand1"], ["Brand25"])
    return DS.all_controls(x).select("test", "months", "lambdag", "se", "tstat", "gamma", "intercept")


def _residual_chain(source: str, basis: list[str], rest: list[str], centred: bool) -> str:
    """Nested SELECTs that sweep ``basis`` out of ``rest`` one column at a time."""
    left, sql = list(basis), source
    while left:
        b, left = left[0], left[1:]

        def coef(x: str) -> str:
            if centred:
                return f"(covar_pop({x}, {b}) OVER () / var_pop({b}) OVER ())"
            return f"(sum({x} * {b}) OVER () / sum({b} * {b}) OVER ())"

        swept = ", ".join(f"{x} - {coef(x)} * {b} AS {x}" for x in [*left, *rest])
        sql = f"SELECT key, {swept} FROM ({sql}) s_{b}"
    return sql


def _price_tables(tag: str, controls: list[str]) -> None:
    """Wide tables of one problem: dates with all controls, and asset covariances."""
    names = [*controls, *TESTS]
    wide = ", ".join(f"max(ret) FILTER (WHERE factor = '{n}') AS {n}" for n in names)
    listed, held = ", ".join(f"'{n}'" for n in names), ", ".join(f"'{n}'" for n in controls)
    table(f"t_{tag}_wide", f"SELECT date AS key, {wide}, count(*) FILTER (WHERE factor IN ({held})) = {len(controls)} AS whole FROM t_sel WHERE factor IN ({listed}) GROUP BY 1")
    table(f"t_{tag}_dates", f"SELECT * FROM t_{tag}_wide WHERE whole")
    covs = ", ".join(f"covar_samp(a.ret, CASE WHEN d.whole THEN d.{n} END) AS {n}" for n in controls)
    covs += ", " + ", ".join(f"covar_samp(a.ret, d.{n}) AS {n}" for n in TESTS)
    table(f"t_{tag}_cov", f"""SELECT asset AS key, er, c.* EXCLUDE asset FROM (SELECT asset, avg(ret) AS er FROM t_assets GROUP BY 1) e
      JOIN (SELECT a.asset, {covs} FROM t_assets a JOIN t_{tag}_wide d ON a.date = d.key WHERE a.date IN (SELECT date FROM t_asset_months) GROUP BY 1) c USING (asset)""")


def _price_of(tag: str, regressors: list[str], which: str) -> str:
    """Coefficient of one regressor after sweeping out all others."""
    others = [r for r in regressors if r != which]
    chain = _residual_chain(f"SELECT key, er, {', '.join(regressors)} FROM t_{tag}_cov", others, [which, "er"], True)
    return f"(SELECT covar_pop({which}, er) / var_pop({which}) FROM ({chain}) c)"


_price_tables("three", THREE)
_price_tables("every", CONTROLS)


def _three_factor_sql(g: str) -> str:
    regs = [*THREE, g]
    lam = ", ".join(f"{_price_of('three', regs, r)} AS l_{r}" for r in regs)
    z = _residual_chain(f"SELECT key, {', '.join(regs)} FROM t_three_dates WHERE {g} IS NOT NULL", THREE, [g], False)
    price = " + ".join(f"l_{r} * d.{r}" for r in regs)
    return f"""SELECT '{g}' AS test, months, lambdag, sqrt(mzz / (zz / months) ** 2 / months / months) AS se,
  lambdag / sqrt(mzz / (zz / months) ** 2 / months / months) AS tstat, vg * lambdag AS gamma FROM (
  SELECT count(*) AS months, any_value(l_{g}) AS lambdag, var_pop(d.{g}) AS vg, sum(z.{g} ** 2) AS zz, sum((1 - ({price})) ** 2 * z.{g} ** 2) AS mzz
  FROM t_three_dates d JOIN ({z}) z ON d.key = z.key, (SELECT {lam}) l) x"""


@query("e10_double_selection")
def e10(t: Tables) -> DataFrame:
    x = inputs(t)
    return DS.double_selection(x, DS.constant_tuning(x, LAMBDA1, LAMBDA2))


@query("e11_single_selection")
def e11(t: Tables) -> DataFrame:
    x = inputs(t)
    return DS.double_selection(x, DS.constant_tuning(x, LAMBDA1, LAMBDA2), single=True)


@query("e12_e13_no_selection")
def e12(t: Tables) -> DataFrame:
    return DS.all_controls(inputs(t))


@query("e12_no_selection_price", " UNION ALL ".join(
    f"SELECT '{g}' AS test, {_price_of('every', [*CONTROLS, g], g)} AS lambdag, (SELECT var_pop({g}) FROM t_every_dates) * {_price_of('every', [*CONTROLS, g], g)} AS gamma" for g in TESTS
), "lambdag gamma", 5)
def e12_price(t: Tables) -> DataFrame:
    return DS.all_controls(inputs(t)).select("test", "lambdag", "gamma")


@query("e14_three_factor_control", " UNION ALL ".join(_three_factor_sql(g) for g in TESTS), "lambdag se tstat gamma", 5)
def e14(t: Tables) -> DataFrame:
    return DS.all_controls(inputs(t, THREE)).select("test", "months", "lambdag", "se", "tstat", "gamma")


@query("e16_cross_validated_selection")
def e16(t: Tables) -> DataFrame:
    return DS.cross_validated_double_selection(inputs(t), CV_SEEDS)


def _cv_choices(t: Tables) -> DataFrame:
    if "_cv" not in t.__dict__:
        t.__dict__["_cv"] = DS.stage_table(DS.cross_validated(inputs(t), CV_SEEDS), "cv-choices")
    return t.__dict__["_cv"]


@query("e17_tuning_centre", digits=20)
def e17(t: Tables) -> DataFrame:
    return DS.tuning_centre(_cv_choices(t))


@query("e18_selection_rates")
def e18(t: Tables) -> DataFrame:
    return DS.selection_rates(inputs(t), _cv_choices(t))


@query("e19_rotated_controls")
def e19(t: Tables) -> DataFrame:
    names = DS.component_names(len(CONTROLS))
    rotated = DS.stage_table(DS.rotate_controls(t.research.factors, CONTROLS, TESTS), "rotated")
    x = DS.prepare(rotated, t.research.assets, names, TESTS)
    return DS.double_selection(x, DS.constant_tuning(x, 1e-6, 1e-7))


@query("e20_elastic_net")
def e20(t: Tables) -> DataFrame:
    x = inputs(t)
    return DS.double_selection(x, DS.constant_tuning(x, LAMBDA1, LAMBDA2), alpha=0.5)


@query("e21_alternative_assets")
def e21(t: Tables) -> DataFrame:
    """Double selection with all controls on two further asset sets, by least stocks of a block."""
    out = []
    for least in (10, 15):
        ids = t.research.metadata.where(c("min_stk6") >= least).select(c("position").cast("long").alias("position"))
        a = t.research.assets.withColumn("position", c("block") % 25 + 1).join(ids, "position", "left_semi")
        x = DS.prepare(tested_factors(t), a.drop("position"), CONTROLS, TESTS)
        out.append(DS.double_selection(x, DS.constant_tuning(x, LAMBDA1, LAMBDA2)).withColumn("min_stocks", F.lit(least)))
    return out[0].unionByName(out[1])


@query("e22_stepwise_selection")
def e22(t: Tables) -> DataFrame:
    return DS.stepwise_double_selection(inputs(t), FOUR)


def _draws(t: Tables) -> DataFrame:
    kind = F.when(c("asset") % 3 == 0, "useful").when(c("asset") % 3 == 1, "redundant").otherwise("useless")
    return t.research.assets.select(F.when(F.month("date") % 2 == 0, "ds").otherwise("ss").alias("estimator"), kind.alias("kind"), c("ret").alias("estimate"))


_DRAWS = """SELECT CASE WHEN month(date) % 2 = 0 THEN 'ds' ELSE 'ss' END AS estimator,
  CASE asset % 3 WHEN 0 THEN 'useful' WHEN 1 THEN 'redundant' ELSE 'useless' END AS kind, ret AS estimate FROM t_assets"""


@query("e23_monte_carlo_errors", f"SELECT estimator, kind, avg(estimate - truth) AS bias, sqrt(avg((estimate - truth) ** 2)) AS rmse FROM ({_DRAWS}) d JOIN (VALUES ('useful', 0.01::DOUBLE), ('redundant', 0::DOUBLE), ('useless', 0::DOUBLE)) v(kind, truth) USING (kind) GROUP BY 1, 2", "bias rmse")
def e23(t: Tables) -> DataFrame:
    truth = t.spark.createDataFrame([("useful", 0.01), ("redundant", 0.0), ("useless", 0.0)], "kind string, truth double")
    return DS.monte_carlo_errors(_draws(t), truth)


@query("e24_density_histogram", f"""SELECT kind, bin::INT AS bin, -6.0::DOUBLE + bin * (12.0::DOUBLE / 49) AS centre, n / (sum(n) OVER (PARTITION BY kind) * (12.0::DOUBLE / 49)) AS density FROM (
  SELECT kind, greatest(least(floor((estimate * 40 + 6.0::DOUBLE) / (12.0::DOUBLE / 49) + 0.5::DOUBLE), 49), 0) AS bin, count(*) AS n FROM ({_DRAWS}) d GROUP BY 1, 2) x""", "centre density", 6)
def e24(t: Tables) -> DataFrame:
    return DS.density_histogram(_draws(t).withColumn("z", c("estimate") * 40), ["kind"])


@query("e25_results_table", digits=4)
def e25(t: Tables) -> DataFrame:
    return DS.results_table(t.research.factors, t.research.assets, CONTROLS, TESTS, THREE, LAMBDA1, LAMBDA2)
