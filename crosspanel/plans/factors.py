"""Factor registry and the plans that turn base tables into factor series.

A factor is one row of data (:class:`FactorSpec`), not a module.  All requested
factors of a chain are computed together: characteristics are columns of one June
(or monthly) frame, their breakpoints come from one stacked quantile pass, labels
travel as an array through a single join to the monthly panel, and one partial
aggregate over (date, factor) yields every portfolio return.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from crosspanel.functions.dates import month_key, month_number
from crosspanel.functions.frames import by_entity, rolling
from crosspanel.functions.scalars import finite, industry_bucket, orient, pct_change, safe_ratio
from crosspanel.operators.quantiles import grouped_median
from crosspanel.operators.rows import keep_last
from crosspanel.operators.sorts import (
    EVENT,
    SIX,
    TAILS,
    flag_bucket,
    long_short,
    port_means,
    size_bucket,
    small_minus_big,
    tail_bucket,
    tercile_bucket,
    wide_breakpoints,
)
from crosspanel.plans.extracts import BaseTables
from crosspanel.session import stage_table, together
from crosspanel.plans.market import june_rows, liquidity_panel, market_panel, momentum_panel

HML, LMH = "high_minus_low", "low_minus_high"
EPS = 1e-6


@dataclass(frozen=True)
class FactorSpec:
    """Declaration of one factor.

    ``chain``: june (sorted each June, held a year), monthly (sorted each month on
    size and value), tails (two value tails, no size), event (flag against rest).
    ``frame`` names the June sample; ``value`` is an expression over its columns.
    """

    key: str
    chain: str
    value: Callable[[], Column]
    orientation: str = HML
    out: str | None = None
    frame: str = "annual"
    warm_months: int = 13
    bucket: str = "tercile"
    spread: str = "char"
    valid: Callable[[], Column] | None = None
    sample: Callable[[], Column] | None = None
    fallback: bool = False
    industry: bool = False
    zero_without_high: bool = False
    reindex: bool = True

    @property
    def name(self) -> str:
        return self.out or self.key


REGISTRY: dict[str, FactorSpec] = {}


def register_factor(spec: FactorSpec) -> FactorSpec:
    """Add a factor under its key; this is the library's extension point."""
    if spec.key in REGISTRY:
        raise ValueError(f"factor {spec.key!r} is already registered")
    REGISTRY[spec.key] = spec
    return spec


def c(name: str) -> Column:
    return F.col(name)


def _june(key: str, value: Callable[[], Column], orientation: str, **kw) -> None:
    register_factor(FactorSpec(key, "june", value, orientation, **kw))


def _has_currat() -> Column:
    # The size labels of the size/value pair are limited to names with a current
    # ratio, as in the studied results.
    return c("currat").isNotNull()


def _beme() -> Column:
    return safe_ratio(c("be") * 1000.0, c("dec_me"))


_june("smb_ff93", _beme, HML, frame="beme", spread="size", valid=lambda: (_beme() > 0) & _has_currat(), sample=lambda: _beme() > 0)
_june("hml_ff93", _beme, HML, frame="beme", valid=lambda: (_beme() > 0) & _has_currat(), sample=lambda: _beme() > 0)
_june("currat_2x3", lambda: c("currat"), LMH, out="currat", frame="beme")
_june("pchcurrat", lambda: pct_change(c("currat"), c("lag_currat")), LMH, warm_months=25)
_june("quick_2x3", lambda: c("quick"), LMH, out="quick")
_june("pchquick", lambda: pct_change(c("quick"), c("lag_quick")), LMH, warm_months=25)
_june("pchsaleinv", lambda: pct_change(c("saleinv"), c("lag_saleinv")), LMH, warm_months=25)
_june(
    "pchgm_pchsale",
    lambda: pct_change(c("gm"), c("lag_gm"), EPS) - pct_change(c("sale"), c("lag_sale"), EPS),
    HML,
    warm_months=25,
    fallback=True,
)
_june("pchdepr", lambda: pct_change(c("deprate"), c("lag_deprate")), HML, warm_months=25)
_june("saleinv", lambda: c("saleinv"), HML)
_june("salecash", lambda: safe_ratio(c("sale"), c("che")), HML)
_june("salerec", lambda: safe_ratio(c("sale"), c("rect")), HML)
_june("acc", lambda: safe_ratio(c("ib") - c("oancf"), (c("at") + c("lag_at")) / 2.0), LMH)
_june("lev_2x3", lambda: safe_ratio(c("ltq") * 1000.0, c("me")), HML, out="lev", frame="quarterly")
_june("pps", lambda: safe_ratio(F.lit(1.0), c("prc")), HML, frame="price")
_june("cashdebt", lambda: safe_ratio(c("ttm_ibq") + c("ttm_dpq"), (c("ltq") + c("ltq_l4")) / 2.0), HML, frame="quarterly")
_june("depr", lambda: safe_ratio(c("ttm_dpq"), c("ppentq")), HML, frame="quarterly")
_june(
    "convind",
    lambda: F.when(F.coalesce(c("dcvt"), F.lit(0.0)) > 0, 1.0).otherwise(0.0),
    LMH,
    warm_months=25,
    bucket="flag",
    zero_without_high=True,
)
register_factor(FactorSpec("mom6m", "tails", lambda: c("mom6m"), HML, warm_months=12))
register_factor(FactorSpec("mom36m", "monthly", lambda: c("mom36m"), HML, frame="momentum", warm_months=40))
register_factor(FactorSpec("sgr", "tails", lambda: c("sgr"), LMH, warm_months=24))
_june(
    "IPO",
    lambda: F.when(month_number(c("jdate")) - c("first_month") < 60, 1.0).otherwise(0.0),
    HML,
    frame="everyone",
    warm_months=60,
    bucket="flag",
)
register_factor(FactorSpec("divi", "event", lambda: c("starts_paying"), HML, warm_months=60))
register_factor(FactorSpec("divo", "event", lambda: c("stops_paying"), HML, warm_months=60))
register_factor(FactorSpec("turn", "monthly", lambda: c("turn"), HML, frame="turnover", reindex=False))
_june(
    "cfp_ia",
    lambda: safe_ratio(F.coalesce(c("oancf"), c("ib") + c("dp")), c("dec_me"), EPS),
    HML,
    warm_months=25,
    industry=True,
)
_june("chempia", lambda: pct_change(c("emp"), c("june_lag_emp")), LMH, warm_months=25, industry=True)
_june("mve_ia", lambda: F.when(c("me") > 0, F.log(c("me"))), LMH, industry=True)
register_factor(FactorSpec("dolvol", "monthly", lambda: c("dolvol"), LMH, frame="liquidity"))
register_factor(FactorSpec("std_dolvol", "monthly", lambda: c("std_dolvol"), HML, frame="liquidity"))
register_factor(FactorSpec("std_turn", "monthly", lambda: c("std_turn"), HML, frame="liquidity"))
_june("adm", lambda: safe_ratio(c("xad"), c("dec_me"), EPS), LMH)
_june("rdm", lambda: safe_ratio(c("xrd"), c("dec_me"), EPS), HML)
_june("rds", lambda: safe_ratio(c("xrd"), c("sale"), EPS), HML)
_june("chinv", lambda: safe_ratio(c("invt") - c("june_lag_invt"), c("june_lag_at")), LMH, warm_months=25)
_june("chtx", lambda: safe_ratio(c("txt") - c("june_lag_txt"), c("june_lag_at")), HML, warm_months=25)


# --- June frame -----------------------------------------------------------------

ANCHOR_LAGS = ("currat", "quick", "saleinv", "gm", "sale", "deprate", "at")
JUNE_LAGS = ("emp", "invt", "txt", "at")


def annual_characteristics(annual: DataFrame) -> DataFrame:
    """Annual anchors with derived ratios and their lag on the previous anchor."""
    a = keep_last(annual, ["permno", "ym"], ["datadate"]) if "datadate" in annual.columns else annual
    a = a.select(
        "permno", "ym", "sic", "be", "currat", "act", "invt", "lct", "sale", "cogs", "che", "rect", "dp", "ib", "at",
        "oancf", "dcvt", "emp", "xad", "xrd", "txt",
        safe_ratio(c("act") - c("invt"), c("lct")).alias("quick"),
        safe_ratio(c("sale"), c("invt")).alias("saleinv"),
        (c("sale") - c("cogs")).alias("gm"),
        safe_ratio(c("dp"), c("ppent")).alias("deprate"),
    )
    w = by_entity("permno", "ym")
    return a.select("*", *[F.lag(x).over(w).alias(f"lag_{x}") for x in ANCHOR_LAGS])


def quarterly_characteristics(quarterly: DataFrame) -> DataFrame:
    """As-of quarters with trailing four-quarter sums over distinct quarters."""
    q = quarterly.select("permno", "ym", "datadate", "rdq", "ltq", "ibq", "dpq", "ppentq", c("sic").alias("sic_q"))
    obs = keep_last(q.where(c("datadate").isNotNull()), ["permno", "datadate"], ["rdq", "ym"])
    w = by_entity("permno", "datadate")
    obs = obs.select(
        "permno",
        "datadate",
        rolling(F.sum, c("ibq"), w, 4, 4).alias("ttm_ibq"),
        rolling(F.sum, c("dpq"), w, 4, 4).alias("ttm_dpq"),
        F.lag("ltq", 4).over(w).alias("ltq_l4"),
    )
    return q.join(obs, ["permno", "datadate"], "left").drop("datadate", "rdq")


def _not_financial(sic: Column) -> Column:
    return F.coalesce(~sic.between(6000, 6999), F.lit(False))


def june_frame(base: BaseTables, panel: DataFrame, specs: Sequence[FactorSpec]) -> DataFrame:
    """June rows with one value column per spec, null outside the spec's sample."""
    frames = {s.frame for s in specs}
    june = june_rows(panel).select("permno", "jdate", "ym", "primaryexch", "prc", "me", "dec_me", "first_month")
    if frames - {"everyone"}:
        june = june.join(annual_characteristics(base.annual), ["permno", "ym"], "left")
        positive = F.coalesce(c("be") > 0, F.lit(False))
        screened = positive & _not_financial(c("sic"))
    else:
        positive = screened = F.lit(True)
    if "quarterly" in frames:
        june = june.join(quarterly_characteristics(base.quarterly), ["permno", "ym"], "left")
    members = {
        "everyone": F.lit(True),
        "annual": screened,
        "beme": screened & (_beme().isNotNull() if "beme" in frames else F.lit(True)),
        "price": screened & (c("prc") >= 1),
        "quarterly": positive & _not_financial(c("sic_q")) if "quarterly" in frames else F.lit(True),
    }
    june = june.select("*", *[members[f].alias(f"in_{f}") for f in sorted(frames)])
    if any(s.key in ("chempia", "chinv", "chtx") for s in specs):
        w = Window.partitionBy("permno", "in_annual").orderBy("jdate")
        june = june.select("*", *[F.lag(x).over(w).alias(f"june_lag_{x}") for x in JUNE_LAGS])
    june = june.select("*", *[F.when(c(f"in_{s.frame}"), finite(s.value())).alias(f"v_{s.key}") for s in specs])
    adjusted = [s for s in specs if s.industry]
    return demean_by_industry(june, [f"v_{s.key}" for s in adjusted]) if adjusted else june


def demean_by_industry(june: DataFrame, values: Sequence[str], date: str = "jdate", sic: str = "sic") -> DataFrame:
    """Subtract the median of the two-digit industry per date.

    Medians of all columns come from one stacked pass; rows without an industry
    code become null.
    """
    d = june.withColumn("sic2", industry_bucket(c(sic)))
    entries = F.array(*[F.struct(F.lit(v).alias("n"), c(v).alias("x")) for v in values])
    long = (
        d.where(c("sic2").isNotNull())
        .select(date, "sic2", F.explode(entries).alias("_e"))
        .select(date, "sic2", "_e.n", "_e.x")
    )
    med = grouped_median(long, ["n", date, "sic2"], "x")
    wide = med.groupBy(date, "sic2").agg(*[F.max(F.when(c("n") == v, c("median"))).alias(f"_m_{v}") for v in values])
    joined = d.join(wide, [date, "sic2"], "left")
    return joined.withColumns({v: c(v) - c(f"_m_{v}") for v in values}).drop(*[f"_m_{v}" for v in values])


def june_labels(june: DataFrame, specs: Sequence[FactorSpec]) -> DataFrame:
    """Per security and holding year, the array of (factor, portfolio) labels."""
    nyse = c("primaryexch") == "N"
    samples: dict[str, tuple[Column, Column]] = {}
    for f in sorted({s.frame for s in specs}):
        cond = c(f"in_{f}") & (c("me") > 0)
        samples[f"size_{f}"] = (cond if f == "everyone" else cond & nyse, c("me"))
    for s in specs:
        if s.bucket == "flag":
            continue
        cond = c("me") > 0
        if s.sample is not None:
            cond = cond & s.sample()
        samples[s.key] = (cond & nyse, c(f"v_{s.key}"))
        if s.fallback:
            samples[f"all_{s.key}"] = (cond, c(f"v_{s.key}"))
    bp = wide_breakpoints(june, samples, medians=[n for n in samples if n.startswith("size_")])
    d = june.join(bp, "jdate", "left")
    labels = []
    for s in specs:
        v = c(f"v_{s.key}")
        ok = (c("me") > 0) & v.isNotNull()
        if s.valid is not None:
            ok = ok & s.valid()
        size = size_bucket(c("me"), c(f"size_{s.frame}_med"))
        if s.bucket == "flag":
            char = flag_bucket(v >= 0.5)
        else:
            q30, q70 = c(f"{s.key}_q30"), c(f"{s.key}_q70")
            if s.fallback:
                q30, q70 = F.coalesce(q30, c(f"all_{s.key}_q30")), F.coalesce(q70, c(f"all_{s.key}_q70"))
            char = tercile_bucket(v, q30, q70)
        port = F.when(ok, F.concat(size, char))
        labels.append(F.when(port.isNotNull(), F.struct(F.lit(s.key).alias("f"), port.alias("port"))))
    return d.select("permno", "jdate", F.year("jdate").alias("ffyear"), F.array_compact(F.array(*labels)).alias("labels"))


MONTH_COLUMNS = ("permno", "jdate", "mthret", "wt")

# --- Portfolio returns --------------------------------------------------------------


def spread_of(spec: FactorSpec) -> Column:
    if spec.chain == "event":
        return c("E") - c("N")
    if spec.chain == "tails":
        return orient(c("H"), c("L"), spec.orientation)
    if spec.spread == "size":
        return small_minus_big()
    out = long_short(spec.orientation)
    if spec.zero_without_high:
        no_high = ((c("BH") + c("SH")).isNull()) & ((c("BL") + c("SL")).isNotNull())
        out = F.when(no_high, 0.0).otherwise(out)
    return out


def portfolio_returns(labelled: DataFrame, specs: Sequence[FactorSpec]) -> DataFrame:
    """Value-weighted portfolio returns per date and factor.

    ``labelled`` has jdate, mthret, wt and ``labels``.  Rows without a label keep
    their date alive under a null factor, which later serves as the calendar.
    """
    names = list(
        dict.fromkeys(
            n for s in specs for n in {"tails": TAILS, "event": EVENT}.get(s.chain, SIX)
        )
    )
    usable = c("mthret").isNotNull() & (c("wt") > 0)
    d = labelled.select(
        "jdate", "mthret", "wt", F.explode_outer(F.when(usable, c("labels"))).alias("_l")
    ).select("jdate", "mthret", "wt", c("_l.f").alias("factor"), c("_l.port").alias("port"))
    return d.groupBy("jdate", "factor").agg(*port_means(c("port"), c("mthret"), c("wt"), names))


def factor_table(returns: DataFrame, specs: Sequence[FactorSpec], start: str | None, end: str | None) -> DataFrame:
    """One row per month-end trading date, one column per factor."""
    value = [F.max(F.when(c("factor") == s.key, spread_of(s))).alias(s.name) for s in specs]
    seen = [F.max(F.when(c("factor") == s.key, F.lit(True))).alias(f"_seen_{s.name}") for s in specs if not s.reindex]
    wide = returns.groupBy(c("jdate").alias("date")).agg(*value, *seen)
    last = F.max("date").over(Window.partitionBy(month_key(c("date"))))
    wide = wide.withColumn("_last", last).where(c("date") == c("_last")).drop("_last")
    if start is not None:
        wide = wide.where(c("date") >= F.lit(start).cast("date"))
    if end is not None:
        wide = wide.where(c("date") <= F.lit(end).cast("date"))
    return wide


def _with_first_month(panel: DataFrame) -> DataFrame:
    """First month in which a security carries a weight."""
    first = F.min(F.when(c("wt").isNotNull(), month_number(c("jdate")))).over(Window.partitionBy("permno"))
    return panel.withColumn("first_month", first)


def june_chain(base: BaseTables, specs: Sequence[FactorSpec], start: str | None, end: str | None, panel: DataFrame) -> DataFrame:
    june = stage_table(june_frame(base, _with_first_month(panel), specs), "june")
    labels = june_labels(june, specs).drop("jdate")
    monthly = panel.select("permno", "ffyear", "jdate", "mthret", "wt")
    return portfolio_returns(monthly.join(labels, ["permno", "ffyear"], "left"), specs)


def monthly_chain(frame: DataFrame, specs: Sequence[FactorSpec]) -> DataFrame:
    """Sort on size and value every month; the sample of a factor is its own."""
    d = frame.select(*MONTH_COLUMNS, "primaryexch", "me", *[finite(s.value()).alias(f"v_{s.key}") for s in specs])
    d = stage_table(d, "monthly-sort")
    complete = c("mthret").isNotNull() & c("me").isNotNull() & c("wt").isNotNull()

    def member(s: FactorSpec) -> Column:
        # Turnover and long momentum drop incomplete rows before the breakpoints.
        known = c(f"v_{s.key}").isNotNull()
        return known if s.frame == "liquidity" else known & complete

    nyse = c("primaryexch") == "N"
    samples: dict[str, tuple[Column, Column]] = {}
    for s in specs:
        samples[f"size_{s.key}"] = (member(s) & nyse & (c("me") > 0), c("me"))
        positive = F.lit(True) if s.frame == "turnover" else c("me") > 0
        samples[s.key] = (member(s) & nyse & positive, c(f"v_{s.key}"))
    bp = wide_breakpoints(d, samples, medians=[f"size_{s.key}" for s in specs])
    d = d.join(bp, "jdate", "left")
    labels = []
    for s in specs:
        ok = member(s) & (c("me").isNotNull() if s.frame == "turnover" else c("me") > 0)
        size = size_bucket(c("me"), c(f"size_{s.key}_med"))
        char = tercile_bucket(c(f"v_{s.key}"), c(f"{s.key}_q30"), c(f"{s.key}_q70"))
        port = F.when(ok, F.concat(size, char))
        labels.append(F.when(port.isNotNull(), F.struct(F.lit(s.key).alias("f"), port.alias("port"))))
    return portfolio_returns(d.withColumn("labels", F.array_compact(F.array(*labels))), specs)


def tails_chain(frame: DataFrame, specs: Sequence[FactorSpec]) -> DataFrame:
    """Long-short of the two value tails over all exchanges."""
    d = frame.select(*MONTH_COLUMNS, *[finite(s.value()).alias(f"v_{s.key}") for s in specs])
    d = stage_table(d, "tails")
    samples = {s.key: (c("wt") > 0, c(f"v_{s.key}")) for s in specs}
    d = d.join(wide_breakpoints(d, samples), "jdate", "left")
    labels = []
    for s in specs:
        port = F.when(c("wt") > 0, tail_bucket(c(f"v_{s.key}"), c(f"{s.key}_q30"), c(f"{s.key}_q70")))
        labels.append(F.when(port.isNotNull(), F.struct(F.lit(s.key).alias("f"), port.alias("port"))))
    return portfolio_returns(d.withColumn("labels", F.array_compact(F.array(*labels))), specs)


def payer_events(annual: DataFrame) -> DataFrame:
    """Dividend status changes per security and holding year."""
    pays = F.coalesce(c("dvt") > 0, F.lit(False))
    w = by_entity("permno", "datadate")
    f = annual.where(c("datadate").isNotNull()).select("permno", "ym", "datadate", pays.alias("pays"))
    f = f.withColumn("_before", F.lag("pays").over(w))
    return f.groupBy("permno", "ym").agg(
        F.max(F.coalesce(c("pays") & ~c("_before"), F.lit(False))).alias("starts_paying"),
        F.max(F.coalesce(~c("pays") & c("_before"), F.lit(False))).alias("stops_paying"),
    ).select("permno", F.year("ym").alias("ffyear"), "starts_paying", "stops_paying")


def event_chain(panel: DataFrame, annual: DataFrame, specs: Sequence[FactorSpec]) -> DataFrame:
    """Event names against all others; null when either side is empty."""
    d = panel.join(payer_events(annual), ["permno", "ffyear"], "left")
    labels = [
        F.struct(F.lit(s.key).alias("f"), F.when(F.coalesce(s.value(), F.lit(False)), "E").otherwise("N").alias("port"))
        for s in specs
    ]
    return portfolio_returns(d.withColumn("labels", F.array(*labels)), specs)


def _annual_window(base: BaseTables, start: str | None, end: str | None, months: int, date: str) -> DataFrame:
    a = base.annual
    if start is not None:
        a = a.where(c(date) >= F.add_months(F.lit(start).cast("date"), -months))
    if end is not None:
        a = a.where(c(date) <= F.lit(end).cast("date"))
    return a


def _chain(base: BaseTables, kind: str, warm: int, specs: list[FactorSpec], start: str | None, end: str | None) -> DataFrame:
    """Portfolio returns of the specs that share a chain and a warm-up length."""
    if kind in ("monthly_liquidity", "monthly_turnover"):
        return monthly_chain(liquidity_panel(base.monthly, start, end, 13, exchange_screen=kind == "monthly_liquidity"), specs)
    if start is None and end is None and base.panel is not None:
        panel = base.panel
    else:
        panel = stage_table(market_panel(base.monthly, start, end, warm), "panel")
    if kind == "june":
        return june_chain(replace(base, annual=_annual_window(base, None, end, warm, "jdate_ltrd")), specs, start, end, panel)
    if kind == "event":
        return event_chain(panel, _annual_window(base, start, end, warm + 36, "datadate"), specs)
    if kind == "monthly_momentum":
        return monthly_chain(momentum_panel(panel), specs)
    frame = panel
    if any(s.key == "mom6m" for s in specs):
        frame = momentum_panel(frame)
    if any(s.key == "sgr" for s in specs):
        sgr = _annual_window(base, start, end, warm, "jdate_ltrd").where(c("sgr").isNotNull())
        frame = frame.join(sgr.select("permno", F.year("jdate_ltrd").alias("ffyear"), "sgr"), ["permno", "ffyear"], "left")
    return tails_chain(frame, specs)


def build_factors(
    base: BaseTables,
    keys: Iterable[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    registry: dict[str, FactorSpec] | None = None,
) -> DataFrame:
    """Factor series as one row per month, one column per factor, sorted by nothing.

    With a start date each factor sees only its own warm-up history, so specs are
    grouped by warm-up length; without one, all specs of a chain share one panel.
    The chains are independent and their staging jobs overlap.
    """
    registry = registry or REGISTRY
    specs = [registry[k] for k in (keys if keys is not None else sorted(registry))]
    groups: dict[tuple, list[FactorSpec]] = {}
    for s in specs:
        kind = s.chain if s.chain != "monthly" else f"monthly_{s.frame}"
        groups.setdefault((kind, s.warm_months if start is not None else 0), []).append(s)
    chains = [lambda k=kind, w=warm, m=members: _chain(base, k, w, m, start, end) for (kind, warm), members in groups.items()]
    parts = together(base.monthly.sparkSession, chains)
    returns = parts[0]
    for p in parts[1:]:
        returns = returns.unionByName(p, allowMissingColumns=True)
    out = factor_table(returns, specs, start, end)
    late = [s.name for s in specs if not s.reindex]
    if late and len(specs) == 1:
        out = out.where(c(f"_seen_{late[0]}"))
    return out.drop(*[f"_seen_{n}" for n in late])


def build_available_factors(
    base: BaseTables, keys: Iterable[str] | None = None, start: str | None = None, end: str | None = None, registry: dict[str, FactorSpec] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The factors that the base tables allow, and (factor, reason) of those left out.

    A factor is left out when its plan can't be resolved, as for a missing column; data never
    decides it.  Factors of one chain that fails are tried one by one.
    """
    registry = registry or REGISTRY
    wanted = list(keys) if keys is not None else sorted(registry)
    chains: dict[tuple[str, str], list[str]] = {}
    for k in wanted:
        chains.setdefault((registry[k].chain, registry[k].frame), []).append(k)
    kept, skipped = [], []

    def attempt(names: list[str]) -> None:
        try:
            _chain_plan(base, [registry[k] for k in names], start, end)
            kept.extend(names)
        except AnalysisException as e:
            if len(names) > 1:
                for k in names:
                    attempt([k])
            else:
                skipped.append((registry[names[0]].name, e.getCondition() or "unresolved plan"))

    for names in chains.values():
        attempt(names)
    spark = base.monthly.sparkSession
    reasons = spark.createDataFrame(sorted(skipped), "factor string, reason string")
    if not kept:
        return spark.createDataFrame([], "date date"), reasons
    return build_factors(base, [k for k in wanted if k in kept], start, end, registry), reasons


def _chain_plan(base: BaseTables, specs: list[FactorSpec], start: str | None, end: str | None) -> None:
    """Run a chain on empty tables of the same columns, which reads no data."""
    spark = base.monthly.sparkSession
    bare = [None if d is None else spark.createDataFrame([], d.schema) for d in (base.monthly, base.annual, base.quarterly, base.panel)]
    s = specs[0]
    _chain(BaseTables(*bare), s.chain if s.chain != "monthly" else f"monthly_{s.frame}", s.warm_months, specs, start, end)


def with_panel(base: BaseTables) -> BaseTables:
    """Base tables plus the full-history market panel, written once."""
    return replace(base, panel=stage_table(market_panel(base.monthly), "panel"))


def build_factor(base: BaseTables, key: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One registered factor as (date, <factor name>)."""
    if key not in REGISTRY:
        raise KeyError(f"unknown factor {key!r}")
    return build_factors(base, [key], start, end)


def factor_series(base: BaseTables, keys: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The same result in long form: (date, factor, value)."""
    wide = build_factors(base, keys, start, end)
    names = [n for n in wide.columns if n != "date"]
    return wide.unpivot(["date"], names, "factor", "value")
