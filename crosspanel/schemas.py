"""Declared schemas of the base tables and analysis-time checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

_L, _I, _D, _S, _DT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.DateType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


SECURITY_MONTH = _schema(
    permno=_L, permco=_L, mthcaldt=_DT, shrcd=_I, exchcd=_I, issuertype=_S, securitytype=_S, securitysubtype=_S, sharetype=_S,
    usincflg=_S, primaryexch=_S, conditionaltype=_S, tradingstatusflg=_S, mthret=_D, mthretx=_D, shrout=_D, mthprc=_D, vol=_D,
)
ANNUAL = _schema(
    permno=_L, permco=_L, jdate_ltrd=_DT, ym=_DT, cal_mend=_DT, mthret=_D, mthretx=_D, shrout=_D, mthprc=_D, gvkey=_S,
    datadate=_DT, fyear=_I, sic=_I, be=_D, currat=_D, act=_D, invt=_D, lct=_D, sale=_D, cogs=_D, che=_D, rect=_D, dp=_D,
    ppent=_D, ib=_D, at=_D, oancf=_D, xidoc=_D, dltt=_D, dcvt=_D, dlc=_D, emp=_D, xad=_D, xrd=_D, txt=_D, sgr=_D, dvt=_D,
)
QUARTERLY = _schema(
    permno=_L, permco=_L, jdate_ltrd=_DT, ym=_DT, gvkey=_S, datadate=_DT, rdq=_DT, ltq=_D, ibq=_D, dpq=_D, ppentq=_D, sic=_I,
)


def require_columns(df: DataFrame, columns: Iterable[str], table: str) -> DataFrame:
    """Fail at analysis time when a plan's input lacks columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{table} lacks columns {missing}")
    return df


def normalise_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Coerce known columns to their declared types; unparsable values become null."""
    known = {f.name: f.dataType for f in schema.fields}

    def coerce(name: str, have: T.DataType):
        want = known.get(name)
        if want is None or want == have:
            return F.col(name)
        if isinstance(want, T.DateType):
            return F.try_to_timestamp(F.substring(F.col(name).cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date").alias(name)
        if isinstance(want, (T.LongType, T.IntegerType)) and isinstance(have, T.StringType):
            return F.col(name).try_cast("double").try_cast(want).alias(name)
        return F.col(name).try_cast(want).alias(name)

    return df.select(*[coerce(f.name, f.dataType) for f in df.schema.fields])
