"""Loaders and writers for the text files research data arrives in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crosspanel.functions.dates import parse_mixed_date
from crosspanel.session import stage_table

MISSING_CODE = -99.0


def read_embedded_table(spark: SparkSession, path: str, header_words: Sequence[str]) -> DataFrame:
    """Pull the first data table out of a text file with prose around it.

    The header is the first line that contains every word (any case) and a comma.
    Data rows follow until the first line that does not start with a digit.  A line's
    position is the start of its file split and a running number inside the split, so
    a large file is still read in parallel; positions are fixed by staging them once.
    """
    lines = stage_table(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("_file"),
            F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_n"),
            F.col("value").alias("line"),
        ),
        "lines",
    )
    low = F.lower("line")
    is_header: Column = F.col("line").contains(",")
    for w in header_words:
        is_header = is_header & low.contains(w.lower())
    head = lines.where(is_header).groupBy("_file").agg(F.min("_n").alias("_h"), F.min_by("line", "_n").alias("_names"))
    after = lines.join(head, "_file").where(F.col("_n") > F.col("_h"))
    stop = after.where(~F.col("line").rlike(r"^\d.*,")).groupBy("_file").agg(F.min("_n").alias("_stop"))
    rows = after.join(stop, "_file", "left").where(F.coalesce(F.col("_n") < F.col("_stop"), F.lit(True)))
    cells = rows.select("_file", F.split("_names", ",").alias("_k"), F.split("line", ",").alias("_v"))
    key = F.trim(F.element_at("_v", 1))
    return cells.select(
        "_file", parse_mixed_date(key).alias("date"), F.posexplode(F.arrays_zip("_k", "_v")).alias("_i", "_c")
    ).where(F.col("_i") > 0).select(
        "date", F.trim(F.col("_c._k")).alias("factor"), F.trim(F.col("_c._v")).try_cast("double").alias("value")
    )


def read_spaced_text(spark: SparkSession, path: str, names: Sequence[str], comment: str = "%") -> DataFrame:
    """Whitespace-separated columns, comment lines skipped, -99 means missing."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    rows = lines.where((F.col("line") != "") & ~F.col("line").startswith(comment))
    cells = rows.select(F.split("line", r"\s+").alias("c"))

    def number(i: int) -> Column:
        x = F.get("c", F.lit(i)).try_cast("double")
        return F.when(x != MISSING_CODE, x)

    first = parse_mixed_date(F.get("c", F.lit(0))).alias(names[0])
    return cells.select(first, *[number(i).alias(n) for i, n in enumerate(names) if i > 0])


def read_wide_matrix(spark: SparkSession, path: str, n_columns: int, scale: float = 1.0) -> DataFrame:
    """Headerless matrix (date, then columns by position) to (date, col_idx, value)."""
    schema = "d string, " + ", ".join(f"c{i} double" for i in range(n_columns))
    wide = spark.read.schema(schema).csv(path, header=False)
    long = wide.select(parse_mixed_date(F.col("d")).alias("date"), *[F.col(f"c{i}").alias(str(i)) for i in range(n_columns)])
    long = long.unpivot(["date"], [str(i) for i in range(n_columns)], "col_idx", "value")
    return long.select("date", F.col("col_idx").cast("int").alias("col_idx"), (F.col("value") * scale).alias("value"))


def read_factor_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Factor file (date, rf, factors...) to long factors and the risk-free series.

    A further column named RF among the factors is the rate again and is dropped.
    """
    raw = spark.read.csv(path, header=True)
    date, rf, *names = raw.columns
    names = [n for n in names if n.upper() != "RF"]
    base = raw.select(
        parse_mixed_date(F.col(date)).alias("date"),
        F.col(rf).try_cast("double").alias("rf"),
        *[F.col(n).try_cast("double").alias(n) for n in names],
    )
    return base.select("date", *names).unpivot(["date"], names, "factor", "value"), base.select("date", "rf")


def gather_factor_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Many aligned factor files to one long table; the first column is the date.

    Rows whose date does not parse are dropped.  Each file keeps its own columns, so
    files are read one plan each and united; only the header is looked at eagerly.
    """
    out: DataFrame | None = None
    for p in paths:
        raw = spark.read.csv(p, header=True)
        date, *names = raw.columns
        part = raw.select(parse_mixed_date(F.col(date)).alias("date"), *[F.col(n).try_cast("double").alias(n) for n in names])
        part = part.where(F.col("date").isNotNull()).unpivot(["date"], names, "factor", "value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError("no factor files given")
    return out


def write_factor_csv(df: DataFrame, path: str, date: str = "date", single_file: bool = False) -> None:
    """Write (date, factors...) as CSV with a header, ordered by date.

    A factor table has one row per month, so one output file is small; wide panels
    should keep ``single_file`` off.
    """
    out = df.orderBy(date)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(path, header=True)


def write_text_lines(df: DataFrame, path: str, order: str) -> None:
    """One text file from an ordered ``line`` column (fixture writer for the loaders)."""
    df.orderBy(order).coalesce(1).select("line").write.mode("overwrite").text(path)

