"""Small DataFrame helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from crosspanel.session import stage_table


def read_input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    return df.mapInArrow(fn, schema)


def with_fields(df: DataFrame, made: Column, fields: dict[str, str]) -> DataFrame:
    """``df`` plus fields of a struct column under the given names; columns called so are replaced."""
    base = df.drop(*fields)
    name = "_made"
    while name in base.columns:
        name += "_"
    out = base.select(*[F.col(f"`{c}`") for c in base.columns], made.alias(name))
    return out.withColumns({n: F.col(name)[f] for n, f in fields.items()}).drop(name)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a row for joins back to the table: the id and a hash of the text.

    Rows that repeat an id with another text stay apart, exact repeats share one key
    (their results are equal), and a null id or text is a value like any other.
    """
    return F.struct(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**62))).alias("id"),
        F.xxhash64(F.col(doc_id).isNull(), F.col(text).isNull(), F.col(text)).alias("hash"),
    )


CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a plan's shuffle files as soon as its action is done."""
    conf = spark.conf
    before = conf.get(CLEANUP_KEY, None)
    conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        conf.unset(CLEANUP_KEY) if before is None else conf.set(CLEANUP_KEY, before)


def staged(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write an intermediate to the shared checkpoint folder and read it back.

    The written table replaces the plan, so Spark deletes the plan's shuffle files as soon as
    it is done instead of keeping those of all steps until the driver collects garbage.
    """
    with shuffle_cleanup(df.sparkSession):
        return stage_table(df, label, compression)


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let a batch for Python hold some MB however long its texts are, unless the session sets a limit.

    Spark counts rows alone by default, and both sides of the pipe hold a whole batch.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
