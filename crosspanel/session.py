"""Session helpers: local sessions for tests and benches, checkpoint location."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "crosspanel") -> SparkSession:
    """A local session with the settings the test-suite and the bench rely on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, reading the cluster's setting first.

    Only a local session without a setting gets a temporary folder; on a cluster
    a missing setting is an error, since executors must share the folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="crosspanel-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in tasks import the package; a session started elsewhere, or
    a cluster without ``--py-files``, would not find it.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="crosspanel-package-")) / "crosspanel_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def stage_table(df: DataFrame, label: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Used where a plan needs the same intermediate result several times.  It cuts
    the lineage, survives the loss of executors, and unlike an RDD checkpoint the
    readers still prune columns and know the table's size.  ``compression``: a Parquet codec,
    the session's unless given.
    """
    spark = df.sparkSession
    path = f"{_stage_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, tasks: Sequence[Callable[[], T]]) -> list[T]:
    """Run independent Spark actions from a few threads, so their jobs overlap."""
    if len(tasks) < 2:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=min(len(tasks), 6)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]
        return [r.result() for r in running]


def stage_tables(**frames: DataFrame) -> list[DataFrame]:
    """Stage several independent frames at the same time, labelled by argument name."""
    spark = next(iter(frames.values())).sparkSession
    return together(spark, [lambda d=d, n=n: stage_table(d, n) for n, d in frames.items()])


def _stage_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/staged-tables"


def drop_stages(spark: SparkSession) -> bool:
    """Delete this application's staged tables; frames built on them become invalid."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
