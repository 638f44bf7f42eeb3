"""Session set-up and the shared-folder checkpoint used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; ``conf`` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a checkpoint goes with the frame that it was made for
    } | {k: str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate data: the session's ``spark.checkpoint.dir``.

    Where none is set, a temporary one is made, removed at exit; that is for tests on one machine, so
    on any master other than a local one it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[application], ignore_errors=True)
    return _LOCAL_DIRS[application]


_LOCAL_DIRS: dict[str, str] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """An upper bound on the number of partitions that a shuffle of this session has."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    return max(int(v) for v in (spark.conf.get(n, None) or "1" for n in names))


def scan_width(df: DataFrame) -> int:
    """About how many tasks read the input of ``df`` where no shuffle comes first, by the planner's size of it; 0 if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    per_task = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes"))
    return -(-size // per_task) if size < 1 << 60 else 0


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input is too small to be read by as many tasks, else as it is.

    For rows that Python works on for long: a file with one row group would be one task. What is moved
    is less than a scan task's size for each core; larger inputs are read by enough tasks already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not 0 < scan_width(df) < cores:
        return df
    return df.withColumn("__row", F.monotonically_increasing_id()).repartition(cores, "__row").drop("__row")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that they can import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tidemark-')}/tidemark-package", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
