"""Session settings and the durable cut of a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the engine's settings, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera").config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions or cores)).config("spark.ui.enabled", "false")
    spark = builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Gives the package to the session's Python workers, once; they may not have it on their path."""
    context = spark.sparkContext
    if not getattr(context, "_tessera_shipped", False):
        package = Path(__file__).resolve().parent
        staging = tempfile.mkdtemp(prefix="tessera-")  # the driver's own; executors fetch the archive from the driver
        atexit.register(shutil.rmtree, staging, ignore_errors=True)
        clean = Path(staging, "clean", package.name)
        shutil.copytree(package, clean, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{staging}/{package.name}-package", "zip", clean.parent, package.name))
        context._tessera_shipped = True
    return spark


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder that all executors share.

    The folder comes from ``spark.checkpoint.dir``. Only a local session (tests) without it
    gets a temporary one, removed at exit; a cluster without it is refused, as no folder of
    one machine would do. The result survives the loss of executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def together(*makers: Callable[[], T]) -> list[T]:
    """The results of functions that each run jobs of their own, run at the same time, so that small jobs fill each other's gaps."""
    with ThreadPoolExecutor(max(1, len(makers))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(SparkSession.active())(m)) for m in makers]]


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set if it wasn't."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def sampled(df: DataFrame, rows: int, most: int, seed: int = 5) -> DataFrame:
    """About ``most`` of the ``rows`` rows of ``df`` (all if there are no more), each row by itself.

    Nothing is sorted or gathered, so no task sees more than its own part of the sample.
    """
    return df if rows <= most else df.sample(False, most / rows, seed)
