"""Small helpers around the Spark session."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from nodelake.errors import Validation


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a local session (as in tests) gets a temporary folder; on a cluster each
    executor would write to a disk of its own, so there it is an error.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not spark.sparkContext.master.split("[")[0] == "local":
            raise Validation("spark.checkpoint.dir must name a folder that driver and executors share")
        set_to = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="nodelake-")
        if not known.isDefined():
            spark.sparkContext.setCheckpointDir(set_to)
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to


#: Bytes of an Arrow batch between Spark and its Python workers.
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let rows of long texts go to Python in batches of a few megabytes, unless the session says otherwise.

    Spark counts rows by default (10,000), so the memory of a worker would follow the length of the texts.
    """
    if not spark.sparkContext.getConf().contains(BATCHES):
        spark.conf.set(BATCHES, "4m")


#: With it, Spark deletes the shuffle files of a written table as soon as the table is there.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables ``stored`` inside are deleted at the end, but for those with ``keep``: nothing that is returned may
    still read them."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    The rows outlive lost executors, unlike a local checkpoint; the shuffle files behind them go. With ``keep``
    the table outlives the ``scratch`` it is written in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    scope = _scopes[-1 - keep] if len(_scopes) > keep else None
    if scope is not None:
        scope.append(path)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were started without it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_nodelake_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    zipped = os.path.join(tempfile.mkdtemp(prefix="nodelake-"), "nodelake.zip")
    with zipfile.ZipFile(zipped, "w") as z:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(zipped)
    sc._nodelake_shipped = True
