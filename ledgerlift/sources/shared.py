"""The shared folder for work files, and path checks."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

# Numbers kept as text, as in Bronze, take about a third of what Spark's default codec leaves of them.
CODEC = "zstd"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor must reach.

    Without that setting, local mode uses a temporary folder and says so; on a cluster it is an error,
    as executors could not see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ledgerlift-")
        log.warning("spark.checkpoint.dir is not set, work files go to %s", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, whatever file system holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when each ends, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def side_by_side[R](spark: SparkSession, steps: Iterable[Callable[[], R]], at_once: int | None = None) -> list[R]:
    """The results of independent steps, each of which starts its own jobs, in their order.

    The jobs are submitted from several threads, so the cores that the last tasks of one leave idle go to the next.
    No more than ``at_once`` steps, by default all, are under way at a time. All that were begun end before the first
    error, if any, is raised.
    """
    steps = list(steps)
    with ThreadPoolExecutor(max(1, min(len(steps), at_once or len(steps)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def read_if_present(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame | None:
    """The table at ``path``, or None when there is no such path."""
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
