"""Helpers shared by the operators: stored intermediate tables and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.sources.shared import work_dir


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.parquet(path)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back.

    This cuts lineage: a lost executor costs the running stage only, and a table read twice is
    computed once. The shuffle files of the write go when it ends, as nothing reads them any more.
    """
    return _write(df, work_dir(df.sparkSession, purpose))


class Scratch:
    """Stored tables that are removed when the ``with`` block ends, also by an error.

    What is still needed then has to be stored elsewhere before.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stored(self, df: DataFrame, purpose: str) -> DataFrame:
        self.paths.append(work_dir(self.spark, purpose))
        return _write(df, self.paths[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *problem: object) -> None:
        context = self.spark.sparkContext
        for name in self.paths:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def schema_of(df: DataFrame, keep: list[str], ddl: str) -> T.StructType:
    """The fields ``keep`` of a table, then those of ``ddl``."""
    return T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL(ddl).fields)


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, none empty, cut where the values of a column reach ``limit`` bytes, to bound what a task holds."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for low, high in zip(starts, np.append(starts[1:], len(part)), strict=True):
            yield batch.slice(low, high - low)


def min_labels(
    edges: DataFrame, purpose: str = "components", store: Callable[[DataFrame, str], DataFrame] = stored
) -> DataFrame:
    """Connected components of an undirected graph given by its edges ``a``, ``b``.

    Returns (``node``, ``label``), where the label is the smallest node reachable; nodes without an
    edge are absent. The result reads what ``store`` has written. Large-star and small-star rounds: every round links each node to the smallest of
    its neighbours, both of them aggregations with map-side combining plus a join, until no edge
    changes; the number of rounds grows with the logarithm of the graph's diameter. Each round is
    written to the shared folder. Only a count and a sum of hashes reach the driver.
    """
    def both_ways(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        """``a`` above ``b`` in every edge given and returned."""
        sides = both_ways(e) if large else e
        smallest = sides.groupBy("a").agg(F.min("b").alias("m"))
        smallest = smallest.select("a", F.least("a", "m").alias("m"))
        moved = sides.join(smallest, "a")
        if large:
            moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            linked = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                       F.struct(F.col("a"), F.col("m").alias("b"))))
            moved = moved.select(linked.alias("e")).select("e.a", "e.b")
        return moved.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    current = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        purpose,
    )
    before = state(current)
    while True:
        current = store(star(star(current, large=True), large=False), purpose)
        now = state(current)
        if now == before:
            break
        before = now
    # Every node above its component's smallest has one edge, to it.
    tops = current.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("label"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(tops)
