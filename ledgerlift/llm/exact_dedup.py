"""Exact deduplication against a persistent index of digests."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.llm.common import stored


def normalised(text) -> F.Column:
    """Runs of space, tab, line feed, vertical tab, form feed and carriage return become one space;
    a null text counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark trusts the order of a bucket that is one file."""
    before = spark.conf.get(_ORDERED)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before)


class DigestIndex:
    """One row per text seen so far: ``digest``, ``keep_id`` (the id that stays), ``first_batch``.

    The table is bucketed and sorted by digest. New rows are reduced to one per digest, joined
    against the index by a sort-merge anti-join, and appended. With as many buckets as the session has shuffle
    partitions, or more, the index is not shuffled for it; with fewer, Spark deals it out anew.
    A batch adds one file to a bucket; while a bucket is one file its order is used, later it is sorted
    within the bucket.
    The files outlive the session: a later one attaches them with the same name, path and number of
    buckets. An entry is never changed, so a text that was kept stays kept.
    """

    def __init__(self, spark: SparkSession, path: str, *, name: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        spark.sql(
            f"create table if not exists {name} (digest string, keep_id {id_type}, first_batch bigint) using parquet "
            f"clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def candidates(self, batch: DataFrame, id: str, digest: str) -> DataFrame:
        """One row per digest of the batch that the index lacks, with the smallest id; ids that are
        null come last."""
        firsts = batch.groupBy(F.col(digest).alias("digest")).agg(F.min(id).alias("keep_id"))
        return firsts.join(self.rows().hint("merge").select("digest"), "digest", "left_anti")

    def append(self, batch: DataFrame, number: int, id: str = "id", digest: str = "digest") -> None:
        """Add the texts of a batch that are new. Repeating a batch adds nothing."""
        with ordered_scans(self.spark):
            new = self.candidates(batch, id, digest).select("digest", "keep_id", F.lit(number).cast("bigint"))
            new.repartition(self.buckets, "digest").write.insertInto(self.name)


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``text_sha256`` of each row, stored. Texts are read here only."""
    digest = F.sha2(normalised(F.col(f"`{text}`")), 256)
    return stored(docs.select(F.col(f"`{id}`").alias("doc_id"), digest.alias("text_sha256")), "digests")


def halves(rows: DataFrame) -> list[DataFrame]:
    """The rows in two batches: ids from the (approximate) median on, and null ones, come second."""
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    if middle is None:
        return [rows]
    early = F.coalesce(F.col("doc_id") < middle, F.lit(False))
    return [rows.where(early), rows.where(~early)]


def resolved(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """For each of the rows of ``digests``, all of them in the index, the row that stays."""
    sizes = rows.groupBy(F.col("text_sha256").alias("digest")).agg(F.count("*").alias("group_size"))
    known = stored(sizes.join(index.rows().hint("merge").select("digest", "keep_id"), "digest"), "groups")
    joined = rows.join(known, rows["text_sha256"] == known["digest"])
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def dedupe_exact(docs: DataFrame, index: DigestIndex, *, batch: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Deduplicate ``docs`` against the index and itself, and add its new texts to the index.

    Returns one row per input row: ``doc_id``, ``keep_id`` (the row that stays), ``group_size`` (rows
    of this batch with that text), ``kept`` and ``text_sha256``. Texts are equal when their normalised
    forms have the same SHA-256. Of equal texts new to the index the row with the smallest id stays;
    a text that the index holds keeps the id it has there, and every row of it is dropped unless it
    is that row again. Ids that repeat within a group are all marked kept, as they name one document;
    where all ids of a group are null, ``keep_id`` is null and its rows are kept. An empty table
    gives no rows. Other columns do not matter.

    Texts are read once, only digests and ids are shuffled. Counts and smallest ids are combined before the shuffle; the
    final join returns the group's row to each of its members, and adaptive execution splits it
    where one group holds much of the table.
    """
    rows = digests(docs, id, text)
    index.append(rows, batch, "doc_id", "text_sha256")
    return resolved(rows, index)
