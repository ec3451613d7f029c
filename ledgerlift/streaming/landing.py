"""Incremental landing: every new export file is picked up once, and small files are gathered into large ones."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlift.schemas import LANDED_BATCH, POSITION
from ledgerlift.sources.bronze import compacted, export_schema, manifest, raw_reader, tidy_names, whole_records


def land_bronze_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    *,
    schema: T.StructType | None = None,
    max_files_per_batch: int | None = None,
    multiline: bool = False,
) -> StreamingQuery:
    """Start landing the CSV files in folder ``source`` in Parquet table ``target``; all files that
    are there now are processed, then the query ends. Run it again to pick up later files.

    ``schema`` defaults to all strings, named by the header of the first file found; names are tidied
    as in ``read_bronze``, and a record that would lose data ends the query. A micro-batch replaces
    its own folder, so one repeated after a failure leaves no duplicates; ``read_bronze`` drops the
    column that other readers see for it. Nothing is shuffled and no state is kept besides the
    checkpoint.
    """
    if schema is None:
        schema = export_schema(spark, source, multiline)
    reader = raw_reader(spark.readStream, schema, multiline)
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    exports = reader.csv(source).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        place = F.struct(
            F.col("_file").alias("file_path"), F.col("_block").alias("file_block_start"),
            F.monotonically_increasing_id().alias("row"),
        )
        landed = whole_records(batch.withColumn(POSITION, place).drop("_file", "_block"), schema, multiline)
        tidy_names(landed).write.mode("overwrite").parquet(f"{target}/{LANDED_BATCH}={batch_id}")

    return (
        exports.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact_landed(spark: SparkSession, target: str, *, file_bytes: int = 256 << 20) -> int | None:
    """Gather the small files of the micro-batches landed so far into files of about ``file_bytes``, and return the
    number of the last batch gathered, or None when there is nothing to gather.

    The rows are written aside, and one manifest entry then puts them in the place of their batches for all
    who read by ``read_bronze``; running readers keep what they listed. The newest batch stays as it is, for it is the
    one that a stream may repeat after a failure. Of two compactions at a time one gives up with an error, and one
    that dies leaves files that nothing lists. Batches gathered before are not written again. Nothing is shuffled.
    """
    last, state = compacted(spark, target)
    landed = spark.read.parquet(target)
    newest = landed.agg(F.max(LANDED_BATCH)).first()[0]
    if newest is None or newest - 1 <= state["upto"]:
        return None
    rows = landed.where((F.col(LANDED_BATCH) > state["upto"]) & (F.col(LANDED_BATCH) < newest))
    files = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
    size = files.agg(F.sum("size")).first()[0]
    if size is None:
        return None
    folder = f"{target}.compacted/{uuid.uuid4().hex}"
    rows.drop(LANDED_BATCH).coalesce(max(1, -(-size // file_bytes))).write.parquet(folder)
    entry = {"upto": newest - 1, "folders": [*state["folders"], folder]}
    manifest(spark, target).add(json.dumps(entry), after=last)
    return newest - 1


def drop_gathered(spark: SparkSession, target: str) -> int:
    """Delete the folders of batches that a compaction has gathered, once no reader that began before it is left;
    returns how many went."""
    _, state = compacted(spark, target)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for status in files.listStatus(hadoop.Path(target)):
        name = status.getPath().getName()
        batch = name.removeprefix(f"{LANDED_BATCH}=")
        if batch != name and batch.isdigit() and int(batch) <= state["upto"]:
            gone += bool(files.delete(status.getPath(), True))
    return gone
