"""Silver and Gold tables, the confirmed mapping and the vector table at rest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.functions.vectors import check_dim
from ledgerlift.operators.gold import GOLD_TABLES, sorted_gold
from ledgerlift.operators.mapping import MAPPING_SCHEMA, upsert_mapping
from ledgerlift.schemas import EMBEDDING_DIM
from ledgerlift.sources.commits import CommitLog, Conflict
from ledgerlift.sources.shared import CODEC, read_if_present

MAPPING_FILE, MAPPING_VERSIONS = "field_mapping.json", "field_mapping.versions"
_ATTEMPTS = 50
SILVER_TABLES = ("sales_enriched", "controlling_enriched", "delivery_enriched")

_CONFIG_SCHEMA = "map<string, struct<file: string, mapping: array<struct<header: string, canonical: string>>>>"
VECTOR_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType(), containsNull=False)),
])


def write_layer(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the Parquet table at ``path``."""
    df.write.mode("overwrite").option("compression", CODEC).partitionBy(*partition_by).parquet(path)


# --- Silver and Gold: a run is visible once it is listed as published --------------------------

def run_path(folder: str, run_id: str, table: str) -> str:
    """Where a run of Silver or Gold keeps a table."""
    return f"{folder}/run={run_id}/{table}"


def _published_runs(spark: SparkSession, folder: str) -> CommitLog:
    return CommitLog(spark, f"{folder}/published")


def publish(spark: SparkSession, folder: str, run_id: str) -> int:
    """List a complete run as published, and return its number. This one small file makes all its tables
    current at once, with no renaming or copying of data, so it also holds on object stores.

    Runs are numbered in the order of publishing. A number is taken by one driver only; of two that
    publish at a time, one comes after the other.
    """
    entry = {"run_id": run_id, "published_at": datetime.now(timezone.utc).isoformat()}
    return _published_runs(spark, folder).add(json.dumps(entry))


def current_run(spark: SparkSession, folder: str) -> str | None:
    """The run published last, or None."""
    last = _published_runs(spark, folder).last()
    return None if last is None else json.loads(last[1])["run_id"]


def drop_runs(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Delete the data of published runs but for the ``keep`` last ones, and return their ids.

    The current run always stays, and so do runs that are not listed: they may be in the making.
    """
    if keep < 1:
        raise ValueError("keep at least the current run")
    runs = [json.loads(content)["run_id"] for _, content in reversed(_published_runs(spark, folder).entries())]
    dropped = []
    for run_id in runs[keep:]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/run={run_id}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True):
            dropped.append(run_id)
    return dropped


def _published(spark: SparkSession, folder: str, run_id: str | None) -> str:
    run_id = run_id or current_run(spark, folder)
    if run_id is None:
        raise FileNotFoundError(f"nothing published in {folder}")
    return run_id


def read_silver(spark: SparkSession, silver: str, table: str, run_id: str | None = None) -> DataFrame:
    """A Silver table of one run, by default the one published last.

    Find the run once with ``current_run`` where several tables must belong together.
    """
    return spark.read.parquet(run_path(silver, _published(spark, silver, run_id), table))


def gold_ready(spark: SparkSession, gold: str) -> bool:
    """Whether Gold has been built: a run of all its tables is published."""
    return current_run(spark, gold) is not None


def read_gold(spark: SparkSession, gold: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """All six Gold tables of one run by name, rows in no order."""
    run_id = _published(spark, gold, run_id)
    return {name: spark.read.parquet(run_path(gold, run_id, name)) for name in GOLD_TABLES}


def metric(spark: SparkSession, gold: str, name: str) -> DataFrame:
    """One Gold table in its order; file order is never relied on."""
    if name not in GOLD_TABLES:
        raise KeyError(f"unknown metric {name}; there are {', '.join(GOLD_TABLES)}")
    return sorted_gold(spark.read.parquet(run_path(gold, _published(spark, gold, None), name)), name)


def to_records(df: DataFrame) -> DataFrame:
    """Every row as one JSON object in column ``record``; null fields are kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


def metric_json(spark: SparkSession, gold: str, name: str) -> DataFrame:
    """One Gold table as JSON records."""
    return to_records(metric(spark, gold, name))


# --- Confirmed mapping -----------------------------------------------------------------------

def parse_mapping(
    texts: DataFrame, text: str = "value", keep: Sequence[str] = (), *, strict: bool = False
) -> DataFrame:
    """Mapping documents (one JSON object per row) as rows ``MAPPING_SCHEMA``, after ``keep``.

    A text that is no such object yields no rows, or with ``strict`` an error, and so for an entry
    without a list of headers.
    """
    document = F.from_json(text, _CONFIG_SCHEMA)
    if strict:
        document = F.coalesce(document, F.raise_error(F.lit("a mapping is not a JSON object")).cast(_CONFIG_SCHEMA))
    entries = texts.select(*keep, F.explode(document).alias("data_type", "entry"))
    if strict:
        missing = F.concat(F.lit("no mapping in the entry for "), "data_type")
        listed = F.when(F.col("entry.mapping").isNull(), F.raise_error(missing).cast("boolean")).otherwise(True)
        entries = entries.where(listed)
    return entries.select(
        *keep, "data_type", "entry.file", F.posexplode_outer("entry.mapping").alias("position", "item")
    ).select(*keep, "data_type", "file", "position", "item.header", "item.canonical")


def mapping_document(mapping: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The JSON object(s) for mapping rows: one, or one per group of ``by``. Inverse of
    ``parse_mapping``. A document holds the entries of a few data types, so it stays small."""
    item = F.struct("position", "header", "canonical")
    listed = F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), item)))
    entries = mapping.groupBy(*by, "data_type", "file").agg(
        F.transform(listed, lambda i: F.struct(i["header"], i["canonical"])).alias("mapping")
    )
    document = F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("data_type", F.struct("file", "mapping"))
    )))
    return entries.groupBy(*by).agg(
        F.to_json(document, {"ignoreNullFields": "false"}).alias("value")
    )


def _mapping_versions(spark: SparkSession, config: str) -> CommitLog:
    return CommitLog(spark, f"{config}/{MAPPING_VERSIONS}")


def _mapping_text(spark: SparkSession, config: str) -> tuple[int, DataFrame | None]:
    """The number and text of the version in force. The plain file counts as version 0."""
    last = _mapping_versions(spark, config).last()
    if last is not None:
        return last[0], spark.createDataFrame([(last[1],)], "value string")
    return 0, read_if_present(spark, f"{config}/{MAPPING_FILE}", "text", wholetext=True)


def load_mapping(spark: SparkSession, config: str, *, strict: bool = False) -> DataFrame | None:
    """The confirmed mapping as rows ``MAPPING_SCHEMA``; None when there is none.

    That is the version saved last, or before any is saved the file ``field_mapping.json``.
    """
    text = _mapping_text(spark, config)[1]
    return None if text is None else parse_mapping(text, strict=strict)


def save_mapping(mapping: DataFrame, config: str, *, after: int | None = None) -> int:
    """Save the given rows as the next version of the mapping and return its number; older versions stay.

    With ``after``, the version that the rows were made from, it is an error (``Conflict``) if another
    was saved since. A mapping is a control document of a few dozen rows; they pass through the driver.
    """
    document = mapping_document(mapping).collect()
    content = document[0]["value"] if document else "{}"
    return _mapping_versions(mapping.sparkSession, config).add(content, after)


def confirm_mapping(
    spark: SparkSession, config: str, data_type: str, file: str,
    mapping: Sequence[tuple[str, str | None]],
) -> int:
    """Store the reviewed mapping of one data type, keep the other types' entries, and return the version.

    Where another reviewer saved meanwhile, their version is read and the entry is put into that.
    """
    rows = [(data_type, file, i, header, canonical) for i, (header, canonical) in enumerate(mapping)]
    new = spark.createDataFrame(rows or [(data_type, file, None, None, None)], MAPPING_SCHEMA)
    for _ in range(_ATTEMPTS):
        version, text = _mapping_text(spark, config)
        merged = new if text is None else upsert_mapping(parse_mapping(text), new)
        try:
            return save_mapping(merged, config, after=version)
        except Conflict:
            continue
    raise Conflict(f"{_ATTEMPTS} others saved a mapping in {config} meanwhile")


# --- Vectors ---------------------------------------------------------------------------------

def write_vectors(df: DataFrame, path: str, dim: int = EMBEDDING_DIM) -> str:
    """Publish a new vector table as a run and return the run's id. A vector of another length fails the
    write; readers then keep the table published before."""
    run_id = uuid.uuid4().hex
    checked = df.withColumn("vector", check_dim(F.col("vector"), dim))
    write_layer(checked.select("text", "table_name", "vector"), run_path(path, run_id, "vectors"))
    publish(df.sparkSession, path, run_id)
    return run_id


def read_vectors(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The vector table of one run, by default the one published last; without any, an empty table."""
    run_id = run_id or current_run(spark, path)
    return spark.createDataFrame([], VECTOR_SCHEMA) if run_id is None else spark.read.parquet(run_path(path, run_id, "vectors"))
