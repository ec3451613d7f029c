"""Raw ERP exports: landing them, reading them, listing their headers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.functions.headers import header_names
from ledgerlift.schemas import LANDED_BATCH, POSITION, ContractError
from ledgerlift.sources.commits import CommitLog
from ledgerlift.sources.quoted import quoted_records
from ledgerlift.sources.shared import CODEC, remove

# The exports' dialect: quotes are doubled, an empty cell is null, a quoted empty cell is ''. The
# two are told apart by a null marker that no export contains.
_CSV = {"header": True, "escape": '"', "nullValue": "\0", "emptyValue": "", "enforceSchema": False}

_RAW = "_raw_record"  # the text of records whose number of cells is not the header's

_POSITION_PARTS = ("_metadata.file_path", "_metadata.file_block_start")


def csv_options(multiline: bool = False) -> dict[str, object]:
    """Options for reading an export. Every column is a string: nothing is inferred."""
    return {**_CSV, "multiLine": multiline}


def tidy_names(df: DataFrame) -> DataFrame:
    """Column names without surrounding space, quotes or BOM, as header matching sees them."""
    tidy = {c: c.removeprefix("\ufeff").strip().strip('"') for c in df.columns}
    return df.withColumnsRenamed({c: t for c, t in tidy.items() if t and t != c})


def export_schema(spark: SparkSession, path: str, multiline: bool = False) -> T.StructType:
    """All strings, named by the header of the first file."""
    return spark.read.options(**csv_options(multiline)).csv(path).schema


def raw_reader(reader, schema: T.StructType, multiline: bool = False):
    """A batch or stream reader that also keeps the raw text of records of another number of cells."""
    # Without pruning, cells are counted whichever columns are read.
    options = {**csv_options(multiline), "columnNameOfCorruptRecord": _RAW, "columnPruning": False}
    return reader.schema(T.StructType([*schema.fields, T.StructField(_RAW, T.StringType())])).options(**options)


def whole_records(df: DataFrame, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """The rows without the raw text, or an error at a record that would lose data.

    A record with more cells than the header has is one, and so is, unless ``multiline`` is given, a
    record with a quote that is not closed, as its rest stands on the next line. A record with fewer
    cells is complete: the others are null.
    """
    cells = ", ".join(f"c{i} string" for i in range(len(schema.names)))
    beyond = F.from_csv(_RAW, f"{cells}, beyond string", {
        k: str(v) for k, v in csv_options(multiline).items() if k in ("escape", "nullValue", "emptyValue")
    })["beyond"]
    broken = F.length(_RAW) - F.length(F.replace(F.col(_RAW), F.lit('"'), F.lit("")))
    message = F.when(beyond.isNotNull(), F.concat(F.lit("a record has more cells than the header: "), F.col(_RAW)))
    if not multiline:
        message = F.when(broken % 2 == 1, F.concat(
            F.lit("a quote is not closed on its line, read with multiline=True: "), F.col(_RAW)
        )).otherwise(message)
    # A filter is never pruned, whichever columns are read.
    fine = F.when(F.col(_RAW).isNotNull() & message.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True)
    # Spark refuses to read the raw text alone, so another column is named.
    return df.where(fine & (F.coalesce(F.length(f"`{schema.names[0]}`"), F.lit(0)) >= 0)).drop(_RAW)


def _read_quoted(spark: SparkSession, path: str, schema: T.StructType, with_position: bool) -> DataFrame:
    """The rows of exports whose quoted cells may hold line breaks, each file read by many tasks."""
    records = quoted_records(spark, path)
    options = {k: str(v) for k, v in csv_options(True).items() if k in ("escape", "nullValue", "emptyValue", "multiLine")}
    cells = [f"c{i}" for i in range(len(schema.names))]
    # The header is the first record of each file; it has to be the same in all.
    header = F.from_csv(F.replace("value", F.lit("\ufeff"), F.lit("")), ", ".join(f"{c} string" for c in cells), options)
    different = records.where("head").select(header.alias("header")).distinct().limit(2).collect()
    if len(different) > 1:
        raise ContractError(f"the files at {path} differ in their header")
    parsed = F.from_csv("value", ", ".join(f"{c} string" for c in [*cells, _RAW]), {**options, "columnNameOfCorruptRecord": _RAW})
    place = F.struct(F.col("file").alias("file_path"), F.col("block").alias("file_block_start"), F.col("line").alias("row"))
    rows = records.where("not head").select(parsed.alias("cell"), place.alias("place"))
    df = rows.select(
        *(F.col(f"cell.{c}").alias(name) for c, name in zip(cells, schema.names, strict=True)), f"cell.{_RAW}",
        *([F.col("place").alias(POSITION)] if with_position else []),
    )
    return whole_records(df, schema, multiline=True)


def manifest(spark: SparkSession, target: str) -> CommitLog:
    """Where the compactions of a landed table are listed."""
    return CommitLog(spark, f"{target.rstrip('/')}.manifest")


def compacted(spark: SparkSession, target: str) -> tuple[int, dict]:
    """The number of the manifest entry in force (0 for none), the last batch that it covers and its folders."""
    last = manifest(spark, target).last()
    return (0, {"upto": -1, "folders": []}) if last is None else (last[0], json.loads(last[1]))


def _read_landed(spark: SparkSession, path: str) -> DataFrame:
    """A landed table: batches that a compaction has gathered are read from its files."""
    df = spark.read.parquet(path)
    if LANDED_BATCH not in df.columns:
        return df
    _, state = compacted(spark, path)
    later = df.where(F.col(LANDED_BATCH) > state["upto"]).drop(LANDED_BATCH)
    return later.unionByName(spark.read.parquet(*state["folders"])) if state["folders"] else later


def read_bronze(
    spark: SparkSession, path: str, *, with_position: bool = False, multiline: bool = False
) -> DataFrame:
    """Read a landed export, CSV or (name ending in ``.parquet``) landed Parquet, as strings.

    All files of a CSV folder must have the header of the first one; a file that differs is an
    error rather than shifted columns, and so is a record that would lose data (``whole_records``).
    ``with_position`` adds the struct ``_pos`` that orders rows as they stood in their files, whatever
    the splits. ``multiline`` allows line breaks inside quotes: files are split all the same, at the price
    of keeping their lines once in the shared folder (``quoted_records``).
    """
    if path.rstrip("/").endswith(".parquet"):
        df = _read_landed(spark, path)
        stored = POSITION in df.columns
        if stored and not with_position:
            return df.drop(POSITION)
        if stored:
            return df
    else:
        schema = export_schema(spark, path, multiline)
        if multiline:
            return tidy_names(_read_quoted(spark, path, schema, with_position))
        df = raw_reader(spark.read, schema).csv(path)
        if with_position:
            place = F.struct(*_POSITION_PARTS, F.monotonically_increasing_id().alias("row"))
            df = df.select("*", place.alias(POSITION))
        return tidy_names(whole_records(df, schema))
    if with_position:
        place = F.struct(*_POSITION_PARTS, F.monotonically_increasing_id().alias("row"))
        df = df.select("*", place.alias(POSITION))
    return tidy_names(df)


def bronze_name(path: str) -> str:
    """Name under which an export is landed: its base name, as Parquet."""
    return f"{PurePosixPath(path).stem}.parquet"


def land_bronze(
    spark: SparkSession, source: str, bronze: str, *, multiline: bool = False, clean_source: bool = False
) -> str:
    """Land an export in Bronze as Parquet and return its name there.

    Only the base name of ``source`` counts, and an earlier export of that name is replaced. There
    is no shuffle: every input split is written by the task that reads it. With ``clean_source`` the export is
    deleted once all of it is landed; one that cannot be landed stays.
    """
    name = bronze_name(source)
    df = read_bronze(spark, source, with_position=True, multiline=multiline)
    df.write.mode("overwrite").option("compression", CODEC).parquet(f"{bronze}/{name}")
    if clean_source:
        remove(spark, source)
    return name


def header_rows(lines: DataFrame, line: str, *keys: str) -> DataFrame:
    """One row per header name: the keys, ``position`` (from 0) and ``header``."""
    return lines.select(*keys, F.posexplode(header_names(F.col(line))).alias("position", "header"))


_HEADER_BYTES = 1 << 20  # a header row is shorter


def _fetch_first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        lines = []
        for path in batch["path"]:
            filesystem, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
            with filesystem.open_input_stream(inner) as stream:
                start = b""
                while not re.search(rb"[\r\n]", start) and (chunk := stream.read(65536)):
                    start += chunk
                    if len(start) > _HEADER_BYTES:
                        raise ValueError(f"no line break in the first {_HEADER_BYTES} bytes of {path}")
            try:
                lines.append(re.split(rb"[\r\n]", start, maxsplit=1)[0].decode("utf-8-sig"))
            except UnicodeDecodeError:
                lines.append("")  # no header that could be read
        yield pd.DataFrame({"file": batch["path"], "line": lines})


def extract_headers(
    spark: SparkSession, folder: str, pattern: str = "*.csv", *, scan: bool = False
) -> DataFrame:
    """Header names of every export below ``folder``: ``file``, ``position``, ``header``.

    Spark lists the files without reading them; tasks then fetch each file up to its first line
    break, which must come within the first megabyte, through Arrow's file systems. A first line
    that is no UTF-8 gives no headers. ``scan`` reads all files as text instead: it works on every
    file system that Spark knows, but reads all of their data for one line each.
    """
    found = {"recursiveFileLookup": True, "pathGlobFilter": pattern}
    if scan:
        rows = spark.read.options(**found).text(folder).select(
            "value", *_POSITION_PARTS, F.monotonically_increasing_id().alias("row")
        )
        # One row per file leaves each task; a file's first line is in its first block.
        lines = rows.where("file_block_start = 0").groupBy(F.col("file_path").alias("file")).agg(
            F.min_by("value", "row").alias("line")
        )
    else:
        files = spark.read.format("binaryFile").options(**found).load(folder).select("path")
        lines = files.mapInPandas(_fetch_first_lines, "file string, line string")
    return header_rows(lines, "line", "file")
