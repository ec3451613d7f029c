"""Records of delimited text whose quotes hold line breaks, found without reading a file in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlift.sources.shared import work_dir

_PLACE = ("file", "block")


def end_state(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a line that begins inside (or outside) a quoted cell ends inside one.

    A quote opens a cell only as its first character, and two quotes inside are one; behind a closing quote
    the cell goes on to the next delimiter.
    """
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] != '"':
                at = line.find(delimiter, at) + 1
                if at == 0:
                    return False
                continue
            inside, at = True, at + 1
        close = line.find('"', at)
        if close < 0:
            return True
        if line[close + 1:close + 2] == '"':
            at = close + 2
            continue
        at = line.find(delimiter, close + 1) + 1
        inside = False
        if at == 0:
            return False


def _scan(delimiter: str):
    """Per line, for the cases that its split begins outside (0) and inside (1) a quoted cell: whether the line begins
    inside, whether it ends inside, and the line of the split on which its record begins (-1: in an earlier split).
    ``head`` marks the first line of a file that is not empty. Only lines with quotes are looked at one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, headed = None, 0, True
        state, record = [False, True], [-1, -1]
        for batch in batches:
            files, blocks = batch.column("file"), batch.column("block").to_numpy()
            codes = files.dictionary_encode().indices.to_numpy()
            values = batch.column("value")
            quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
            quoted_lines = values.take(pa.array(quoted)).to_pylist()
            solid = np.flatnonzero(pc.invert(pc.match_substring_regex(values, "^\r?$")).to_numpy(zero_copy_only=False))
            index, head = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
            columns = np.zeros((6, len(codes)), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(blocks) != 0)])[:len(codes)])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=True):
                if (files[a].as_py(), blocks[a]) != place:
                    place, number = (files[a].as_py(), blocks[a]), 0
                    state, record, headed = [False, True], [-1, -1], blocks[a] > 0
                index[a:b] = np.arange(number, number + b - a)
                number += b - a
                first = np.searchsorted(solid, a)
                if not headed and first < len(solid) and solid[first] < b:
                    head[solid[first]] = headed = True
                low, high = np.searchsorted(quoted, (a, b))
                states = [list(state)]  # before the first line with quotes, and behind each
                for line in quoted_lines[low:high]:
                    outside, inside = states[-1]
                    ended = end_state(line, outside, delimiter)
                    states.append([ended, ended if inside == outside else end_state(line, inside, delimiter)])
                known = np.array(states)
                passed = np.searchsorted(quoted[low:high], np.arange(a, b))
                is_quoted = np.zeros(b - a, np.int64)
                is_quoted[quoted[low:high] - a] = 1
                for h in (0, 1):
                    begins = known[passed, h]
                    begun = np.maximum.accumulate(np.where(begins, -1, index[a:b]))
                    columns[3 * h:3 * h + 3, a:b] = begins, known[passed + is_quoted, h], np.maximum(begun, record[h])
                    record[h] = int(columns[3 * h + 2, b - 1])
                state = states[-1]
            yield pa.RecordBatch.from_arrays(
                [files, batch.column("block"), pa.array(index), values, pa.array(head), *map(pa.array, columns)],
                names=["file", "block", "line", "value", "head", "in0", "out0", "record0", "in1", "out1", "record1"],
            )
    return run


_SCANNED = (
    "file string, block bigint, line bigint, value string, head boolean, in0 bigint, out0 bigint, record0 bigint, "
    "in1 bigint, out1 bigint, record1 bigint"
)


def _split_states(lines: DataFrame) -> DataFrame:
    """Per split: whether it begins inside a quoted cell, and the record that is open there.

    A split maps the state before it to the one behind it: it keeps it, turns it round, or fixes it. So the
    state anywhere is that of the last split that fixed it, turned round as often as splits turned it since.
    """
    splits = lines.groupBy(*_PLACE).agg(
        F.max_by("out0", "line").alias("out0"), F.max_by("out1", "line").alias("out1"),
        F.max("record0").alias("last0"), F.max("record1").alias("last1"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("out0") == 1) & (F.col("out1") == 0)
    splits = splits.withColumn("turned", F.coalesce(F.sum(turns.cast("long")).over(before), F.lit(0)))
    fixed = F.when(F.col("out0") == F.col("out1"), F.struct("out0", "turned"))
    splits = splits.withColumn("fixed", F.last(fixed, ignorenulls=True).over(before))
    state = (F.coalesce("fixed.out0", F.lit(0)) + F.col("turned") - F.coalesce("fixed.turned", F.lit(0))) % 2
    last = F.when(state == 0, F.col("last0")).otherwise(F.col("last1"))
    begun = F.when(F.col("last") >= 0, F.struct("block", F.col("last").alias("line")))
    return splits.select(*_PLACE, state.alias("state"), last.alias("last")).select(
        *_PLACE, "state", F.last(begun, ignorenulls=True).over(before).alias("open")
    )


def quoted_records(
    spark: SparkSession, path: str, *, delimiter: str = ",", max_record_bytes: int = 64 << 20
) -> DataFrame:
    """The records of all text files at ``path``: ``file``, ``block`` and ``line`` (the split and its line where a record
    begins, which order the records of a file), ``head`` (whether it is its file's first) and ``value``, its text
    without the line end.

    A quoted cell may hold line breaks; line ends are \\n or \\r\\n. Files are split like any text: each line is
    scanned once for both cases, that its split begins outside or inside a quoted cell, and kept with both
    outcomes in the shared folder; a row per split then tells which case holds. Records of one line stay
    where they are, only the lines of longer ones are shuffled. Empty lines between records are left out. A
    record above ``max_record_bytes`` is an error, as a quote is not closed then.
    """
    rows = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    stage = work_dir(spark, "quoted")
    rows.mapInArrow(_scan(delimiter), _SCANNED).write.parquet(f"{stage}/lines")
    lines = spark.read.parquet(f"{stage}/lines")
    # A row per split of a file; read back, its size is known to the planner, which broadcasts it or not.
    _split_states(lines).write.parquet(f"{stage}/splits")
    splits = spark.read.parquet(f"{stage}/splits")

    def case(name: str) -> Column:
        return F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    own = F.when(case("record") >= 0, F.struct("block", case("record").alias("line"))).otherwise(F.col("open"))
    placed = lines.join(splits, [*_PLACE]).select(
        *_PLACE, "line", "head", "value", (case("in") + case("out") == 0).alias("whole"), own.alias("begun"),
    )
    # The text hangs on the case, so nothing that is made of it can be moved to where the case is not known.
    own_text = F.when(F.col("whole"), F.col("value")).alias("value")
    whole = placed.where("whole").select(*_PLACE, "line", "head", own_text)
    parts = placed.where("not whole")
    sizes = parts.groupBy("file", "begun").agg(F.sum(F.octet_length("value") + 1).alias("size"))
    if not sizes.where(F.col("size") > max_record_bytes).isEmpty():
        raise ValueError(f"a record of more than {max_record_bytes} bytes in {path}: a quote is not closed")
    ordered = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    long = parts.groupBy("file", "begun").agg(
        F.max("head").alias("head"), F.array_join(F.transform(ordered, lambda p: p["value"]), "\n").alias("value")
    ).select("file", "begun.block", "begun.line", "head", "value")
    text = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return whole.unionByName(long).select(*_PLACE, "line", "head", text.alias("value")).where("value <> ''")
