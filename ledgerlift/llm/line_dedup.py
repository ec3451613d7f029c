"""Removal of runs of lines that stood earlier in the corpus, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import schema_of, sliced, stored

_BLANK = " \t\r\f\v"


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _solid(lines: list[str]) -> list[int]:
    """Places of the lines that are not blank."""
    return [i for i, line in enumerate(lines) if line.strip(_BLANK)]


def winnow(hashes: list[int], width: int) -> list[int]:
    """For every window of ``width`` hashes the place of its minimum, the rightmost among equals."""
    if len(hashes) < width:
        return []
    h = np.lib.stride_tricks.sliding_window_view(np.array(hashes, dtype=np.uint64)[::-1], width)
    return (len(hashes) - 1 - (np.argmin(h, axis=1) + np.arange(len(h))))[::-1].tolist()


def _windows(min_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            source, fp, head, start, window = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                lines = _lines(text)
                solid = [lines[i].encode() for i in _solid(lines)]
                hashes = [xxhash.xxh3_64_intdigest(line) for line in solid]
                before = -1
                for i, place in enumerate(winnow(hashes, min_lines)):
                    source.append(row)
                    fp.append(hashes[place])
                    head.append(place != before)
                    start.append(i)
                    window.append(xxhash.xxh3_128_digest(b"\n".join(solid[i:i + min_lines])))
                    before = place
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("k").take(at),
                 pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(head, pa.bool_()),
                 pa.array(start, pa.int32()), pa.array(window, pa.binary())],
                names=["doc_id", "k", "fp", "head", "start", "window"],
            )
    return run


def _cut(min_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, totals, removed = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                lines = _lines(text)
                solid = _solid(lines)
                gone = {solid[i] for s in starts or () for i in range(s, s + min_lines)}
                texts.append(text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone))
                totals.append(0 if text is None else len(lines))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
                names=["row", "kept", "n_lines", "n_removed"],
            )
    return run


def dedupe_lines(docs: DataFrame, *, min_lines: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the runs of ``min_lines`` or more lines that occur earlier.

    Returns the columns of ``docs`` with the text replaced, and ``n_lines`` and ``n_removed`` (longs,
    replacing columns of these names). A line goes if it is covered by ``min_lines`` consecutive lines
    that also stand at an earlier place, of this or another document. Documents are ordered by id
    (null first), those of one id by a hash of their text. Lines end at ``\\n`` and are compared
    exactly; blank lines count for nothing, are skipped in runs, and always stay.

    Every window of ``min_lines`` line hashes selects its minimum as a fingerprint, so two equal runs
    share a selected fingerprint at the same place. Fingerprints that occur once are put aside;
    windows around the others are joined, as positions, with the first occurrence of the same
    window, and adjacent matches run together in both directions. Windows are compared by a 128-bit
    hash of their lines. First occurrences are combined before the shuffle; frequent windows only
    ever meet their first occurrence, never each other.

    Null texts stay null and empty ones empty. Rows equal in id and text count as one document and
    are treated alike. An empty table gives no rows.
    """
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed") and c != text]
    row = F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(True))  # a struct must not be empty
    keyed = docs.select(
        F.col(f"`{id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("k"), F.col(f"`{text}`").alias("text"),
        row.alias("row"),
    )
    plain = keyed.select("doc_id", "k", "text")
    schema = schema_of(plain, ["doc_id", "k"], "fp bigint, head boolean, start int, window binary")
    windows = stored(plain.mapInArrow(_windows(min_lines), schema), "windows")
    shared = windows.where("head").groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    candidates = windows.join(shared, "fp").select("window", F.struct("doc_id", "k", "start").alias("place"))
    firsts = candidates.groupBy("window").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    later = candidates.join(firsts.select("window", "first"), "window").where("place <> first")
    runs = later.groupBy("place.doc_id", "place.k").agg(F.collect_set("place.start").alias("starts"))
    runs = runs.select(F.col("doc_id").alias("run_id"), F.col("k").alias("run_k"), "starts")
    joined = keyed.join(runs, keyed["doc_id"].eqNullSafe(runs["run_id"]) & (keyed["k"] == runs["run_k"]), "left")
    schema = schema_of(keyed, ["row"], "kept string, n_lines bigint, n_removed bigint")
    done = joined.select("row", "text", "starts").mapInArrow(_cut(min_lines), schema)
    kept = [
        F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`")
        for c in docs.columns if c.lower() not in ("n_lines", "n_removed")
    ]
    return done.select(*kept, "n_lines", "n_removed")
