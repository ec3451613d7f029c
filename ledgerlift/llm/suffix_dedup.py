"""Removal of long byte strings that stand more than once in the corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.bwt import repeated_starts
from ledgerlift.llm.common import Scratch, schema_of, sliced, stored
from ledgerlift.llm.shingles import mixed

GRAM = 16  # bytes of an anchor
_CHUNK = 1 << 18  # window starts handled at once
_PLACE_BITS = np.uint64(20)
_BLOCK_BYTES = 1 << 18  # of an index, which fits in the processor's cache
GROUP_SEGMENTS = 2048  # different segments of one anchor that meet in one index


def gram_hashes(data: bytes | memoryview, start: int, end: int) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at every place from ``start`` that fit before ``end``."""
    n = end - start - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((n + 8,), "<u8", buffer=data, offset=start, strides=(1,)).copy()
    return mixed(words[:n] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[8:]))


def anchors(data: bytes | memoryview, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor, over texts lying one after the other in ``data``.

    Every window of ``length`` bytes is anchored at the smallest gram hash in it, the leftmost among
    equals. Returns the text's number, the hash, and the first and last window start in ``data``.
    """
    width = length - GRAM + 1
    text_ends = offsets[1:]
    found = []
    for low in range(int(offsets[0]), int(offsets[-1]) - length + 1, _CHUNK):
        high = min(low + _CHUNK, int(offsets[-1]) - length + 1)
        grams = gram_hashes(data, low, high - 1 + length)
        # The hash decides, then the place: both in one number.
        key = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < width:
            key = np.minimum(key[:high - low], key[width - reach:width - reach + high - low])
        place = (key & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)[:high - low]
        at = np.arange(low, high)
        text = np.searchsorted(text_ends, at, side="right")
        inside = at + length <= text_ends[text]
        at, text, place = at[inside], text[inside], place[inside]
        if not len(at):
            continue
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        found.append((text[first], grams[place[first]], at[first], at[last]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bytes_of(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The buffer in which the texts lie one after the other, and where they begin and end."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return memoryview(column.buffers()[2] or b""), offsets.astype(np.int64)


def _in_bytes(hashes: np.ndarray) -> list[bytes]:
    data = hashes.astype("<u8").tobytes()
    return [data[i:i + 8] for i in range(0, len(data), 8)]


def _anchor_rows(length: int):
    """One row per run: the text's digest, the anchor's hash and one of the run's bytes in one key, where it lies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, offsets = _bytes_of(batch.column("text"))
            text, hashes, first, last = anchors(data, offsets, length)
            segment = [
                anchor + xxhash.xxh3_64_digest(data[a:b + length])
                for anchor, a, b in zip(_in_bytes(hashes), first.tolist(), last.tolist(), strict=True)
            ]
            start = first - offsets[text]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest").take(pa.array(text)), pa.array(segment, pa.binary()), pa.array(start),
                 pa.array((last - first + length).astype(np.int32))],
                names=["digest", "segment", "start", "size"],
            )
    return run


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments wanted of each text."""
    for batch in sliced(batches):
        rows: list[list] = [[], [], [], []]
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            data = text.encode()
            for w in wanted:
                blob = data[w["start"]:w["start"] + w["size"]]
                anchor = int.from_bytes(w["segment"][:8], "little", signed=True)
                for column, x in zip(rows, (anchor, w["segment"], w["weight"], blob), strict=True):
                    column.append(x)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["group", "segment", "weight", "blob"]
        )


def _split_segments(length: int, step: int):
    """The windows of each segment, ``step`` neighbours together, grouped by the bytes that they share.

    Windows are counted from the anchor, so equal windows of different segments fall together.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for anchor, group, segment, weight, blob in zip(
                *(batch.column(c).to_pylist() for c in ("anchor", "group", "segment", "weight", "blob")), strict=True
            ):
                grams = gram_hashes(blob, 0, len(blob))
                place = int(np.flatnonzero(grams.view(np.int64) == anchor)[0])
                windows = len(blob) - length + 1
                by_class: dict[int, list[int]] = {}
                for w in range(windows):
                    by_class.setdefault((place - w) // step, []).append(w)
                for number, own in by_class.items():
                    piece = blob[own[0]:own[-1] + length]
                    # What all windows of this class have in common, whichever of them are here.
                    core = blob[place - number * step:place - number * step - step + 1 + length]
                    key = xxhash.xxh3_64_intdigest(core + number.to_bytes(4), seed=step) - (1 << 63)
                    values = (anchor, key, xxhash.xxh3_128_digest(piece + number.to_bytes(4)), weight, piece, segment, own[0])
                    for column, x in zip(rows, values, strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
            names = ["anchor", "group", "segment", "weight", "blob", "parent", "at"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)
    return run


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of neighbouring numbers."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.append(0, breaks + 1)].tolist(), starts[np.append(breaks, len(starts) - 1)].tolist(), strict=True))


def _sides(blobs: pa.Array, anchor: np.ndarray, length: int) -> Iterator[tuple[int | None, int | None]]:
    """For each segment a hash of the bytes before its anchor and one of those behind it, None where they are too few.

    A window reaches half of its other bytes to one side of its anchor at least, so equal windows of two segments
    have equal bytes that far on that side.
    """
    data, offsets = _bytes_of(blobs)
    half = (length - GRAM) // 2
    grams = gram_hashes(data, int(offsets[0]), int(offsets[-1])).view(np.int64)
    same = np.flatnonzero(grams == np.repeat(anchor, np.diff(offsets))[:len(grams)]) + offsets[0]
    places = same[np.searchsorted(same, offsets[:-1])]
    for low, place, high in zip(offsets[:-1].tolist(), places.tolist(), offsets[1:].tolist(), strict=True):
        behind = place + GRAM
        yield (
            xxhash.xxh3_64_intdigest(data[place - half:behind]) if place - half >= low else None,
            xxhash.xxh3_64_intdigest(data[place:behind + half], seed=1) if behind + half <= high else None,
        )


def paired(group: list[tuple]) -> list[tuple]:
    """The segments of a group that have the same bytes as another one before the anchor or behind it; they end in both hashes."""
    seen = Counter(side for row in group for side in row[-2:] if side is not None)
    return [row for row in group if seen[row[-2]] > 1 or seen[row[-1]] > 1]


def _index_groups(length: int, most: int = GROUP_SEGMENTS):
    """Index whole groups, several in a block, and return the repeated window starts of each segment.

    Groups of more than ``most`` segments are left to the caller. A segment that shares its anchor only, and not the bytes
    beside it on either side, has no window in common with another and is left out of the index.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def indexed(block: list[tuple]) -> pa.RecordBatch:
            starts = repeated_starts([b[3] for b in block], [b[2] for b in block], length)
            hits = [(b[1], a, z) for b, s in zip(block, starts, strict=True) for a, z in runs_of(s)]
            columns = list(zip(*hits, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
                names=["segment", "first", "last"],
            )

        block: list[tuple] = []
        group: list[tuple] = []
        size = 0
        for batch in sliced(batches, "blob", 1 << 20):
            sides = zip(*_sides(batch.column("blob"), batch.column("anchor").to_numpy(), length), strict=True)
            columns = [batch.column(c).to_pylist() for c in ("group", "segment", "weight", "blob")]
            for row in zip(*columns, *sides, strict=True):
                if group and group[-1][:2] == row[:2]:
                    continue  # cut twice, from rows that repeat
                if group and group[-1][0] != row[0]:
                    own = paired(group) if len(group) <= most else []
                    block += own
                    group, size = [], size + sum(len(b[3]) for b in own)
                    if size >= _BLOCK_BYTES:
                        yield indexed(block)
                        block, size = [], 0
                if len(group) <= most:
                    group.append(row)
        block += paired(group) if len(group) <= most else []
        if block:
            yield indexed(block)
    return run


def _repeats(work: Scratch, segments: DataFrame, length: int, steps: tuple[int, ...]) -> DataFrame:
    """(segment, first, last) for the repeated window starts in ``segments``, which has columns ``anchor``,
    ``group``, ``segment``, ``weight`` and ``blob`` and is a stored table.

    Groups that are too large for one index are split by ``steps``, the last of which is 1 and leaves
    single windows, that need a count only.
    """
    # The index needs whole groups, so the stored table itself is dealt out. Behind a join on the same key the plan leaves a
    # repartition out, and adaptive execution may then read the join by mapper, which deals a group to several tasks.
    found = work.stored(
        segments.select("anchor", "group", "segment", "weight", "blob").repartition("group").sortWithinPartitions(
            "group", "segment"
        ).mapInArrow(_index_groups(length, GROUP_SEGMENTS), "segment binary, first int, last int"), "repeats",
    )
    many = segments.groupBy("group").agg(F.countDistinct("segment").alias("n")).where(F.col("n") > GROUP_SEGMENTS)
    large = work.stored(segments.join(many, "group", "left_semi").select(
        "anchor", "group", "segment", "weight", "blob"), "large")
    if large.isEmpty():
        return found
    schema = schema_of(large, ["anchor", "group", "segment", "weight", "blob"], "parent binary, at int")
    pieces = work.stored(large.mapInArrow(_split_segments(length, steps[0]), schema), "pieces")
    alike = pieces.groupBy("group", "segment").agg(
        F.any_value("anchor").alias("anchor"), F.sum("weight").alias("weight"), F.any_value("blob").alias("blob")
    )
    alike = work.stored(alike, "alike")
    whole = alike.where("weight > 1").select(
        "segment", F.lit(0).alias("first"), (F.octet_length("blob") - length).cast("int").alias("last")
    )
    if steps[0] > 1:
        whole = whole.unionByName(_repeats(work, alike, length, steps[1:]))
    back = pieces.select("segment", "parent", "at").join(whole, "segment")
    return found.unionByName(back.select(
        F.col("parent").alias("segment"), (F.col("first") + F.col("at")).alias("first"),
        (F.col("last") + F.col("at")).alias("last"),
    ))


def whole_words(data: bytes, start: int, end: int) -> int:
    """Words that lie in a span of a text with both of their ends."""
    n = len(data[start:end].split())
    cut_before = start > 0 and not data[start - 1:start].isspace() and not data[start:start + 1].isspace()
    cut_behind = end < len(data) and not data[end:end + 1].isspace() and not data[end - 1:end].isspace()
    return n - max(cut_before, cut_behind) if n == 1 else n - cut_before - cut_behind


def _remove(length: int, min_words: int):
    """Spans removed, and what is left, of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spans, kept, hashes, sizes = [], [], [], []
            for text, hits, copies in zip(
                *(batch.column(c).to_pylist() for c in ("text", "hits", "copies")), strict=True
            ):
                data = (text or "").encode()
                if copies and len(data) >= length:
                    own = [(0, len(data))]
                else:
                    own = []
                    for h in sorted(hits or (), key=lambda h: h["first"]):
                        if own and h["first"] <= own[-1][1]:
                            own[-1] = (own[-1][0], max(own[-1][1], h["last"] + length))
                        else:
                            own.append((h["first"], h["last"] + length))
                if min_words:
                    own = [s for s in own if whole_words(data, *s) >= min_words]
                rest, at = [], 0
                for a, b in own:
                    rest.append(data[at:a])
                    at = b
                left = b"".join([*rest, data[at:]])
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(text if not own else left.decode("utf-8", "ignore"))
                hashes.append(sha256(left).hexdigest())
                sizes.append(len(data))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(spans, span),
                 pa.array(hashes, pa.string())], names=["row", "kept", "n_bytes", "spans", "kept_sha256"],
            )
    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _repeated(work: Scratch, plain: DataFrame, texts: DataFrame, every: DataFrame, length: int) -> DataFrame:
    """The repeated window starts of each segment, as (first, last) pairs, from the segments of all texts."""
    counted = every.groupBy("segment").agg(
        F.min(F.struct("digest", "start")).alias("low"), F.max("size").alias("size"),
        F.least(F.count("*"), F.lit(2)).cast("long").alias("weight"),
    )
    counted = work.stored(counted, "segments")
    anchor = F.substring("segment", 1, 8).alias("anchor")
    # Where every segment of an anchor occurs twice, all of their windows do.
    varied = counted.groupBy(anchor).agg(F.count("*").alias("n"), F.min("weight").alias("least"))
    varied = varied.where("n > 1 and least = 1").select("anchor")
    place = F.struct("segment", F.col("low.start").alias("start"), "size", "weight")
    wanted = counted.withColumn("anchor", anchor).join(varied, "anchor").groupBy(F.col("low.digest").alias("digest")).agg(F.collect_list(place).alias("wanted"))
    wanted = wanted.join(texts, "digest").select("doc_id", "digest", "wanted")
    source = plain.join(
        wanted.withColumnsRenamed({"doc_id": "source_id", "digest": "source"}),
        F.col("doc_id").eqNullSafe(F.col("source_id")) & (F.col("digest") == F.col("source")),
    ).select("text", "wanted")
    segments = source.mapInArrow(_cut_segments, "group bigint, segment binary, weight bigint, blob binary")
    segments = work.stored(segments.withColumn("anchor", F.col("group")), "blobs")
    steps = (193, 24, 1) if length > 193 else (1,)
    parts = _repeats(work, segments, length, steps)
    whole = counted.where("weight > 1").select(
        "segment", F.lit(0).alias("first"), (F.col("size") - length).cast("int").alias("last")
    )
    return whole.unionByName(parts).groupBy("segment").agg(F.collect_set(F.struct("first", "last")).alias("parts"))


def _marked(work: Scratch, plain: DataFrame, length: int) -> DataFrame:
    """For the digest of each text that loses bytes, whether it has copies, and its repeated window starts."""
    # One row of each text stands for its copies; ids may repeat, so both tell it.
    texts = work.stored(plain.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "texts")
    schema = schema_of(plain, ["digest"], "segment binary, start bigint, size int")
    every = work.stored(plain.select("digest", "text").mapInArrow(_anchor_rows(length), schema), "anchors")
    with Scratch(plain.sparkSession) as own:
        repeats = work.stored(_repeated(own, plain, texts, every, length), "repeated")
    hits = every.join(repeats, "segment").select("digest", "start", F.explode("parts").alias("part")).select(
        "digest", F.struct((F.col("start") + F.col("part.first")).alias("first"),
                           (F.col("start") + F.col("part.last")).alias("last")).alias("hit"),
    ).groupBy("digest").agg(F.collect_set("hit").alias("hits"))
    return texts.join(hits, "digest", "left").where("copies > 1 or hits is not null").select(
        F.col("digest").alias("marked"), (F.col("copies") > 1).alias("copies"),
        F.when(F.col("copies") == 1, F.col("hits")).alias("hits"),
    )


def remove_repeats(
    docs: DataFrame, *, min_bytes: int = 400, min_words: int = 0, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents without the bytes covered by strings of ``min_bytes`` bytes that also start elsewhere
    in the corpus, in the same document or another; overlaps count, and no string crosses documents. With
    ``min_words`` a run of such bytes that holds fewer whole words stays.

    Returns the columns of ``docs`` with the text replaced, and ``n_bytes``, ``spans`` (array of (start,
    end) in bytes, maximal removed runs) and ``kept_sha256`` (of the remaining bytes), which replace
    columns of these names. Where a cut splits a character, the text loses the rest of it as well;
    ``kept_sha256`` is of the bytes proper. A null text has no bytes and stays null. Rows that repeat
    are documents like any other, so a text of ``min_bytes`` or more in two rows goes from both. An
    empty table gives no rows.

    Every window of ``min_bytes`` bytes is anchored at the smallest hash of its 16-byte grams, so equal
    windows have equal anchors, and windows are shuffled as segments: the bytes under neighbouring
    windows of one anchor. Only digests of the segments are shuffled at first; equal segments are
    combined, and where the anchor is in no other segment, or all of its segments occur twice, that
    settles them. The bytes of one copy of each other segment go to the group of their anchor. There a segment meets
    another if both have the same bytes over half a window on one side of the anchor, as two that share a window do;
    an index of such segments by the Burrows-Wheeler transform finds the strings that occur twice: backward
    extension stops at ``min_bytes``, and a stretch of suffixes without a boundary shares that many bytes. Groups above
    ``GROUP_SEGMENTS`` different segments are split by the bytes beside the anchor, down to single
    windows if need be, so that no index grows with the corpus and nothing is left out.
    """
    added = ("n_bytes", "spans", "kept_sha256")
    rest = [c for c in docs.columns if c.lower() not in added and c != text]
    row = F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(True))
    keyed = docs.select(
        F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), _digest(F.col(f"`{text}`")).alias("digest"),
        row.alias("row"),
    )
    with Scratch(docs.sparkSession) as work:
        marked = stored(_marked(work, keyed.select("doc_id", "text", "digest"), min_bytes), "marked")
    joined = keyed.join(marked, keyed["digest"] == marked["marked"], "left")
    schema = schema_of(
        keyed, ["row"], "kept string, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string"
    )
    done = joined.select("row", "text", "hits", "copies").mapInArrow(_remove(min_bytes, min_words), schema)
    kept = [
        F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in added
    ]
    return done.select(*kept, *added)
