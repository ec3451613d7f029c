"""Documents into bins of fixed capacity by conflict-constrained best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COPIES = 4096  # of one row, numbered at once


def pack(items: list[tuple[int, str | None, str | None]], capacity: int) -> list[tuple[int, int]]:
    """For every item (length, source, cluster) its bin and its offset there.

    Items come in the order of placement and are no longer than ``capacity``. Open bins are kept in
    order of residual, each with a bitmap of its sources and one of its duplicate clusters. From the
    smallest residual that fits, the search goes on to the next larger until a bin has neither the
    item's source nor its cluster; without one a new bin is opened. Nulls conflict with nothing, and
    neither does a source or cluster that only one item has.
    """
    bits = []
    for place in (1, 2):
        often = [x for x, n in Counter(item[place] for item in items).items() if n > 1 and x is not None]
        bits.append({x: 1 << i for i, x in enumerate(often)})
    order: list[tuple[int, int]] = []  # (residual, bin)
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for length, source, cluster in items:
        s, c = bits[0].get(source, 0), bits[1].get(cluster, 0)
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, bin = order.pop(at)
        else:
            residual, bin = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        placed.append((bin, capacity - residual))
        sources[bin] |= s
        clusters[bin] |= c
        if residual > length:
            insort(order, (residual - length, bin))
    return placed


def _pack_partition(capacity: int):
    def flush(rows: list[dict]) -> list[tuple]:
        rows.sort(key=lambda r: (-(r["length"] % capacity or capacity), r["order_key"], r["row_id"] or ""))
        rests = [r for r in rows if r["length"] % capacity]
        placed = pack([(r["length"] % capacity, r["source"], r["cluster"]) for r in rests], capacity)
        out, base = [], rows[0]["part"] << 40
        bins = max((b for b, _ in placed), default=-1) + 1
        for r, (bin, offset) in zip(rests, placed, strict=True):
            full = r["length"] // capacity
            out.append((r["row_id"], base + bin, full, full * capacity, r["length"] % capacity, offset))
        for r in rows:
            for piece in range(r["length"] // capacity):
                out.append((r["row_id"], base + bins, piece, piece * capacity, capacity, 0))
                bins += 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[dict]) -> pa.RecordBatch:
            columns = list(zip(*flush(rows), strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["row_id", "bin_id", "piece", "start", "length", "bin_offset"],
            )

        group: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if group and group[0]["part"] != r["part"]:
                    yield emit(group)
                    group = []
                group.append(r)
        if group:
            yield emit(group)
    return run


def pack_documents(
    docs: DataFrame, *, length: Column, source: Column, cluster: Column, capacity: int = 8192,
    per_group: int = 4096, id: str = "doc_id",
) -> DataFrame:
    """Pack documents of ``length`` into bins of ``capacity``.

    Returns one row per piece: ``doc_id``, ``bin_id`` (long), ``piece`` (int, from 0), ``start`` and
    ``length`` of the piece in its document, ``bin_offset`` of it in the bin. A document above the
    capacity fills bins of its own; what is left over is packed. Rests are placed longest first by
    ``pack``: no bin holds two of one source or one duplicate cluster.

    Documents are dealt by a hash of id, length, source and cluster over groups of about ``per_group``
    rows, each packed by one task, so any source or cluster spreads evenly and a bin's content depends on
    its group alone. The number of groups follows the input (one count). A group holds ids and
    lengths only. Ids may be null or repeat. Rows that agree in all four values are counted, and the
    copies numbered, so that they are dealt over all groups as well, however many they are.

    Null lengths count as 0; a document of length 0 has one row with no bin, piece 0 and length 0. An
    empty table gives no rows. Other columns are ignored.
    """
    amount = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))
    kind = docs.schema[id].dataType
    items = docs.select(
        F.col(f"`{id}`").cast("string").alias("row_id"), amount.alias("length"), source.cast("string").alias("source"),
        cluster.cast("string").alias("cluster"),
    )
    key = F.xxhash64("row_id", "length", "source", "cluster")
    solid = items.where("length > 0")
    groups = max(1, -(-solid.count() // per_group))
    alike = solid.groupBy("row_id", "length", "source", "cluster").agg(F.count("*").alias("n"))
    # Copies are numbered in runs, and the runs are spread, so that no task makes all copies of a row.
    runs = alike.select("*", key.alias("order_key"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _COPIES))).alias("run")
    ).repartition("order_key", "run")
    low = F.col("run") * _COPIES
    copies = runs.select("*", F.explode(F.sequence(low, F.least(low + _COPIES, "n") - 1)).alias("copy"))
    dealt = copies.select(
        "row_id", "length", "source", "cluster", "order_key",
        F.pmod(F.xxhash64("order_key", "copy"), F.lit(groups)).alias("part"),
    ).repartition("part").sortWithinPartitions("part")
    schema = T.StructType.fromDDL(
        "row_id string, bin_id bigint, piece int, start bigint, length bigint, bin_offset bigint"
    )
    packed = dealt.mapInArrow(_pack_partition(capacity), schema)
    none = F.lit(None).cast("long")
    empty = items.where("length = 0").select(
        "row_id", none.alias("bin_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "length",
        none.alias("bin_offset"),
    )
    return packed.unionByName(empty).select(
        F.col("row_id").cast(kind).alias("doc_id"), "bin_id", "piece", "start", "length", "bin_offset"
    )
