"""Near-duplicate vectors by an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import min_labels, schema_of, shuffle_partitions, stored

AXES = 8  # leading principal dimensions that order and bound
LEAF = 256
_PARTNERS = 16  # blocks that meet one block in one group


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each vector and the vector at length 1, both null where it can have no cosine."""
    for batch in batches:
        column = batch.column("vector")
        values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        digests, units, at = [], [], 0
        for n in lengths.tolist():
            v = values[at:at + n] + 0.0  # -0.0 becomes 0.0
            at += n
            largest = np.abs(v).max(initial=0.0)
            if not (np.isfinite(largest) and largest > 0):
                digests.append(None)
                units.append(None)
                continue
            scaled = v / largest
            units.append((scaled / math.sqrt(scaled @ scaled)).tobytes())
            digests.append(blake2b(v.tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(units, pa.binary()),
             pa.array(lengths.astype(np.int32))], names=["vec_id", "digest", "unit", "dim"],
        )


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length of the vectors, which rows, their matrix."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        units = batch.column("unit").take(pa.array(rows)).to_pylist()
        yield int(dim), rows, np.frombuffer(b"".join(units), np.float64).reshape(len(rows), int(dim))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vectors: the number, the sums and the sums of products, in one row of numbers."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, _, m in _by_dim(batch):
            own = np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()])
            sums[dim] = sums[dim] + own if dim in sums else own
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))],
        names=["dim", "sums"],
    )


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the leading principal dimensions, as columns."""
    cells = classes.select("unit", "dim").mapInArrow(_moments, "dim int, sums array<double>").select(
        "dim", F.posexplode("sums").alias("place", "value")
    ).groupBy("dim", "place").agg(F.sum("value").alias("value"))
    # As many numbers as a matrix of dimensions by dimensions has, whatever the number of vectors.
    gathered: dict[int, dict[int, float]] = {}
    for dim, place, value in cells.collect():
        gathered.setdefault(dim, {})[place] = value
    axes = {}
    for dim, own in gathered.items():
        flat = np.array([own[i] for i in range(1 + dim + dim * dim)])
        mean = flat[1:1 + dim] / flat[0]
        spread = flat[1 + dim:].reshape(dim, dim) / flat[0] - np.outer(mean, mean)
        axes[dim] = np.linalg.eigh(spread)[1][:, ::-1][:, :AXES]
    return axes


def _coordinates(axes: dict[int, np.ndarray], epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.zeros((batch.num_rows, AXES))
            for dim, rows, m in _by_dim(batch):
                own = m @ axes[dim]
                where[rows, :own.shape[1]] = own
            cells = np.floor(where / epsilon).astype(np.int32)
            lists = [pa.array(list(x), pa.list_(t)) for x, t in ((where, pa.float64()), (cells, pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("digest", "size", "unit", "dim")), *lists],
                names=["digest", "size", "unit", "dim", "at", "cells"],
            )
    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows numbered within their partition."""
    n = 0
    for batch in batches:
        place = pa.array(np.arange(n, n + batch.num_rows))
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, place], names=[*batch.schema.names, "place"])


def _linked(close: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges that connect rows and columns as all marked cells do; columns are numbered after the rows."""
    n, m = close.shape
    rows, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    part = close[np.ix_(rows, columns)]
    row_name, column_name = rows, columns + (0 if same else n)
    top = np.arange(n + (0 if same else m))
    while True:
        before = top.copy()
        low = np.where(part, top[column_name][None, :], len(top)).min(axis=1)
        top[row_name] = np.minimum(top[row_name], low)
        low = np.where(part, top[row_name][:, None], len(top)).min(axis=0)
        np.minimum.at(top, column_name, low)
        if np.array_equal(top, before):
            return [(i, int(top[i])) for i in np.flatnonzero(top != np.arange(len(top))).tolist()]


def join_intervals(a: tuple, b: tuple, same: bool, minimum: float, epsilon: float, found) -> None:
    """Join two intervals (first, last, coordinates, vectors) of the grid order.

    Intervals whose boxes are further apart than ``epsilon`` are skipped as a whole; others are halved
    until both are leaves, which are compared in one matrix product. ``found`` gets the offsets of the
    leaves and the matrix of linked pairs.
    """
    (a_at, ac, av), (b_at, bc, bv) = a, b
    gap = np.maximum(0, np.maximum(ac.min(axis=0) - bc.max(axis=0), bc.min(axis=0) - ac.max(axis=0)))
    if gap @ gap > epsilon * epsilon + 1e-9:
        return
    if len(av) <= LEAF and len(bv) <= LEAF:
        close = av @ bv.T >= minimum
        if same:
            close = np.triu(close, 1)
        if close.any():
            found(a_at, b_at, close)
        return

    def halves(x: tuple) -> list[tuple]:
        if len(x[2]) <= LEAF:
            return [x]
        half = len(x[2]) // 2
        return [(x[0], x[1][:half], x[2][:half]), (x[0] + half, x[1][half:], x[2][half:])]

    for i, left in enumerate(halves(a)):
        for j, right in enumerate(halves(b)):
            if not same or i <= j:
                join_intervals(left, right, same and i == j, minimum, epsilon, found)


def _compare(minimum: float, epsilon: float):
    def loaded(rows: list[tuple]) -> tuple:
        """Digests, class sizes, coordinates and vectors of one block."""
        return (
            [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[3] for r in rows]),
            np.frombuffer(b"".join(r[2] for r in rows), np.float64).reshape(len(rows), -1),
        )

    def compared(home: tuple, other: tuple, same: bool) -> list[tuple]:
        degrees = (np.zeros(len(home[0]), np.int64), np.zeros(len(other[0]), np.int64))
        out = []

        def found(a_at: int, b_at: int, close: np.ndarray) -> None:
            n, m = close.shape
            degrees[0][a_at:a_at + n] += close @ other[1][b_at:b_at + m]
            degrees[1][b_at:b_at + m] += home[1][a_at:a_at + n] @ close
            one_leaf = same and a_at == b_at
            names = home[0][a_at:a_at + n] + ([] if one_leaf else other[0][b_at:b_at + m])
            out.extend((names[x], names[y], 0) for x, y in _linked(close, one_leaf))

        join_intervals((0, home[2], home[3]), (0, other[2], other[3]), same, minimum, epsilon, found)
        for block, own in ((home, degrees[0]), (other, degrees[1])):
            out.extend((block[0][i], None, int(own[i])) for i in np.flatnonzero(own).tolist())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home_key, home, key, rows = None, None, None, []

        def done() -> pa.RecordBatch:
            nonlocal home, home_key
            own = loaded(rows)
            group, block = key[:3], key[3]
            out = []
            if group != home_key:
                home_key, home = group, own  # the group's own block comes first
            if block != group[1] or key[4]:
                out = compared(home, own, block == group[1])
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            kinds = (pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "weight"]
            )

        names = ("dim", "home", "bundle", "block", "self", "digest", "size", "unit", "at")
        for batch in batches:
            for *own, digest, size, unit, at in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if key != tuple(own):
                    if rows:
                        yield done()
                    key, rows = tuple(own), []
                rows.append((digest, size, unit, at))
        if rows:
            yield done()
    return run


def vector_links(
    vectors: DataFrame, *, minimum: float = 0.9, block: int = 4096, id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Groups of vectors with a cosine of ``minimum`` or more, in double precision.

    Returns one row per row of ``vectors``: ``vec_id``, ``n_links`` (long, other rows linked directly) and
    ``component_id`` (smallest id reachable by links, itself included). Null vectors, those that hold
    null or non-finite components, empty ones and those of length 0 link with nothing; so do vectors
    of different dimension. Rows that repeat are vectors like any other, linked with each other. An
    empty table gives no rows; other columns are ignored. ``minimum`` must be above 0.

    At length 1, the cosine bounds the distance: epsilon is sqrt(2 - 2 minimum). Equal vectors are one
    class. Classes are sorted by their cells of a grid of width epsilon over the leading principal
    dimensions (a rotation, so distances hold) by range partitioning, and numbered; every ``block``
    neighbours in that order are one interval. Intervals whose boxes may be within epsilon in the first
    dimension's cells, and are so in all of the leading ones, are paired by an equality join of cells.
    A task holds two intervals and joins them recursively, skipping distant halves. Each sends a count
    per class and the edges that connect what it linked, never all pairs, and groups are the connected
    components of the edges. Driver: one matrix of dimensions by dimensions, and one count per partition.
    """
    spark = vectors.sparkSession
    epsilon = math.sqrt(2 - 2 * minimum)
    rows = vectors.select(F.col(f"`{id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    schema = schema_of(rows, ["vec_id"], "digest binary, unit binary, dim int")
    members = stored(rows.mapInArrow(_unit_rows, schema), "units")
    classes = stored(members.where("digest is not null").groupBy("digest").agg(
        F.count("*").alias("size"), F.min("vec_id").alias("first"), F.any_value("unit").alias("unit"),
        F.any_value("dim").alias("dim"),
    ), "classes")
    axes = principal_axes(classes)
    ddl = "digest binary, size bigint, unit binary, dim int, at array<double>, cells array<int>"
    located = classes.select("digest", "size", "unit", "dim").mapInArrow(_coordinates(axes, epsilon), ddl)
    order = ["dim", "cells", "at", "digest"]
    located = stored(located, "located").repartitionByRange(shuffle_partitions(spark), *order)
    numbered = located.sortWithinPartitions(*order).mapInArrow(_numbered, f"{ddl}, place bigint")
    numbered = stored(numbered.withColumn("part", F.spark_partition_id()), "numbered")
    counts = dict(numbered.groupBy("part").count().collect())
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    offsets = F.from_json(F.lit(json.dumps(before)), "array<bigint>")
    rank = offsets[F.col("part")] + F.col("place")
    placed = numbered.withColumn("block", F.floor(rank / block))

    ends = [f(F.col("at")[j]).alias(f"{name}{j}") for j in range(AXES) for name, f in (("low", F.min), ("high", F.max))]
    boxes = stored(placed.groupBy("dim", "block").agg(*ends), "boxes")
    cell = lambda c: F.floor(F.col(c) / epsilon)
    left = boxes.select(*(F.col(c).alias(f"a_{c}") for c in boxes.columns), F.explode(
        F.sequence(cell("low0"), cell("high0"))).alias("cell"))
    right = boxes.select(*(F.col(c).alias(f"b_{c}") for c in boxes.columns), F.explode(
        F.sequence(cell("low0") - 1, cell("high0") + 1)).alias("cell"))
    gaps = [F.greatest(F.lit(0.0), F.col(f"a_low{j}") - F.col(f"b_high{j}"), F.col(f"b_low{j}") - F.col(f"a_high{j}"))
            for j in range(AXES)]
    near = sum((g * g for g in gaps), F.lit(0.0)) <= epsilon * epsilon + 1e-9
    pairs = left.join(right, (F.col("a_dim") == F.col("b_dim")) & (left["cell"] == right["cell"])).where(
        (F.col("a_block") <= F.col("b_block")) & near
    ).select(F.col("a_dim").alias("dim"), F.col("a_block").alias("home"), F.col("b_block").alias("block")).distinct()
    # Each block meets its partners in bundles; it leads every bundle itself.
    pairs = pairs.withColumn("bundle", F.floor(F.col("block") / _PARTNERS))
    leads = pairs.groupBy("dim", "home", "bundle").agg(F.max(F.col("block") == F.col("home")).alias("self"))
    leads = leads.select("dim", "home", "bundle", F.col("home").alias("block"), "self", F.lit(0).alias("turn"))
    others = pairs.where("block <> home").select(
        "dim", "home", "bundle", "block", F.lit(False).alias("self"), F.lit(1).alias("turn")
    )
    sent = placed.join(leads.unionByName(others), ["dim", "block"]).repartition("dim", "home", "bundle")
    sent = sent.sortWithinPartitions("dim", "home", "bundle", "turn", "block", "cells", "at")
    found = stored(sent.select("dim", "home", "bundle", "block", "self", "digest", "size", "unit", "at").mapInArrow(
        _compare(minimum, epsilon), "a binary, b binary, weight bigint"), "links")

    weights = found.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("weight").alias("weight"))
    labels = min_labels(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "digest")
    linked = classes.select("digest", "size", "first").join(labels, "digest", "left").join(weights, "digest", "left")
    linked = linked.where("size > 1 or label is not null").withColumn("label", F.coalesce("label", "digest"))
    groups = linked.groupBy("label").agg(F.min("first").alias("component"))
    info = stored(linked.join(groups, "label").select(
        F.col("digest").alias("class"), "component", (F.col("size") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links")
    ), "components")
    done = members.select("vec_id", "digest").join(info, members["digest"] == info["class"], "left")
    return done.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"),
    )
