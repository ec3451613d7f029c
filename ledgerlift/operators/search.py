"""Exact nearest-neighbour search over a vector column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlift.functions.vectors import check_dim, cosine_distance, l2_distance
from ledgerlift.sources.shared import work_dir

METRICS = {"l2": l2_distance, "cosine": cosine_distance}

# Largest distance table (queries x vectors) that a task holds at once.
_PAIRS_AT_ONCE = 4_000_000
_QUERY, _MATCH, _VECTOR, _DISTANCE = "_query", "_match", "_vector", "distance"


def nearest(
    vectors: DataFrame, query: Sequence[float], k: int, *, id: str, vector: str = "vector", metric: str = "l2",
    digits: int | None = None,
) -> DataFrame:
    """The ``k`` rows nearest to one query vector, with ``distance``, nearest first, ties by ``id``.

    Every task keeps its own best ``k``; only those meet. With ``digits`` distances are rounded before they are
    compared, so equal ones stay ties whatever the order in which their cells were added up.
    """
    at = F.lit(np.asarray(query, dtype="f8"))
    distance = METRICS[metric](F.col(vector), at)
    found = vectors.withColumn(_DISTANCE, distance if digits is None else F.round(distance, digits))
    return found.orderBy(F.col(_DISTANCE).asc_nulls_last(), id).limit(k)


def semantic_search(
    vectors: DataFrame, query: Sequence[float], k: int, metric: str = "l2", digits: int | None = None
) -> DataFrame:
    """Texts of the ``k`` rows of a vector table nearest to ``query``, nearest first; ``digits`` as in ``nearest``."""
    found = nearest(vectors, query, k, id="text", metric=metric, digits=digits)
    return found.where(F.col("text").isNotNull()).select("text", "table_name", _DISTANCE)


def _exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row pair. Row by row, so equal pairs give equal results in every batch."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        if metric == "l2":
            gap = a - b
            found = np.sqrt((gap * gap).sum(axis=1))
            return np.where(np.isfinite(found), found, np.nan)
        norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
        return np.where(norms == 0.0, np.nan, 1.0 - (a * b).sum(axis=1) / norms)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms == 0.0, 1.0, norms)


def _trim(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    return pairs.sort_values([_QUERY, _DISTANCE, _MATCH], na_position="last").groupby(_QUERY).head(k)


def _first_of_each(q: np.ndarray, values: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """Places of the pairs whose value may be among the ``k`` least of their query ``q``."""
    order = np.lexsort((values, q))
    counts = np.bincount(q, minlength=len(slack))
    last = np.minimum(counts, k) - 1 + np.cumsum(counts) - counts
    limit = np.full(len(slack), np.inf)
    limit[counts > 0] = values[order][last[counts > 0]]
    return order[values[order] <= (limit + slack)[q[order]]]


def _batch_nearest(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, metric: str,
    limits: np.ndarray | None = None,
) -> pd.DataFrame:
    """The ``k`` nearest rows of one batch for each query, without those farther than its limit.

    Copies of a vector are equally near to everything, so of each only the ``k`` lowest ids can be
    in a result; the rest is put aside before any distance is taken. One matrix product then finds
    the rows that may be among the ``k`` nearest, rounding allowed for, and those are measured exactly.
    """
    rows = np.ascontiguousarray(rows)
    as_bytes = rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, copy_of = np.unique(as_bytes, return_inverse=True)
    order = pd.DataFrame({"copy": copy_of, _MATCH: ids}).sort_values(["copy", _MATCH]).groupby("copy").head(k)
    rows, ids = rows[order.index.to_numpy()].astype("f8"), order[_MATCH].to_numpy()

    if metric == "cosine":
        left, right = _unit(queries), _unit(rows)
    else:
        left, right = queries, rows
    left_sq, right_sq = (left * left).sum(axis=1), (right * right).sum(axis=1)
    # Vectors with cells that are no numbers have no distance and come last.
    lost = ~np.isfinite(right_sq)
    slack = 8.0 * rows.shape[1] * np.finfo("f8").eps * (left_sq + right_sq.max(initial=0.0, where=~lost) + 1.0)

    found = []
    step = max(1, _PAIRS_AT_ONCE // len(rows))
    for start in range(0, len(left), step):
        part = slice(start, start + step)
        with np.errstate(invalid="ignore"):
            near = left_sq[part, None] + right_sq[None, :] - 2.0 * (left[part] @ right.T)
        if metric == "cosine":
            near[:, right_sq == 0.0] = np.inf  # no direction, so nearest to nothing
        near[:, lost] = np.inf
        near[~np.isfinite(left_sq[part])] = np.inf
        loose = 2.0 * np.nan_to_num(slack[part], nan=0.0)
        if limits is not None and np.isfinite(limits[part]).all():
            bound = limits[part] ** 2 if metric == "l2" else 2.0 * limits[part]
            q, r = np.nonzero(near <= (bound + loose)[:, None])
            few = _first_of_each(q, near[q, r], k, loose)
            q, r = q[few], r[few]
        elif len(rows) > k:
            limit = np.partition(near, k - 1, axis=1)[:, k - 1] + loose
            q, r = np.nonzero(near <= limit[:, None])
        else:
            q, r = (i.ravel() for i in np.indices(near.shape))
        q = q + start
        size = max(1, _PAIRS_AT_ONCE // rows.shape[1])
        distances = [_exact(metric, queries[q[i:i + size]], rows[r[i:i + size]]) for i in range(0, len(q), size)]
        pairs = {_QUERY: query_ids[q], _MATCH: ids[r], _DISTANCE: np.concatenate([np.empty(0), *distances])}
        found.append(_trim(pd.DataFrame(pairs), k))
    return pd.concat(found)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


# --- bulk search ----------------------------------------------------------------------------------

MAX_PIVOTS = 1024
# Blocks and parts grow with their tables so that a row is sent to about this many, until one of
# them holds this many bytes of vectors.
_COPIES, _SIDE_BYTES = 16, 32 * 1024**2
# From this share of visited pairs on, a block is compared with a whole part at once instead of cell by cell.
_DENSE = 0.5
_CELL, _GAP, _VISITS, _PART, _BITS, _PAIRS, _LIMIT = "_cell", "_gap", "_visits", "_part", "_bits", "_pairs", "_limit"


def _side_rows(asked: int, n_rows: int, dim: int) -> int:
    """How many rows a block or part holds: ``asked`` ones, more in a table that would be sent too often."""
    return max(1, min(max(asked, -(-n_rows // _COPIES)), _SIDE_BYTES // (4 * dim)))


def _group_cells(rows: np.ndarray, per_part: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each cell's first part and number of parts, and the cells of every part.

    Small cells share a part; one of more than ``per_part`` rows has several to itself.
    """
    first, n_parts, cells = np.zeros(len(rows), np.int32), np.ones(len(rows), np.int32), []
    held = per_part
    for cell in np.flatnonzero(rows):
        n_parts[cell] = -(-rows[cell] // per_part)
        alone = rows[cell] >= per_part
        if alone or held + rows[cell] > per_part:
            first[cell] = len(cells)
            cells += [[cell] for _ in range(n_parts[cell])]
            held = per_part if alone else rows[cell]
        else:
            first[cell] = len(cells) - 1
            cells[-1].append(cell)
            held += rows[cell]
    return first, n_parts, [np.array(c) for c in cells]


def _points(metric: str, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in the space where distances obey the triangle inequality, and which have a place there."""
    m = m.astype("f8")
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (m * m).sum(axis=1)
    fine = np.isfinite(squares) & ((squares > 0) | (metric != "cosine"))
    m[~fine] = 0.0
    return (_unit(m) if metric == "cosine" else m), fine


def _gaps(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances from points to pivots, and a bound of their rounding error for each point."""
    left, right = (points * points).sum(axis=1), (pivots * pivots).sum(axis=1)
    squares = left[:, None] + right[None, :] - 2.0 * (points @ pivots.T)
    error = np.sqrt(8.0 * points.shape[1] * np.finfo("f8").eps * (left + right.max(initial=0.0)))
    return np.sqrt(np.maximum(squares, 0.0)), error


def _pick_pivots(known: DataFrame, n_rows: int, dim: int, metric: str) -> np.ndarray:
    """Some different vectors of the corpus, the same in every run: those of the smallest hashes in a sample by id."""
    wanted = min(MAX_PIVOTS, max(1, round(n_rows ** 0.5 / 2)))
    share = min(1.0, 16 * wanted / max(1, n_rows))
    sampled = known.where(F.pmod(F.xxhash64(_MATCH), F.lit(1 << 20)) < max(1, round(share * (1 << 20))))
    # Copies are combined before they meet.
    different = sampled.groupBy(F.xxhash64(_VECTOR).alias("h")).agg(F.any_value(_VECTOR).alias(_VECTOR))
    few = different.orderBy("h").limit(wanted).select(_VECTOR).toArrow()
    points, fine = _points(metric, _matrix(few[_VECTOR], dim))
    return points[fine] if fine.any() else np.zeros((1, dim))


def _to_cells(pivots: np.ndarray, dim: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, gap = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for low in range(0, batch.num_rows, step := max(1, _PAIRS_AT_ONCE // len(pivots))):
                part = slice(low, low + step)
                points, fine = _points(metric, _matrix(batch.column(1)[part], dim))
                gaps, error = _gaps(points, pivots)
                own = gaps.argmin(axis=1)
                cell[part] = np.where(fine, own, -1)
                gap[part] = gaps[np.arange(len(own)), own] + error
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(gap)], names=[_MATCH, _VECTOR, _CELL, _GAP]
            )
    return run


def _visit_lists(mask: np.ndarray, cells_of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The visits of some queries in their order: number per query, parts, and a bit for each cell of the part."""
    who, parts, bits = [np.empty(0, np.int64)], [np.empty(0, np.int32)], []
    for part, cells in enumerate(cells_of):
        asking = np.flatnonzero(mask[:, cells].any(axis=1))
        who.append(asking)
        parts.append(np.full(len(asking), part, np.int32))
        bits += [b.tobytes() for b in np.packbits(mask[np.ix_(asking, cells)], axis=1)]
    all_who = np.concatenate(who)
    order = np.argsort(all_who, kind="stable")
    return np.bincount(all_who, minlength=len(mask)), np.concatenate(parts)[order], [bits[i] for i in order]


def _to_visit(
    pivots: np.ndarray, radius: np.ndarray, rows: np.ndarray, cells_of: list[np.ndarray], k: int, dim: int, metric: str
):
    """The cells that a query visits, by part: first, without a limit, the nearest ones that hold ``k`` rows
    together; then, with the distance of the k-th row found there, all that may hold a row as near as that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            again = batch.num_columns == 3
            counts, parts, bits, pairs = [np.zeros(1, np.int64)], [np.empty(0, np.int32)], [], [np.empty(0, np.int64)]
            for low in range(0, batch.num_rows, step := max(1, _PAIRS_AT_ONCE // len(pivots))):
                points, fine = _points(metric, _matrix(batch.column(1)[low:low + step], dim))
                gaps, error = _gaps(points, pivots)
                if again:
                    limit = batch.column(2)[low:low + step].to_numpy(zero_copy_only=False).astype("f8")
                    limit = np.where(np.isnan(limit), np.inf, np.sqrt(2.0 * np.maximum(limit, 0.0)) if metric == "cosine" else limit)
                    # The root of a tiny cosine distance carries the rounding error of 1.
                    limit = limit * (1 + 1e-9) + (1e-7 if metric == "cosine" else 0.0)
                    mask = gaps - radius[None, :] - error[:, None] <= limit[:, None]
                else:
                    gaps[:, rows == 0] = np.inf
                    near = np.argsort(gaps, axis=1, kind="stable")
                    held = np.cumsum(rows[near], axis=1)
                    # As many of the nearest cells as it takes to have k rows.
                    mask = np.empty(gaps.shape, bool)
                    np.put_along_axis(mask, near, held - rows[near] < k, axis=1)
                mask &= (rows > 0)[None, :] & fine[:, None]
                n, p, b = _visit_lists(mask, cells_of)
                counts.append(n)
                parts.append(p)
                bits += b
                pairs.append(mask @ rows)
            visits = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(parts)), pa.array(bits, pa.binary())], names=[_PART, _BITS])
            offsets = pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32))
            limits = batch.column(2) if again else pa.nulls(batch.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), limits, pa.ListArray.from_arrays(offsets, visits), pa.array(np.concatenate(pairs))],
                names=[_QUERY, _VECTOR, _LIMIT, _VISITS, _PAIRS],
            )
    return run


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    query_id: str,
    id: str,
    query_vector: str = "vector",
    vector: str = "vector",
    dim: int,
    metric: str = "l2",
    queries_per_block: int = 4096,
    rows_per_part: int = 20_000,
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """For every query row the ``k`` nearest corpus rows: ``query_id``, ``id``, ``distance``, ``rank``.

    Exact, without comparing all pairs where the data has any structure. The corpus is dealt into cells around
    pivots, vectors of its own (half the root of its rows, ``MAX_PIVOTS`` at most), each with a radius. A
    query first visits the nearest cells that hold ``k`` rows together. The k-th distance found there closes
    every cell whose pivot is farther than that distance and the radius together, by the triangle
    inequality; the others are visited in a second round. Cosine distances are pruned as lengths between unit vectors.

    Cells are gathered into parts of about ``rows_per_part`` rows, which meet blocks of about ``queries_per_block``
    queries by key, so a cell or a query that fills a third of a table is spread. A vector is sent once to a part or
    block, however many cells meet there. In large tables parts and blocks grow, so that a vector is sent to about 16 of them
    in a round, until they hold 32 MB of vectors; from there on (2 million vectors of 64 cells) the shuffle
    grows with the pairs of parts. The driver holds the pivots and a count and radius for each. ``counts`` receives the
    number of pairs to be ``compared``, in both rounds, and of ``all`` pairs.

    Ids must differ between the two tables by column name. Vectors whose length is not ``dim`` are an error.
    Null and non-finite cells are allowed: such rows (for cosine also zero vectors) have no distance and rank
    last, by id, for every query, and such a query has the ``k`` lowest ids without a distance.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    spark = corpus.sparkSession
    asked = queries.select(F.col(query_id).alias(_QUERY), check_dim(F.col(query_vector), dim).alias(_VECTOR))
    known = corpus.select(F.col(id).alias(_MATCH), check_dim(F.col(vector), dim).alias(_VECTOR))
    query_type, match_type = asked.schema[_QUERY].dataType, known.schema[_MATCH].dataType

    def kept(df: DataFrame) -> DataFrame:
        path = work_dir(spark, "knn")
        df.write.parquet(path)
        return spark.read.parquet(path)

    pivots = _pick_pivots(known, known.count(), dim, metric)
    schema = T.StructType([*known.schema.fields, T.StructField(_CELL, T.IntegerType()), T.StructField(_GAP, T.DoubleType())])
    cells = kept(known.mapInArrow(_to_cells(pivots, dim, metric), schema))
    rows, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in cells.where(F.col(_CELL) >= 0).groupBy(_CELL).agg(F.count("*").alias("n"), F.max(_GAP).alias("gap")).collect():
        rows[r[_CELL]], radius[r[_CELL]] = r["n"], r["gap"]
    first_part, n_parts, cells_of = _group_cells(rows, _side_rows(rows_per_part, int(rows.sum()), dim))
    visit = _to_visit(pivots, radius, rows, cells_of, k, dim, metric)
    limit_field, pairs_field = T.StructField(_LIMIT, T.DoubleType()), T.StructField(_PAIRS, T.LongType())
    visit_type = T.StructType([T.StructField(_PART, T.IntegerType()), T.StructField(_BITS, T.BinaryType())])
    visits_schema = T.StructType([
        *asked.schema.fields, limit_field, T.StructField(_VISITS, T.ArrayType(visit_type)), pairs_field])
    pair_schema = T.StructType([
        T.StructField(_QUERY, query_type), T.StructField(_MATCH, match_type), T.StructField(_DISTANCE, T.DoubleType()),
    ])

    def meet(ask: pa.Table, have: pa.Table) -> pa.Table:
        """A block of queries and a part: all at once, or where few of its cells are visited cell by cell."""
        if not ask.num_rows or not have.num_rows:
            return pa.table({_QUERY: ask[_QUERY][:0], _MATCH: have[_MATCH][:0], _DISTANCE: pa.array([], pa.float64())})
        own = cells_of[ask[_PART][0].as_py()]
        packed = np.frombuffer(b"".join(ask[_BITS].to_pylist()), np.uint8).reshape(ask.num_rows, -1)
        bits = np.unpackbits(packed, axis=1, count=len(own)).astype(bool)
        cell = have[_CELL].to_numpy()
        held = np.array([(cell == c).sum() for c in own])
        if (bits @ held).sum() >= _DENSE * ask.num_rows * have.num_rows:
            meetings = [(np.arange(ask.num_rows), np.arange(have.num_rows))]
        else:
            meetings = [(np.flatnonzero(bits[:, i]), np.flatnonzero(cell == c)) for i, c in enumerate(own)]
        queries, vectors = _matrix(ask[_VECTOR], dim), _matrix(have[_VECTOR], dim)
        limits = ask[_LIMIT].to_numpy()
        # Rows of one query stay apart by their number; ids come back at the end.
        found = pd.concat([
            _batch_nearest(q, queries[q].astype("f8"), r, vectors[r], k, metric, limits[q])
            for q, r in meetings if len(q) and len(r)
        ])
        if len(meetings) > 1:
            found = _trim(found, k)
        return pa.table({
            _QUERY: ask[_QUERY].take(pa.array(found[_QUERY].to_numpy())),
            _MATCH: have[_MATCH].take(pa.array(found[_MATCH].to_numpy())),
            _DISTANCE: pa.array(found[_DISTANCE].to_numpy(), from_pandas=True),
        })

    places = spark.createDataFrame(
        [(int(c), int(first_part[c]), int(n_parts[c])) for c in np.flatnonzero(rows)],
        f"{_CELL} int, _first int, _parts int",
    )
    # The vector is part of the hash: rows that share one id spread over parts.
    placed = cells.join(F.broadcast(places), _CELL).select(
        _MATCH, _VECTOR, _CELL,
        (F.col("_first") + F.pmod(F.xxhash64(_MATCH, _VECTOR), "_parts").cast("int")).alias(_PART))

    def compare(visits: DataFrame) -> DataFrame:
        """The best of each part visited."""
        per_block = _side_rows(queries_per_block, visits.count(), dim)
        each = visits.select(_QUERY, _VECTOR, _LIMIT, F.inline(_VISITS))
        asking = each.groupBy(_PART).agg(F.count("*").alias("n")).collect()
        deal = F.broadcast(spark.createDataFrame(
            [(r[_PART], -(-r["n"] // per_block)) for r in asking], f"{_PART} int, _blocks int"))
        left = each.join(deal, _PART).withColumn("_block", F.pmod(F.xxhash64(_QUERY, _VECTOR), "_blocks").cast("int"))
        right = placed.join(deal, _PART).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        keys = (_PART, "_block")
        return left.drop("_blocks").groupBy(*keys).cogroup(right.drop("_blocks").groupBy(*keys)).applyInArrow(
            lambda a, b: meet(a, b.sort_by(_MATCH)), pair_schema)

    place = Window.partitionBy(_QUERY).orderBy(F.col(_DISTANCE).asc_nulls_last(), _MATCH)
    first = kept(asked.mapInArrow(visit, visits_schema))
    limits = compare(first).withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select(
        F.col(_QUERY).alias("_limited"), F.col(_DISTANCE).alias("_found"))
    limited = first.join(limits, F.col(_QUERY).eqNullSafe(F.col("_limited")), "left").select(
        _QUERY, _VECTOR, F.col("_found").alias(_LIMIT))
    # The second round visits the cells of the first again, where its limit lets it: its result is whole.
    second = kept(limited.mapInArrow(visit, visits_schema))
    found = compare(second)

    # What has no distance follows in the order of ids: k of them at most.
    lost = cells.where(F.col(_CELL) < 0)
    behind = [r[_MATCH] for r in lost.select(_MATCH).orderBy(_MATCH).limit(k).collect()] if rows.sum() < k else []
    lowest = [r[_MATCH] for r in cells.select(_MATCH).orderBy(_MATCH).limit(k).collect()]
    no_place = F.size(_VISITS) == 0
    for ids, who in ((behind, ~no_place), (lowest, no_place)):
        if ids:
            listed = F.array(*(F.lit(i) for i in ids)).cast(T.ArrayType(match_type))
            found = found.unionByName(first.where(who).select(
                _QUERY, F.explode(listed).alias(_MATCH), F.lit(None).cast("double").alias(_DISTANCE)))
    if counts is not None:
        counts["compared"] = sum(v.agg(F.coalesce(F.sum(_PAIRS), F.lit(0))).first()[0] for v in (first, second))
        counts["all"] = first.count() * int(rows.sum())
    return (
        found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        .select(F.col(_QUERY).alias(query_id), F.col(_MATCH).alias(id), _DISTANCE, "rank")
    )
