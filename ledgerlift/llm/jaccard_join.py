"""Near duplicates by Jaccard similarity of word shingles: MinHash banding, then exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import Scratch, min_labels, schema_of, sliced, stored
from ledgerlift.llm.shingles import shingle_sets

_COLUMNS_AT_ONCE = 4096  # shingles per matrix product


def banding(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows) that find a pair at the threshold with probability ``recall``: of those within
    ``max_hashes``, the longest rows, which let fewest dissimilar pairs through."""
    best = None
    for rows in range(1, max_hashes + 1):
        match = threshold**rows
        bands = 1 if match >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-match))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within max_hashes reaches this recall")
    return best


def minhashes(sets: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """``n`` minima of random linear hashes for every set; sets must not be empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, n, dtype=np.uint32)
    out = np.empty((len(sets), n), np.uint32)
    at = 0
    while at < len(sets):
        # About as many shingles at once as fit in the processor's cache.
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 65536):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end]).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at:end - 1]])
        for j in range(n):
            out[at:end, j] = np.minimum.reduceat(x * a[j] + b[j], starts)
        at = end
    return out


def _signatures(width: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = shingle_sets(batch.column("text"), width)
            digests = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            filled = [i for i, s in enumerate(sets) if len(s)]
            keys: list[list[int] | None] = [None] * len(sets)
            if filled:
                hashed = minhashes([sets[i] for i in filled], bands * rows, seed).reshape(len(filled), bands, rows)
                for i, own in zip(filled, hashed, strict=True):
                    keys[i] = [
                        int.from_bytes(blake2b(r.tobytes(), digest_size=8, salt=j.to_bytes(4)).digest(), signed=True)
                        for j, r in enumerate(own)
                    ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k"), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "k", "digest", "bands"],
            )
    return run


def _sets(width: int):
    """Sets of the texts given, as bytes; a row whose text is not the one meant is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = shingle_sets(batch.column("text"), width)
            blobs = [s.tobytes() for s in sets]
            own = pa.array([
                blake2b(b, digest_size=16).digest() == d
                for b, d in zip(blobs, batch.column("digest").to_pylist(), strict=True)
            ])
            columns = [batch.column(c) for c in ("digest", "size", "shared", "needed")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(blobs, pa.binary())], names=["digest", "size", "shared", "needed", "blob"]
            ).filter(own)
    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left]).reshape(
            len(left), len(right)
        )
    sizes = np.array([len(s) for s in (*left, *right)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, code, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    often = times > 1
    column = (np.cumsum(often) - 1)[code]
    owner, column = owner[often[code]], column[often[code]]
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    total = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(often.sum()), _COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, [low, low + _COLUMNS_AT_ONCE])
        marks = np.zeros((len(sizes), _COLUMNS_AT_ONCE), np.float32)
        marks[owner[a:b], column[a:b] - low] = 1
        total += marks[:len(left)] @ marks[len(left):].T
    return total.astype(np.int64)


def forest(n: int, pairs: np.ndarray) -> list[int]:
    """Indices of pairs that connect what all of them connect."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = top(a), top(b)
        if a != b:
            parent[b] = a
            kept.append(i)
    return kept


def _verify(threshold: float):
    def links(group: dict) -> tuple[list, list, list]:
        left = [r for r in group["rows"] if r[0] == group["i"]]
        right = [r for r in group["rows"] if r[0] == group["j"]]
        same = group["i"] == group["j"]
        a, b = [np.frombuffer(r[4], np.uint64) for r in left], [np.frombuffer(r[4], np.uint64) for r in right]
        if not a or not b or (same and len(a) < 2):
            return [], [], []
        common = overlaps(a, b)
        n, m = np.array([len(s) for s in a]), np.array([len(s) for s in b])
        # In whole numbers where the threshold allows it: common / union >= threshold.
        close = common >= threshold * (n[:, None] + m[None, :] - common) - 1e-9
        if same:
            close &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
        x, y = np.nonzero(close)
        # A pair that shares several buckets counts in that of its first common band.
        shared_a, shared_b = np.array([r[3] for r in left]), np.array([r[3] for r in right])
        keep = []
        for low in range(0, len(x), 65536):
            p, q = shared_a[x[low:low + 65536]], shared_b[y[low:low + 65536]]
            both = (p == q) & (p != 0)
            keep.append(p[np.arange(len(p)), both.argmax(axis=1)] == group["bucket"])
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        x, y = x[keep], y[keep]
        weight_a, weight_b = np.array([r[2] for r in left]), np.array([r[2] for r in right])
        out: list[tuple] = []
        for rows, own, other, weight in ((left, x, y, weight_b), (right, y, x, weight_a)):
            total = np.bincount(own, weights=weight[other], minlength=len(rows)) if len(own) else np.zeros(len(rows))
            out += [(rows[i][1], None, int(total[i])) for i in np.nonzero(total)[0]]
        nodes = [*left, *right]
        shift = 0 if same else len(left)
        pairs = np.stack([x, y + shift], axis=1)
        out += [(nodes[pairs[i, 0]][1], nodes[pairs[i, 1]][1], 0) for i in forest(len(nodes), pairs)]
        return tuple(zip(*out, strict=True)) if out else ([], [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[tuple]) -> pa.RecordBatch:
            columns = [[x for part in found for x in part[c]] for c in range(3)]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())],
                names=["a", "b", "weight"],
            )

        group: dict | None = None
        for batch in batches:
            found = []
            names = ("bucket", "i", "j", "block", "digest", "size", "shared", "blob")
            for bucket, i, j, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if group is None or (bucket, i, j) != (group["bucket"], group["i"], group["j"]):
                    if group is not None:
                        found.append(links(group))
                    group = {"bucket": bucket, "i": i, "j": j, "rows": []}
                # A set that came twice, from rows that repeat, counts once.
                if not group["rows"] or group["rows"][-1][:2] != tuple(row[:2]):
                    group["rows"].append(tuple(row))
            yield emit(found)
        if group is not None:
            yield emit([links(group)])
    return run


def _linked(
    work: Scratch, keyed: DataFrame, members: DataFrame, width: int, threshold: float, bands: int, block: int
) -> DataFrame:
    """For each class of equal sets that has copies or near ones its group and its number of links."""
    classes = work.stored(members.where("digest is not null").groupBy("digest").agg(
        F.count("*").alias("size"), F.min(F.struct("doc_id", "k")).alias("first"), F.any_value("bands").alias("bands"),
    ), "classes")
    placed = classes.select("digest", F.explode("bands").alias("bucket"))
    full = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = placed.join(full, "bucket").groupBy("digest").agg(F.collect_set("bucket").alias("met"))
    # Bands in which a class is alone hold 0.
    met = F.transform("bands", lambda h: F.when(F.array_contains("met", h), h).otherwise(F.lit(0).cast("long")))
    shared = work.stored(
        classes.join(shared, "digest").select("digest", "size", "first", met.alias("shared")), "shared"
    )
    spread = shared.select("shared", F.posexplode("shared").alias("band", "bucket")).where("bucket <> 0")
    ends = [f(F.col("shared")[j]).alias(f"{name}{j}") for j in range(bands) for name, f in (("low", F.min), ("high", F.max))]
    redundant = F.lit(False)
    for j in range(bands):
        redundant |= (F.col("band") > j) & (F.col(f"low{j}") == F.col(f"high{j}")) & (F.col(f"low{j}") != 0)
    buckets = spread.groupBy("band", "bucket").agg(F.count("*").alias("n"), *ends).where(~redundant)
    buckets = buckets.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))

    needed = shared.select("digest", F.explode("shared").alias("bucket")).where("bucket <> 0").join(buckets, "bucket")
    needed = needed.groupBy("digest").agg(F.collect_list(F.struct("bucket", "blocks")).alias("needed"))
    wanted = shared.join(needed, "digest").select("digest", "size", "first", "shared", "needed")
    texts = keyed.select("doc_id", "k", "text").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k") == F.col("first.k"))
    ).select("digest", "size", "shared", "needed", "text")
    schema = schema_of(texts, ["digest", "size", "shared", "needed"], "blob binary")
    sets = texts.mapInArrow(_sets(width), schema).withColumn("to", F.explode("needed"))
    own = F.pmod(F.xxhash64("digest"), F.col("to.blocks")).cast("int")
    dealt = sets.select(
        F.col("to.bucket").alias("bucket"), own.alias("block"), "digest", "size", "shared", "blob",
        F.explode(F.sequence(F.lit(0), F.col("to.blocks") - 1)).alias("other"),
    ).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block", "digest")
    found = work.stored(
        dealt.select("bucket", "i", "j", "block", "digest", "size", "shared", "blob").mapInArrow(
            _verify(threshold), "a binary, b binary, weight bigint"
        ), "links",
    )
    weights = found.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("weight").alias("weight"))
    labels = min_labels(
        found.where("b is not null").select("a", "b"), store=work.stored
    ).withColumnRenamed("node", "digest")
    linked = classes.select("digest", "size", "first").where("size > 1").unionByName(
        classes.join(labels, "digest", "left_semi").where("size = 1").select("digest", "size", "first")
    ).join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    groups = linked.groupBy("label").agg(F.min("first").alias("group"))
    return linked.join(groups, "label").join(weights, "digest", "left").select(
        F.col("digest").alias("class"), "group", (F.col("size") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links")
    )


def near_duplicates(
    docs: DataFrame, *, width: int = 5, threshold: float = 0.8, recall: float = 0.9995, seed: int = 5,
    block: int = 512, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Groups of documents whose sets of ``width``-word shingles have a Jaccard similarity of
    ``threshold`` or more.

    Returns one row per row of ``docs``: ``doc_id``, ``k`` (a hash of the text, which tells rows of one
    id apart), ``group_id`` and ``group_k`` (the smallest (id, k) reachable by links, itself included) and
    ``n_links`` (long, other documents linked directly; equal sets are linked).

    Words are separated by white space and compared exactly; a text of fewer words has one shingle of
    all of them. Null, empty and blank texts have no shingles, link with nothing and form groups of
    their own. Rows that repeat are documents like any other. Null ids come first. An empty table
    gives no rows; other columns are ignored.

    Bands and rows follow from the threshold and the ``recall`` wanted for a pair just at it; more
    similar pairs are found more surely. Documents with equal sets are one class. Classes meet in
    buckets of equal band hashes; buckets of one class, and those whose members all share an earlier
    band, are left out. The members' full sets are then shipped to each bucket, and pairs are verified
    exactly there, each in the bucket of its first common band, so nothing is counted twice. A bucket
    above ``block`` classes is dealt over blocks, and each pair of blocks is a group of its own: no
    task holds more than two blocks. What leaves a group is a count for each class and the edges of a
    spanning forest, never all pairs. Groups are then the connected components of those edges.
    """
    bands, rows = banding(threshold, recall)
    keyed = docs.select(
        F.col(f"`{id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("k"), F.col(f"`{text}`").alias("text")
    )
    schema = schema_of(keyed, ["doc_id", "k"], "digest binary, bands array<bigint>")
    members = stored(keyed.mapInArrow(_signatures(width, bands, rows, seed), schema), "signatures")

    with Scratch(docs.sparkSession) as work:
        info = stored(_linked(work, keyed, members, width, threshold, bands, block), "groups")
    done = members.join(info, members["digest"] == info["class"], "left")
    return done.select(
        "doc_id", "k", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("group.doc_id")).alias("group_id"),
        F.when(F.col("class").isNull(), F.col("k")).otherwise(F.col("group.k")).alias("group_k"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
