"""Uniform shuffle of a table into shards of exact size."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import shuffle_partitions

_NUMPY_LIMIT = 10**9  # numpy draws from smaller urns only


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` balls drawn without replacement are good.

    Urns beyond numpy's limit: inversion outwards from the mode, in blocks of probabilities.
    """
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), low), high)

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(choose(good, mode) + choose(bad, sample - mode) - choose(good + bad, sample))
    u = rng.random()
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    u -= at_mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-18 and p_down < 1e-18:
            break
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """A random matrix of counts with the given row and column sums, distributed as the traffic of a
    uniform random permutation: each row is multivariate hypergeometric given the capacities left."""
    rng = np.random.default_rng(seed)
    left, matrix = list(columns), []
    for wanted in rows:
        drawn, rest = [], sum(left)
        for capacity in left:
            rest -= capacity
            n = _hypergeometric(rng, capacity, rest, wanted) if wanted else 0
            drawn.append(n)
            wanted -= n
        left = [c - n for c, n in zip(left, drawn, strict=True)]
        matrix.append(drawn)
    return matrix


def shard_rows(
    df: DataFrame, n_shards: int, *, seed: int = 20, sources: int | None = None, rows_per_block: int = 20_000_000,
) -> DataFrame:
    """All rows in uniformly random order over ``n_shards`` shards whose counts differ by one at most.

    Adds ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in its shard); columns of these
    names in the input are replaced. The communication matrix says how many rows go from each source
    partition to each shard. Rows are permuted in their source partition and cut by the matrix,
    exchanged, and permuted again where they arrive. A shard above ``rows_per_block`` is drawn as
    several blocks of known size, so that its order is made by several tasks.

    Source partitions are buckets of a hash of the whole row, which comes out the same when a task
    is repeated; there are ``sources`` of them (the session's shuffle partitions by default), and
    with the blocks they bound the matrix, the only thing that passes the driver. The order is a
    function of the rows and ``seed``. Rows that are equal in every column are interchangeable and
    neighbours in their source partition only. Nulls and empty texts are values like any other; an
    empty table gives an empty result. With fewer rows than shards, some shards stay empty.
    """
    spark = df.sparkSession
    sources = sources or shuffle_partitions(spark)
    columns = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    keyed = df.select(row.alias("row"), F.xxhash64(F.lit(seed), row).alias("h")).withColumn(
        "p", F.pmod("h", F.lit(sources)).cast("int")
    )
    counted = dict(keyed.groupBy("p").count().collect())
    total = sum(counted.values())
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    blocks = max(1, -(-max(sizes) // rows_per_block))
    block_sizes = [size // blocks + (b < size % blocks) for size in sizes for b in range(blocks)]
    present = sorted(counted)
    matrix = communication_matrix([counted[p] for p in present], block_sizes, seed)

    # A literal that Spark parses: for each source, where the rows for each shard and block begin to end.
    lines = []
    for p, drawn in zip(present, matrix, strict=True):
        ends = np.cumsum(drawn).tolist()
        lines.append({"p": p, "ends": [ends[s * blocks:(s + 1) * blocks] for s in range(n_shards)]})
    starts = (np.cumsum(block_sizes) - block_sizes).reshape(n_shards, blocks)
    starts = (starts - starts[:, :1]).tolist()
    plan = spark.range(1).select(
        F.explode(F.from_json(F.lit(json.dumps(lines)), "array<struct<p:int,ends:array<array<bigint>>>>")).alias("m")
    ).select("m.p", "m.ends")

    # Permute locally. The matrix has sources x blocks cells, so sharing it is safe.
    rank = F.expr(f"row_number() over (partition by p order by xxhash64({seed + 1}, h), h)")
    cut = keyed.withColumn("rank", rank).join(F.broadcast(plan), "p")
    shard = F.expr("size(filter(ends, e -> e[size(e) - 1] < rank))")
    cut = cut.withColumn("shard", shard).withColumn("block", F.expr("size(filter(ends[shard], e -> e < rank))"))
    # Exchange, and permute where they arrive.
    start = F.from_json(F.lit(json.dumps(starts)), "array<array<bigint>>")
    place = F.expr(f"row_number() over (partition by shard, block order by xxhash64({seed + 2}, h), h, rank)")
    slot = place + start[F.col("shard")][F.col("block")] - 1
    return cut.withColumn("slot", slot).select(
        "row.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")
    )
