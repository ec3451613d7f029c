"""Session settings that the jobs are meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Hot orders, customers and null keys are split at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Where every partition of the smaller side fits this, it is hashed and the larger is not sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}

_PARTITION_BYTES = 128 * 1024**2


def configure(
    builder: SparkSession.Builder, shuffle_bytes: int | None = None, min_partitions: int = 64
) -> SparkSession.Builder:
    """Apply the settings; ``shuffle_bytes``, the most that one join moves, sizes its partitions.

    Partitions are planned for the full volume and merged at run time where less arrives.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_bytes is not None:
        partitions = max(min_partitions, -(-shuffle_bytes // _PARTITION_BYTES))
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder
