"""Text to fixed-length vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions.vectors import check_dim
from ledgerlift.schemas import EMBEDDING_DIM

# Rows of a batch whose words a task counts at once: what it holds does not grow with the batch.
_ROWS_AT_ONCE = 512

# Takes a batch of texts, returns one vector per text.
Embedder = Callable[[Sequence[str]], "np.ndarray | Sequence[Sequence[float]]"]


def words_of(text: Column) -> Column:
    """The words of a text in lower case, in order: ``array<string>`` with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _bucket_vectors(dim: int) -> Callable[[Column], Column]:
    @F.arrow_udf("array<float>")
    def count_and_normalise(words: pa.Array) -> pa.Array:
        found, bucket_of = np.empty((len(words), dim), "f4"), {}
        for low in range(0, len(words), _ROWS_AT_ONCE):
            some = words.slice(low, _ROWS_AT_ONCE)
            rows = len(some)
            lengths = some.value_lengths().to_numpy(zero_copy_only=False)
            coded = some.flatten().dictionary_encode()
            different = coded.dictionary.to_pylist()
            # Each different word of the batch is hashed once.
            for word in different:
                if word not in bucket_of:
                    bucket_of[word] = int(md5(word.encode()).hexdigest()[:8], 16) % dim
            bucket = np.array([bucket_of[w] for w in different], "i8")
            flat = bucket[coded.indices.to_numpy(zero_copy_only=False)]
            cell = np.repeat(np.arange(rows, dtype="i8"), lengths) * dim + flat
            counts = np.bincount(cell, minlength=rows * dim).reshape(rows, dim).astype("f8")
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            found[low:low + rows] = counts / np.where(norms == 0.0, 1.0, norms)
        offsets = np.arange(0, len(words) * dim + 1, dim, dtype="i4")
        return pa.ListArray.from_arrays(offsets, found.ravel())

    return count_and_normalise


def embed_texts(
    df: DataFrame, text: str = "text", *, embedder: Embedder | None = None, dim: int = EMBEDDING_DIM
) -> DataFrame:
    """Add ``vector``, ``dim`` floats of unit length by default, to every row.

    ``embedder`` is called in the tasks with one batch of texts at a time; an error in it, or a
    vector of another length, fails the job. The default hashes words into ``dim`` buckets: it
    compares wording, not meaning. Its words are split by Spark, hashed once per batch and counted in
    arrays; there is no shuffle.
    """
    if embedder is None:
        vector = _bucket_vectors(dim)(words_of(F.col(text)))
        return df.withColumn("vector", vector)

    @F.pandas_udf("array<float>")
    def call(texts: pd.Series) -> pd.Series:
        vectors = np.asarray(embedder(texts.tolist()), dtype="f4")
        if vectors.shape != (len(texts), dim):
            raise ValueError(f"embedder returned shape {vectors.shape}, expected {(len(texts), dim)}")
        return pd.Series(list(vectors))

    return df.withColumn("vector", check_dim(call(F.col(text)), dim))
