"""Word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts (separated by white space), and the number of words of each text."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    solid = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    running = np.concatenate([[0], np.cumsum(solid)])
    ends = np.cumsum(counts)
    return flat.filter(pa.array(solid)), running[ends] - running[ends - counts]


def word_hashes(words: pa.Array) -> np.ndarray:
    """Each different word is hashed once."""
    coded = words.dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    hashed = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    return hashed[coded.indices.to_numpy(zero_copy_only=False)]


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts one after the other, and the number of each text's shingles.

    A text of fewer words than ``width`` has one shingle of all its words; a text without words none.
    """
    words, counts = words_of(texts)
    h = word_hashes(words)
    n = len(h)
    # Past the end of the last text: as many zeros as a shingle may reach over.
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words to the end of the text
    first = np.repeat(np.cumsum(counts) - counts, counts) == np.arange(n)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * _MULTIPLIER + np.where(left > j, padded[j:j + n], np.uint64(0))
    whole = (left >= width) | first
    return mixed(total[whole]), np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted different shingles of each text."""
    flat, counts = shingle_hashes(texts, width)
    ends = np.cumsum(counts)
    return [np.unique(flat[e - c:e]) for e, c in zip(ends, counts, strict=True)]
