"""Long repeats within a block of texts, from its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def _ordered_by_prefix(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more, by prefix doubling."""
    n = len(codes)
    if codes.max(initial=0) < 256:
        # Eight symbols at once, the first the most significant.
        padded = np.concatenate([codes.astype(np.uint8), np.zeros(8, np.uint8)])
        key, known = np.ndarray((n,), ">u8", buffer=padded, strides=(1,)).astype(np.uint64), 8
    else:
        padded, known = np.concatenate([codes.astype(np.uint64), np.zeros(4, np.uint64)]), 4
        key = np.zeros(n, np.uint64)
        for j in range(known):
            key = (key << np.uint64(16)) | padded[j:j + n]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1], [True]])
    rank = np.zeros(n + depth, np.int32)  # past the end: before everything

    def number(at: np.ndarray) -> None:
        """Give the suffixes at these places the number of the first of their group."""
        starts = np.flatnonzero(new[at])
        rank[order[at]] = np.repeat(at[starts].astype(np.int32) + 1, np.diff(np.append(starts, len(at))))

    number(np.arange(n))
    while known < depth:
        # Only suffixes that are still tied with a neighbour are sorted again, within their group.
        at = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(at):
            break
        suffix = order[at]
        key = (rank[suffix].astype(np.int64) << 32) | rank[suffix + known]
        inner = np.argsort(key)
        order[at] = suffix[inner]
        key = key[inner]
        new[at[1:]] |= key[1:] != key[:-1]
        number(at)
        known *= 2
    return order


def prefix_boundaries(bwt: np.ndarray, depth: int) -> np.ndarray:
    """For a transform of symbols, 0 being the end mark: whether each suffix in order differs from the one
    before within its first ``depth`` symbols.

    Breadth-first backward extension: round l holds intervals of strings of length l. Each symbol found in
    the transform within such an interval extends the string to the left and gives the interval of a
    string of length l + 1; if its end is not yet a boundary, the common prefix there is exactly l long.
    Only such intervals go on. Common prefixes thus come in increasing order, and after ``depth`` rounds
    what is left shares ``depth`` symbols. End marks are not extended: strings with them are no match.
    """
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)  # place of the suffix that is one longer
    back[by_symbol] = np.arange(n)
    sorted_symbols = bwt[by_symbol]
    same = sorted_symbols[1:] == sorted_symbols[:-1]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    solid = bwt != 0

    bound = np.zeros(n + 1, bool)
    bound[[0, n, int((~solid).sum())]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        sizes = high - low
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1]) + np.repeat(low - (ends - sizes), sizes)
        real = solid[inside]
        is_first = real & (before[inside] < np.repeat(low, sizes))
        is_last = real & (after[inside] >= np.repeat(high, sizes))
        low, high = np.sort(back[inside[is_first]]), np.sort(back[inside[is_last]]) + 1
        fresh = ~bound[high]
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        bound[high] = True
    return bound[:n]


def repeated_starts(blobs: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each blob, at which offsets a string of ``length`` bytes starts that occurs twice or more in
    all blobs, where a blob counts ``weight`` times."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    raw = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1)
    is_mark = np.zeros(len(raw), bool)
    is_mark[ends - 1] = True
    present = np.zeros(256, bool)
    present[raw[~is_mark]] = True
    codes = (np.cumsum(present).astype(np.uint16))[raw]
    codes[is_mark] = 0
    if codes.max(initial=0) < 256:
        codes = codes.astype(np.uint8)
    order = _ordered_by_prefix(codes, length)
    bound = prefix_boundaries(codes[order - 1], length)
    group = np.cumsum(bound) - 1
    blob_of = np.repeat(np.arange(len(blobs)), sizes + 1)
    offset = np.arange(len(raw)) - np.repeat(ends - sizes - 1, sizes + 1)
    valid = offset + length <= sizes[blob_of]
    inside = valid[order]
    total = np.bincount(group[inside], weights=np.asarray(weights)[blob_of[order[inside]]], minlength=len(raw))
    hit = np.zeros(len(raw), bool)
    hit[order[inside]] = total[group[inside]] >= 2
    return [np.flatnonzero(hit[e - s - 1:e]) for e, s in zip(ends, sizes, strict=True)]
