"""Stretches of words that repeat with a short period, found by recursive frequency splitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import schema_of, sliced

_SETTLED = 64  # a segment that loses less than this part of its words in a round is scanned as it is


def split_by_frequency(codes: np.ndarray, sizes: np.ndarray, least: int, shortest: int) -> list[tuple[int, int]]:
    """Segments (first, end) of the texts lying one after the other in ``codes`` that can hold a run.

    A run holds each of its words ``least`` times or more and is ``shortest`` words long. A word that occurs
    less often in its segment is in no run there, so the segment is split at it; in the shorter segments more
    words are rare, and so on until nothing changes. Only segments that changed are counted again. One that
    barely shrinks is left to the scan, which is exact anyway, so the number of rounds stays logarithmic.
    """
    place = np.arange(len(codes))
    segment = np.repeat(np.arange(len(sizes)), sizes)
    done: list[tuple[int, int]] = []
    n_codes = int(codes.max(initial=0)) + 1
    while len(place):
        new = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(segment) != 0)])
        number = np.cumsum(new) - 1
        length = np.bincount(number)
        long = length[number] >= shortest
        place, number = place[long], number[long]
        if not len(place):
            break
        _, inverse, counts = np.unique(number * n_codes + codes[place], return_inverse=True, return_counts=True)
        rare = counts[inverse] < least
        lost = np.bincount(number, weights=rare, minlength=len(length))
        stable = lost == 0
        final = stable | (lost * _SETTLED < length)
        # A segment that lost a few words only is cut there, and its parts are final.
        out = final[number] & ~rare
        own, at = number[out], place[out]
        if len(at):
            first = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(own) != 0)])
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(at))
            done += [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(starts, ends, strict=True) if b - a >= shortest]
        on = ~final[number] & ~rare
        place, segment = place[on], number[on]
    return sorted(done)


def _stretch(codes: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The places (first, end) around ``at`` whose word equals the one ``lag`` later."""
    low, high, last = at, at + 1, len(codes) - lag
    step = 64
    while high < last:
        end = min(last, high + step)
        differ = np.flatnonzero(codes[high:end] != codes[high + lag:end + lag])
        if len(differ):
            high += int(differ[0])
            break
        high, step = end, step * 2
    step = 64
    while low > 0:
        start = max(0, low - step)
        differ = np.flatnonzero(codes[start:low] != codes[start + lag:low + lag])
        if len(differ):
            low = start + int(differ[-1]) + 1
            break
        low, step = start, step * 2
    return low, high


def scan_lags(codes: np.ndarray, exponent: int, shortest: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one segment, by comparing it with itself at every lag.

    A run of period q is ``exponent`` * q words or longer (four at least) and ``shortest`` or longer, and can be
    extended at neither end. Lags come in increasing order, and at lag q only every q-th place is compared,
    so all lags together cost n log n: a run has two neighbouring such places at least that match and from
    which it goes on for 2q words. A place from which a run of a smaller period goes on as far is passed
    over, as two periods over 2q words would make the smaller the period of all.
    """
    n = len(codes)
    found: list[tuple[int, int, int]] = []
    until = np.zeros(n, np.int64)  # the end of the known run that goes on the farthest from a place
    for lag in range(1, n // exponent + 1):
        sampled = codes[::lag]
        same = sampled[1:] == sampled[:-1]
        if not same.any():
            continue
        at = np.flatnonzero(same)
        at = at[until[at * lag] < (at + 2) * lag]
        at = at[:-1][np.diff(at) == 1] * lag if len(at) > 1 else at[:0]
        passed = 0
        for x in at.tolist():
            if x < passed or not np.array_equal(codes[x:x + lag], codes[x + lag:x + 2 * lag]):
                continue
            low, passed = _stretch(codes, lag, x)
            length = passed - low + lag
            if length >= max(shortest, exponent * lag):
                found.append((low, length, lag))
                np.maximum(until[low:low + length], low + length, out=until[low:low + length])
    return found


def find_runs(codes: np.ndarray, sizes: np.ndarray, exponent: int = 4, shortest: int = 6) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and period; starts count from the text's own first word."""
    ends = np.cumsum(sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for a, b in split_by_frequency(codes, sizes, exponent, shortest):
        text = int(np.searchsorted(ends, a, side="right"))
        first = int(ends[text] - sizes[text])
        runs[text] += [(a - first + start, length, period) for start, length, period in scan_lags(codes[a:b], exponent, shortest)]
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in runs]


def _runs(exponent: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lists = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
            flat = lists.flatten()
            solid = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
            running = np.concatenate([[0], np.cumsum(solid)])
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            sizes = np.diff(running[ends], prepend=0)
            words = flat.filter(pa.array(solid))
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found = find_runs(codes, sizes, exponent, shortest)

            kept = np.ones(len(words), bool)
            for first, own in zip(np.cumsum(sizes) - sizes, found, strict=True):
                for start, length, period in own:
                    kept[first + start + period:first + start + length] = False
            left = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])]
            collapsed = pc.binary_join(
                pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(kept))), " "
            )
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sizes.astype(np.int64)), pa.array(rows, kind), collapsed],
                names=["row", "n_words", "runs", "collapsed"],
            )
    return run


def periodic_runs(docs: DataFrame, *, exponent: int = 4, shortest: int = 6, text: str = "text") -> DataFrame:
    """Runs of repeated words in each text, and the text without the repetitions.

    Words are the stretches between the white space of ASCII. A run is a stretch of words with smallest
    period q (words q apart are equal) of ``exponent`` * q words or more and ``shortest`` or more that no
    neighbouring word extends; runs of different period may overlap.

    Returns the columns of ``docs`` and ``n_words`` (long), ``runs`` (array of (start, length, period), by
    start and period, counted in words from 0) and ``collapsed`` (the words that no run holds after its first
    period, joined by one space); these three replace columns of their names. A null, empty or blank text
    has no words, no runs and an empty ``collapsed``. Rows that repeat are treated alike. An empty table gives
    no rows.

    Each text is split at words too rare for a run, again and again, and what is left is compared with itself
    at every lag. Nothing is shuffled: a task holds a few megabytes of texts at a time, or one longer text.
    """
    if exponent < 4 or shortest < exponent:
        raise ValueError("runs are repeated four times at least, and not shorter than that")
    added = ("n_words", "runs", "collapsed")
    rest = [c for c in docs.columns if c.lower() not in added]
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(True)).alias("row"), F.col(f"`{text}`").alias("text")
    )
    schema = schema_of(
        keyed, ["row"], "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )
    done = keyed.mapInArrow(_runs(exponent, shortest), schema)
    return done.select(*(F.col(f"row.`{c}`") for c in rest), *added)
