"""Token sequences packed by solving for how often each combination of lengths fills a window."""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.llm.common import schema_of, sliced, stored

# How byte-level tokenizers write the bytes of UTF-8: printable ones of Latin-1 as they are, others from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_CACHED_WORDS = 1_000_000  # of one worker; beyond that it starts anew
_WORD_ENDS = ".,;:!?"
_LATIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"  # the letters below 256


# --- tokens ---------------------------------------------------------------------------------------

def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``ids`` that are used, one after the other, and their sizes."""
    starts, sizes = starts[used], sizes[used]
    ends = np.cumsum(sizes)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)], sizes


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, each different word encoded once.

    Texts are cut at ASCII white space, and behind the Latin letters of a word that ends in plain punctuation;
    the tokenizer cuts there as well and composes nothing across, so the ids are those of the whole text. Words of
    Latin letters go to its model straight, where that gives the same for words of every such letter.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        letters = [c for c in map(chr, range(256)) if c.isalpha()]
        probes = [*letters, *(f"x{a}{b}" for a in letters for b in ("y", *letters[::7]))]
        batch = self.tokenizer.encode_batch_fast(probes, add_special_tokens=False)
        # Whether Latin words may be given to the model as they are, without the steps before it.
        self.direct = self._pieces_of(probes) == [e.ids for e in batch]
        self._forget()

    def _pieces_of(self, words: list[str]) -> list[list[int]]:
        """The ids of words of Latin letters by the model alone."""
        tokenize = self.tokenizer.model.tokenize
        # A comma stands for itself among the letters that write bytes.
        written = ",".join(words).lower().encode().decode("latin-1").translate(_BYTES).split(",")
        return [[t.id for t in tokenize(w)] for w in written] if words else []

    def _forget(self) -> None:
        self.places: dict[str, int] = {"": 0}  # of a word among the words learned
        self.starts = self.sizes = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        latin = pc.match_substring_regex(pa.array(words, pa.string()), _LATIN).to_numpy(zero_copy_only=False).tolist()
        plain = [w for w, own in zip(words, latin, strict=True) if own and self.direct]
        whole = [w for w, own in zip(words, latin, strict=True) if not (own and self.direct)]
        encoded = self._pieces_of(plain)
        encoded += [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
        self.places.update(zip(plain + whole, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def _places_of(self, words: pa.Array) -> np.ndarray:
        """Where the words stand among those learned, which they join if they are new."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.array([self.places.get(w, -1) for w in names], np.int64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = [names[i] for i in missing]
            self._learn(new)
            place[missing] = [self.places[w] for w in new]
        return place[coded.indices.to_numpy(zero_copy_only=False)]

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and the number of each word's."""
        if len(self.places) > _CACHED_WORDS:
            self._forget()
        cores = pc.utf8_rtrim(words, characters=_WORD_ENDS)
        latin = pc.match_substring_regex(cores, _LATIN)
        heads = pc.if_else(latin, pc.ascii_lower(cores) if self.direct else cores, words)
        ended = pc.and_(latin, pc.less(pc.binary_length(cores), pc.binary_length(words)))
        tails = pc.replace_substring_regex(words.filter(ended), f"^.*[^{_WORD_ENDS}]", "")
        used = np.zeros((len(words), 2), np.int64)
        used[:, 0] = self._places_of(heads)
        used[ended.to_numpy(zero_copy_only=False), 1] = self._places_of(tails)
        ids, sizes = _gathered(self.ids, self.starts, self.sizes, used.reshape(-1))
        return ids, sizes.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of each text's."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        ids, sizes = self._of_words(coded.dictionary)
        ids, sizes = _gathered(ids, np.cumsum(sizes) - sizes, sizes, coded.indices.to_numpy(zero_copy_only=False))
        running = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        return ids, np.diff(running[bounds], prepend=0)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(tokenizer: str) -> WordEncoder:
    if tokenizer not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are Spark's to deal out
        _ENCODERS.clear()
        _ENCODERS[tokenizer] = WordEncoder(tokenizer)
    return _ENCODERS[tokenizer]


def _tokens(tokenizer: str, window: int, end: int, kind: str):
    """The ids of each text with the end mark, and how many earlier rows of this task have as long a rest.

    ``part`` tells the task: counts of a length by part give the rank of a row among all of its length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in sliced(batches, limit=8 << 20):
            ids, counts = _encoder(tokenizer).encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end).astype(kind)
            counts = counts + 1
            rest, full = counts % window, counts // window
            rank = np.zeros(len(counts), np.int64)
            order = np.argsort(rest, kind="stable")
            sorted_rest = rest[order]
            first = np.searchsorted(sorted_rest, sorted_rest)
            rank[order] = np.arange(len(order)) - first
            rank += seen[rest]
            seen[:window] += np.bincount(rest, minlength=window)
            before = seen[window] + np.cumsum(full) - full
            seen[window] += full.sum()
            width = ids.itemsize
            offsets = np.concatenate([[0], np.cumsum(counts)]) * width
            blob = pa.Array.from_buffers(
                pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(counts), part, np.int64)), pa.array(counts), blob,
                 pa.array(rest.astype(np.int32)), pa.array(rank), pa.array(before)],
                names=["doc_id", "part", "n", "ids", "rest", "rank", "full_before"],
            )
    return run


# --- the plan ---------------------------------------------------------------------------------------

def combinations(total: int, depth: int) -> np.ndarray:
    """Multisets of up to ``depth`` numbers from 1 that add up to ``total``: a row each, ascending, 0 for none."""
    rows = np.zeros((1, 0), np.int64)
    left = np.array([total])
    done = []
    for place in range(depth):
        last = np.concatenate([rows, left[:, None]], axis=1)
        fits = left >= (rows[:, -1] if place else 1)
        done.append(np.pad(last[fits], ((0, 0), (depth - place - 1, 0))))
        if place == depth - 1:
            break
        low = rows[:, -1] if place else np.ones(1, np.int64)
        high = left // 2  # the next is no larger than what is left after it
        n = np.maximum(high - low + 1, 0)
        ends = np.cumsum(n)
        add = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n)
        rows = np.concatenate([np.repeat(rows, n, axis=0), add[:, None]], axis=1)
        left = np.repeat(left, n) - add
    return np.concatenate(done)


def solve_counts(parts: np.ndarray, counts: np.ndarray, rounds: int = 400, batch: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """How often each combination is to be used, by non-negative least squares against the histogram.

    ``counts`` has the number of pieces of each size from 0 (none). Minimises the weighted squares of pieces
    left over or missing, a size weighing as much as it is long, over non-negative repeat counts. Active sets
    after Lawson and Hanson: the combinations that lower the sum most (of those that share no size, ``batch``
    at a time) become free, the free ones are solved for, and those that would turn negative are held at 0.
    Stops at the optimum or after ``rounds``. Returns the rows used and their real-valued counts.
    """
    classes = len(counts)
    weight = np.arange(classes) / (classes - 1)
    scale = max(1.0, float(counts.max(initial=0)))
    goal = counts / scale
    usable = np.flatnonzero((counts[parts] > 0).all(axis=1, where=parts > 0))
    parts = parts[usable]
    free = np.zeros(0, np.int64)
    x = np.zeros(0)
    matrix = np.zeros((classes, 0))  # the free combinations

    def column(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((classes, len(rows)))
        for j in range(parts.shape[1]):
            np.add.at(out, (parts[rows, j], np.arange(len(rows))), 1)
        out[0] = 0
        return out

    for _ in range(rounds if len(parts) else 0):
        left = (goal - matrix @ x) * weight * weight
        left[0] = 0
        gain = left[parts].sum(axis=1)
        gain[free] = 0
        best = np.argpartition(-gain, min(8 * batch, len(gain) - 1))[:8 * batch]
        best = best[np.argsort(-gain[best], kind="stable")]
        taken, chosen = np.zeros(classes, bool), []
        for row in best:
            own = parts[row][parts[row] > 0]
            if gain[row] > 1e-9 and not taken[own].any():
                taken[own] = True
                chosen.append(row)
                if len(chosen) == batch:
                    break
        if not chosen:
            break
        free, x = np.append(free, chosen), np.append(x, np.zeros(len(chosen)))
        matrix = np.concatenate([matrix, column(np.array(chosen))], axis=1)
        while len(free):
            weighted = matrix * weight[:, None]
            z = np.linalg.solve(weighted.T @ weighted + 1e-10 * np.eye(len(free)), weighted.T @ (goal * weight))
            if (z > 0).all():
                x = z
                break
            falls = z <= 0
            step = min(1.0, float((x[falls] / np.maximum(x[falls] - z[falls], 1e-300)).min()))
            x = x + step * (z - x)
            stay = ~(falls & (x <= 1e-12))
            if stay.all():
                stay[np.flatnonzero(falls)[np.argmin(x[falls])]] = False
            free, x, matrix = free[stay], x[stay], matrix[:, stay]
    return usable[free], x * scale


@dataclass
class WindowPlan:
    """Where the row of each rest length and rank goes; made of the histogram of rests alone.

    Rests are classes of ``unit`` tokens, rounded up. ``parts`` and ``repeats`` are the combinations used.
    """

    window: int
    unit: int
    hist: np.ndarray  # rows by rest length, 0 to window - 1
    parts: np.ndarray
    repeats: np.ndarray

    def __post_init__(self):
        classes = self.window // self.unit + 1
        self.of_class = -(-np.arange(self.window) // self.unit)
        hist = self.hist.copy()
        hist[0] = 0
        self.smaller = np.zeros(self.window, np.int64)  # rows of the class that are shorter
        total = np.zeros(classes, np.int64)
        for r in range(1, self.window):
            self.smaller[r] = total[self.of_class[r]]
            total[self.of_class[r]] += hist[r]
        self.shorter = self.smaller.tolist()
        self.sequence = np.concatenate([[0], np.cumsum(self.repeats)])
        # Where a class's ranks for each combination begin.
        self.begins: list[list[int]] = [[] for _ in range(classes)]
        self.serves: list[list[tuple[int, int]]] = [[] for _ in range(classes)]
        self.first: list[dict[int, int]] = [{} for _ in self.repeats]
        self.members: list[list[tuple[int, int, int]]] = []  # class, how many of it, and the number among them
        self.used = np.zeros(classes, np.int64)
        for j, (own, times) in enumerate(zip(self.parts.tolist(), self.repeats.tolist(), strict=True)):
            own = [c for c in own if c]
            self.members.append([(c, own.count(c), i - own.index(c)) for i, c in enumerate(own)])
            for c in sorted(set(own)):
                many = own.count(c)
                self.begins[c].append(int(self.used[c]))
                self.serves[c].append((j, many))
                self.first[j][c] = int(self.used[c])
                self.used[c] += many * times
        # The rest of each length, longest first, end to end.
        self.taken = np.clip(self.used[self.of_class] - self.smaller, 0, hist)
        over = (hist - self.taken) * np.arange(self.window)
        self.base = np.concatenate([np.cumsum(over[::-1])[::-1][1:], [0]])
        self.over = int(over.sum())
        self.tail = self.over - self.over % self.window
        self.n_planned = int(self.sequence[-1])
        self.n_sequences = self.n_planned + self.tail // self.window + (self.over % self.window).bit_count()

    def _length(self, c: int, rank: int) -> int:
        """The exact length of the row of this rank in its class."""
        low = max(1, (c - 1) * self.unit + 1)
        high = min(self.window - 1, c * self.unit)
        return bisect_right(self.shorter, rank, low, high + 1) - 1 if high > low else low

    def places(self, rest: int, rank: int) -> list[tuple[int, int, int]]:
        """The pieces (length, sequence, offset) of the rest of a row: one, or more where it is cut."""
        c = int(self.of_class[rest])
        if rank < self.taken[rest]:
            own = int(self.smaller[rest]) + rank
            at = bisect_right(self.begins[c], own) - 1
            j, many = self.serves[c][at]
            instance, member = divmod(own - self.begins[c][at], many)
            offset = 0
            for d, same, number in self.members[j]:
                if (d, number) == (c, member):
                    break
                offset += self._length(d, self.first[j][d] + instance * same + number)
            return [(rest, int(self.sequence[j]) + instance, offset)]
        position = int(self.base[rest]) + (rank - int(self.taken[rest])) * rest
        pieces, left = [], rest
        while left:
            if position < self.tail:
                sequence, offset = divmod(position, self.window)
                room, number = self.window - offset, self.n_planned + sequence
            else:
                # The end is cut into powers of two, the largest first; none of them needs padding.
                at, number = self.tail, self.n_planned + self.tail // self.window
                for bit in range(self.window.bit_length() - 1, -1, -1):
                    size = 1 << bit
                    if (self.over - self.tail) & size:
                        if position < at + size:
                            break
                        at, number = at + size, number + 1
                offset, room = position - at, at + size - position
            length = min(left, room)
            pieces.append((length, number, offset))
            left, position = left - length, position + length
        return pieces


def plan_windows(hist: np.ndarray, window: int, unit: int, depth: int) -> WindowPlan:
    """Combinations of up to ``depth`` classes that fill a window, repeated as the solution says.

    Counts are rounded down, and once more up where the rows suffice, so every window planned is full.
    """
    of_class = -(-np.arange(window) // unit)
    counts = np.bincount(of_class, weights=np.concatenate([[0], hist[1:]]), minlength=window // unit + 1).astype(np.int64)
    every = combinations(window // unit, depth)
    rows, times = solve_counts(every, counts)
    order = np.lexsort((rows, -times))
    parts, times = every[rows[order]], times[order]
    left, repeats = counts.copy(), np.zeros(len(times), np.int64)
    for more in (np.floor(times + 1e-6).astype(np.int64), np.ones(len(times), np.int64)):
        for j, own in enumerate(parts):
            sizes, many = np.unique(own[own > 0], return_counts=True)
            n = min(int(more[j]), int((left[sizes] // many).min()))
            repeats[j] += n
            left[sizes] -= n * many
    return WindowPlan(window, unit, hist, parts[repeats > 0], repeats[repeats > 0])


# --- the job ---------------------------------------------------------------------------------------

def _pieces(plan: WindowPlan, kind: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = plan.window
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n", "rest", "rank", "full", "ids"))
            row, out, parts = [], [], []
            for i, (n, rest, rank, full, blob) in enumerate(zip(*columns, strict=True)):
                ids = np.frombuffer(blob, kind).astype("<u4")
                pieces = [(window, plan.n_sequences + full + k, 0) for k in range(n // window)]
                if rest:
                    pieces += plan.places(rest, rank)
                start = 0
                for length, sequence, offset in pieces:
                    own = ids[start:start + length]
                    out.append((start, length, zlib.crc32(own.tobytes()), n, sequence, offset))
                    row.append(i)
                    if with_ids:
                        parts.append(own.astype(np.int32))
                    start += length
            values = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 6)]
            names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                sizes = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
                flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                values.append(pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), *values], names=["doc_id", *names]
            )
    return run


def pack_windows(
    docs: DataFrame, tokenizer: str, *, end: int, window: int = 4096, unit: int = 8, depth: int = 4,
    with_ids: bool = True, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """All texts as token sequences of at most ``window`` (a power of two), with little padding.

    ``tokenizer`` is the JSON of a tokenizer that drops white space; a text's ids are those without special
    tokens and then ``end``. Returns one row per piece: ``doc_id``, ``start`` and ``length`` in the text's ids,
    ``ids_crc32`` (of the piece's ids as little-endian unsigned 32-bit numbers), ``doc_tokens``,
    ``sequence_id`` (from 0 without gaps), ``offset`` there and, unless ``with_ids`` is False, the ``ids``.

    A text above the window fills sequences of its own; what is left over is planned. The histogram of rests is
    all that reaches the driver (``window`` numbers). Multisets of up to ``depth`` rest lengths, in steps of
    ``unit``, that fill a window are enumerated, their repeat counts solved by non-negative least squares
    against the histogram, and rounded; such sequences hold whole rests and lack less than ``depth`` *
    ``unit`` tokens. Rests that the rounded counts leave over are packed greedily, the longest first, each
    sequence to its end, where the rest is cut; the last sequences are powers of two, the largest first.
    So only planned sequences need padding.

    The plan is a function of a rest's length and its rank among those of that length. Ranks come from counts by
    task and length, so nothing is sorted and no task holds all rows of a length. A null or empty text has the end mark
    only. Ids may be null or repeat; each row is a text of its own. An empty table gives no rows. Other
    columns are ignored.
    """
    if window & (window - 1) or window % unit:
        raise ValueError("the window must be a power of two and a multiple of the unit")
    kind = "<u2" if max(_largest_id(tokenizer), end) < 1 << 16 else "<u4"
    keyed = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = schema_of(
        keyed, ["doc_id"], "part bigint, n bigint, ids binary, rest int, rank bigint, full_before bigint"
    )
    tokens = stored(keyed.mapInArrow(_tokens(tokenizer, window, end, kind), schema), "tokens")
    counts = stored(tokens.groupBy("part", "rest").agg(
        F.count("*").alias("rows"), F.sum(F.floor(F.col("n") / window)).alias("full")), "counts")
    hist = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("rows").alias("rows")).collect():
        hist[r["rest"]] = r["rows"]
    plan = plan_windows(hist, window, unit, depth)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = counts.groupBy("part").agg(F.sum("full").alias("full")).select(
        "part", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("part_full"))
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "rest", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("earlier"))
    offsets = offsets.join(by_part, "part")
    placed = tokens.join(offsets, ["part", "rest"]).select(
        "doc_id", "n", "rest", (F.col("rank") + F.col("earlier")).alias("rank"),
        (F.col("full_before") + F.col("part_full")).alias("full"), "ids",
    )
    ddl = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    schema = schema_of(keyed, ["doc_id"], ddl + (", ids array<int>" if with_ids else ""))
    return placed.mapInArrow(_pieces(plan, kind, with_ids), schema)


def _largest_id(tokenizer: str) -> int:
    described = json.loads(tokenizer)
    ids = [*described["model"]["vocab"].values(), *(t["id"] for t in described.get("added_tokens") or [])]
    return max(ids)
