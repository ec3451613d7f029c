"""Encoding of texts into pieces of a public vocabulary, with the N best segmentations, and decoding."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import schema_of, sliced

_UNIT = re.compile(r"\n| *[^ \n]+| +")
_CACHE = 500_000  # units whose best segmentation a task remembers
_FILTER_BITS = 22
_CHARS_AT_ONCE = 100_000
_NO_PIECE = np.iinfo(np.int32).min
_PRIME = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: spaces stand for the word mark. ``of`` gives a piece's id and log probability."""

    of: dict[str, tuple[int, float]]
    bytes_from: int  # id of the piece of byte 0
    byte_score: float
    surface: dict[int, bytes]
    longest: int  # characters of a piece


def load_pieces(path: str, zipf: bool = True) -> Pieces:
    """Read a SentencePiece model with byte fallback.

    ``zipf`` takes the scores of the file for negative ranks, as models of merges have them, and gives
    the piece of rank r the log probability -ln(r + 2) less a constant; else they are log
    probabilities. A byte is e^-10 times as likely as the rarest piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        i for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    scores = {i: model.get_score(i) for i in plain}
    if zipf:
        total = math.log(sum(1 / (2 - s if s > -1e8 else 2.0) for s in scores.values()))
        scores = {i: -math.log(2 - s if s > -1e8 else 2.0) - total for i, s in scores.items()}
    names = {i: model.id_to_piece(i).replace("▁", " ") for i in plain}
    first = next(i for i in range(model.get_piece_size()) if model.is_byte(i))
    surface = {i: n.encode() for i, n in names.items()} | {first + b: bytes([b]) for b in range(256)}
    longest = max(map(len, names.values()))
    return Pieces({n: (i, scores[i]) for i, n in names.items()}, first, min(scores.values()) - 10, surface, longest)


def arcs_of(unit: str, pieces: Pieces) -> list[list[tuple[int, tuple[int, ...], float]]]:
    """The lattice of a unit: for each end the arcs (start, ids, log probability) that lead there. A
    character that is no piece has one arc, of its bytes."""
    ends: list[list] = [[] for _ in range(len(unit) + 1)]
    for start in range(len(unit)):
        for end in range(start + 1, min(len(unit), start + pieces.longest) + 1):
            found = pieces.of.get(unit[start:end])
            if found:
                ends[end].append((start, (found[0],), found[1]))
            elif end == start + 1:
                data = unit[start].encode("utf-8", "surrogatepass")
                ends[end].append((start, tuple(pieces.bytes_from + b for b in data), len(data) * pieces.byte_score))
    return ends


def n_best(unit: str, pieces: Pieces, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best segmentations of a unit, best first, as (log probability, ids).

    Forward Viterbi gives the best score of every prefix. A* runs backward from the end with these as
    its heuristic; as it is exact, hypotheses leave the queue in the order of their full scores. No place is
    expanded more than ``n`` times, as no more of the suffixes from there can be in the ``n`` best; so ties do not
    branch without end. Hypotheses point back to the one they lengthen.
    """
    lattice = arcs_of(unit, pieces)
    forward = [0.0]
    for arcs in lattice[1:]:
        forward.append(max(forward[start] + score for start, _, score in arcs))
    # (negative full score, number, place, score behind it, ids added, hypothesis lengthened)
    queue = [(-forward[-1], 0, len(unit), 0.0, (), None)]
    expanded = [0] * (len(unit) + 1)
    found, number = [], 0
    while queue and len(found) < n:
        best = heapq.heappop(queue)
        _, _, place, behind, _, _ = best
        if place == 0:
            ids: list[int] = []
            step = best
            while step is not None:
                ids += step[4]
                step = step[5]
            found.append((behind, tuple(ids)))
            continue
        if expanded[place] == n:
            continue
        expanded[place] += 1
        for start, own, score in lattice[place]:
            if expanded[start] < n:
                number += 1
                heapq.heappush(queue, (-(forward[start] + score + behind), number, start, score + behind, own, best))
    return found


class Viterbi:
    """Best segmentation of many units at once, and by how much their second best falls short."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        names = list(pieces.of)
        hashes = np.array([self._hash(n) for n in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.piece_ids = np.array([pieces.of[names[i]][0] for i in order])
        self.scores = np.array([pieces.of[names[i]][1] for i in order])
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.hashes)] = True

    @staticmethod
    def _hash(name: str) -> int:
        h = 0
        for c in name:
            h = (h * int(_PRIME) + ord(c) + 1) % 2**64
        return h

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def _lattice(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """For units of one size: the lengths of the pieces in them from 1 on, and scores and ids by length, start
        and unit.

        Where no piece is, the score is minus infinity. A character that is no piece has the negative id
        -1 - code, for its bytes.
        """
        size, n = len(units[0]), len(units)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T
        chars = np.ascontiguousarray(chars).astype(np.uint64) + np.uint64(1)
        longest = min(size, self.pieces.longest)
        lengths, scores, ids = [], [], []
        h = np.zeros((size, n), np.uint64)
        for length in range(1, longest + 1):
            h = h[:size - length + 1] * _PRIME + chars[length - 1:]
            flat = h.ravel()
            maybe = np.flatnonzero(self.filter[self._slot(flat)])
            place = np.minimum(np.searchsorted(self.hashes, flat[maybe]), len(self.hashes) - 1)
            hit = self.hashes[place] == flat[maybe]
            if length > 1 and not hit.any():
                continue
            at = np.divmod(maybe[hit], n)
            lengths.append(length)
            scores.append(np.full((size, n), -np.inf))
            ids.append(np.zeros((size, n), np.int32))
            scores[-1][at] = self.scores[place[hit]]
            ids[-1][at] = self.piece_ids[place[hit]]
        odd = np.isinf(scores[0])
        code = chars[odd].astype(np.int64) - 1
        in_bytes = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        scores[0][odd] = in_bytes * self.pieces.byte_score
        ids[0][odd] = -1 - code
        return lengths, np.stack(scores), np.stack(ids)

    def _best_of_one_size(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size, n = len(units[0]), len(units)
        lengths, scores, ids = self._lattice(units)
        length_of = np.array(lengths)
        there = np.isfinite(scores).any(axis=2)
        forward, backward = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        forward[0], backward[size] = 0.0, 0.0
        chosen = np.zeros((size + 1, n), np.int8)
        for end in range(1, size + 1):
            for row, length in enumerate(lengths):
                if length <= end and there[row, end - length]:
                    value = forward[end - length] + scores[row, end - length]
                    better = value > forward[end]
                    np.copyto(forward[end], value, where=better)
                    np.copyto(chosen[end], row, where=better)
        for start in range(size - 1, -1, -1):
            for row, length in enumerate(lengths):
                if there[row, start]:
                    np.maximum(backward[start], scores[row, start] + backward[start + length], out=backward[start])

        steps = []
        at, unit = np.full(n, size), np.arange(n)
        while len(at):
            row = chosen[at, unit].astype(np.int64)
            at = at - length_of[row]
            own = np.full(n, _NO_PIECE, np.int32)
            own[unit] = ids[row, at, unit]
            steps.append(own)
            scores[row, at, unit] = -np.inf  # what is left leads off the best path
            going = at > 0
            at, unit = at[going], unit[going]
        second = np.full(n, -np.inf)
        for row, length in enumerate(lengths):
            upto = size - length + 1
            through = forward[:upto] + scores[row, :upto] + backward[length:]
            np.maximum(second, through.max(axis=0), out=second)
        path = np.stack(steps[::-1], axis=1)
        real = path != _NO_PIECE
        flat, counts = path[real], real.sum(axis=1)
        if (flat < 0).any():
            flat, counts = self._in_bytes(flat, counts)
        best = forward[size]
        return flat, counts, best, best - second

    def _in_bytes(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece give way to the pieces of their bytes."""
        out, sizes, place = [], [], 0
        for count in counts.tolist():
            before = len(out)
            for i in flat[place:place + count].tolist():
                data = () if i >= 0 else chr(-1 - i).encode("utf-8", "surrogatepass")
                out.extend([i] if i >= 0 else [self.pieces.bytes_from + b for b in data])
            sizes.append(len(out) - before)
            place += count
        return np.array(out, np.int32), np.array(sizes)

    def best(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The units in another order, and of them, one after the other, the ids of the best segmentation,
        their number, its log probability and the shortfall of the second best. No unit may be empty."""
        by_size: dict[int, list[str]] = {}
        for u in units:
            by_size.setdefault(len(u), []).append(u)
        order, parts = [], []
        for size, own in by_size.items():
            step = max(1, _CHARS_AT_ONCE // size)
            for low in range(0, len(own), step):
                order += own[low:low + step]
                parts.append(self._best_of_one_size(own[low:low + step]))
        return order, *(np.concatenate(x) for x in zip(*parts, strict=True))


class Known:
    """Units whose best segmentation is known, as numbers into arrays."""

    def __init__(self, viterbi: Viterbi):
        self.viterbi = viterbi
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.scores, self.gaps, self.begin = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.number]
        if not new:
            return
        if len(self.number) + len(new) > _CACHE and self.number:
            self.forget()
            new = list(units)
        order, *found = self.viterbi.best(new)
        base = len(self.number)
        self.number.update((u, base + i) for i, u in enumerate(order))
        self.ids, self.sizes, self.scores, self.gaps = (
            np.concatenate(x) for x in zip((self.ids, self.sizes, self.scores, self.gaps), found, strict=True)
        )
        self.begin = np.cumsum(self.sizes) - self.sizes


def combinations(choices: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best sums of one entry from each descending list, with the entries' places."""
    begin = (0,) * len(choices)
    queue, seen, out = [(-sum(c[0] for c in choices), begin)], {begin}, []
    while queue and len(out) < n:
        total, places = heapq.heappop(queue)
        out.append((-total, places))
        for i, place in enumerate(places):
            following = (*places[:i], place + 1, *places[i + 1:])
            if place + 1 < len(choices[i]) and following not in seen:
                seen.add(following)
                change = choices[i][place + 1] - choices[i][place]
                heapq.heappush(queue, (total - change, following))
    return out


def units_of(text: str) -> list[str]:
    """A text with a space before it, cut where no piece can reach across: before the spaces of a word
    and around line breaks."""
    return _UNIT.findall(f" {text}") if text else []


_NBEST = pa.list_(pa.struct([
    ("score", pa.float64()),
    ("changes", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))]))),
]))


def _encode(pieces: Pieces, n: int, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(Viterbi(pieces))
        lists: dict[str, list] = {}
        for batch in sliced(batches, limit=2 << 20):
            texts = [units_of(t or "") for t in batch.column("text").to_pylist()]
            if len(lists) > _CACHE // 10:
                lists.clear()
            known.learn(set(chain.from_iterable(texts)))
            sizes = known.sizes

            # The ids of all units one after the other.
            n_units = [len(units) for units in texts]
            codes = np.fromiter(map(known.number.__getitem__, chain.from_iterable(texts)), np.int64, sum(n_units))
            lengths = sizes[codes]
            place = np.cumsum(lengths) - lengths
            flat = known.ids[np.arange(int(lengths.sum())) + np.repeat(known.begin[codes] - place, lengths)]
            counts, scores, nbest, low = [], [], [], 0
            for units in texts:
                own_codes = codes[low:low + len(units)]
                at = place[low:low + len(units)]
                low += len(units)
                counts.append(int(sizes[own_codes].sum()))
                best = float(known.scores[own_codes].sum())
                scores.append(best)
                # The n best differ from the best in the n - 1 units whose second best costs least.
                gaps = known.gaps[own_codes]
                near = np.argpartition(gaps, n - 2)[:n - 1] if len(gaps) >= n > 1 else np.arange(len(gaps))[:n - 1]
                near = [i for i in np.sort(near).tolist() if gaps[i] < math.inf]
                choices = []
                for i in near:
                    if units[i] not in lists:
                        lists[units[i]] = n_best(units[i], pieces, n)
                    choices.append(lists[units[i]])
                rest = best - sum(c[0][0] for c in choices)
                own = []
                for total, picks in combinations([[s for s, _ in c] for c in choices], n)[1:]:
                    own.append({"score": rest + total, "changes": [
                        {"at": int(at[i] - at[0]), "drop": int(sizes[own_codes[i]]), "ids": c[p][1]}
                        for i, c, p in zip(near, choices, picks, strict=True) if p
                    ]})
                nbest.append(own)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns = [
                batch.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                pa.array(scores, pa.float64()), pa.array(nbest, _NBEST),
            ]
            names = ["key", "ids", "score", "alternatives"]
            if decoded:
                back = [decode_ids(flat[a:b].tolist(), pieces) for a, b in pairwise(ends.tolist())]
                columns.append(pa.array(back, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def encode_nbest(
    docs: DataFrame, pieces: Pieces, *, n: int = 4, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """The columns ``keep`` with the best segmentation of each whole text and the next ``n`` - 1.

    ``ids`` and ``score`` (log probability) are the best's; ``alternatives`` holds, best first, the
    others' ``score`` and ``changes``: at piece ``at`` of the best, ``drop`` pieces give way to ``ids``.
    There are fewer where a text has no more segmentations. Texts are not normalised, spaces are kept,
    and characters that are no piece are written as bytes, so decoding gives the text back. Null and
    empty texts have no pieces, score 0 and no alternatives. Other columns of any name are ignored.
    ``decoded`` adds what the ids of the best decode to, made in the same task: a second Python
    function, as in ``decode``, would run in workers of its own beside those that encode.

    No piece reaches across the start of a word or a line break, so a text's lattice is a chain of small
    ones. The best paths of a task's different units are found together by forward Viterbi in
    arrays; it also tells what each unit's second best costs. Only the units that the n best
    of a text can differ in are searched by backward A*, whose exact heuristic the forward scores are.
    Nothing is shuffled, and a task remembers a bounded number of units.
    """
    key = F.struct(*(F.col(f"`{c}`") for c in keep))
    rows = docs.select(key.alias("key"), F.col(f"`{text}`").alias("text"))
    ddl = (
        "ids array<int>, score double, "
        "alternatives array<struct<score:double,changes:array<struct<at:int,drop:int,ids:array<int>>>>>"
    )
    own = ["ids", "score", "alternatives"]
    if decoded:
        ddl, own = f"{ddl}, decoded string", [*own, "decoded"]
    return rows.mapInArrow(_encode(pieces, n, decoded), schema_of(rows, ["key"], ddl)).select("key.*", *own)


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """The text of a list of ids."""
    data = b"".join([pieces.surface.get(i, b"") for i in ids])
    return data.decode("utf-8", "replace").removeprefix(" ")


def decode(encoded: DataFrame, pieces: Pieces, *, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of the ids; control pieces have none, null ids give a null text."""
    @F.udf("string", useArrow=True)
    def text(own):
        return None if own is None else decode_ids(own, pieces)

    return encoded.withColumn(to, text(F.col(f"`{ids}`")))
