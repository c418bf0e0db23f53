"""Packing token sequences into windows by non-negative least squares.

Documents are cut into full windows and a rest. The histogram of piece lengths, one number a
length, is all that planning needs: shallow combinations of lengths that fill a window exactly
are enumerated, their repeat counts are solved for by non-negative least squares,
rounded down to what the histogram holds, and the residual lengths are packed greedily. Pieces
whose greedy sequence stays open are cut instead: a prefix fills the room that is left and the
rest opens the next sequence. The plan says for the n-th piece of a length where it goes and
where it is cut, so pieces need ranks only.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ixlake.llm.common import saved, slices
from ixlake.llm.tokens import END_ID, SLICE_BYTES, TOKENIZER, encoder

WINDOW = 2048
SALTS = 64  # parts in which the pieces of one length are ranked
GRAIN = 16  # a rest may be cut at multiples of so many ids; its checksum is kept at each
GROUP = 128  # sequences that cut pieces fill before the plan repeats itself
SWEEPS = 4

_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, marks binary"


def _cut(tokenizer: str, end_id: int, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                starts, ids = encoder(tokenizer, end_id).encode(part.column("text"))
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                sizes = np.diff(starts)
                pieces = -(-sizes // window)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = number * window
                length = np.minimum(window, sizes[doc] - begin)
                at = (starts[doc] + begin) * 4
                crc, marks = [], []
                for a, b, size in zip(at.tolist(), (at + 4 * length).tolist(), length.tolist(), strict=True):
                    if size == window:
                        crc.append(zlib.crc32(raw[a:b]))
                        marks.append(None)
                        continue
                    value, own = 0, []
                    for m in range(a, b, 4 * GRAIN):
                        own.append(value)
                        value = zlib.crc32(raw[m : min(m + 4 * GRAIN, b)], value)
                    crc.append(value)
                    marks.append(array("I", own).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)),
                        pa.array(begin, pa.int64()),
                        pa.array(length, pa.int32()),
                        pa.array(crc, pa.int64()),
                        pa.array(sizes[doc], pa.int64()),
                        pa.array(marks, pa.binary()),
                    ],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "marks"],
                )

    return cut


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, ascending, that sum up to the window; 0 stands for none.

    All pairs and triples of lengths that are present.
    """
    rows = []
    small = present[present <= window // 2]
    has = np.zeros(window + 1, bool)
    has[present] = True
    pair = small[has[window - small]]
    rows.append(np.stack([np.zeros_like(pair), pair, window - pair], 1))
    for a in present[present <= window // 3].tolist():
        b = present[(present >= a) & (present <= (window - a) // 2)]
        b = b[has[window - a - b]]
        rows.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(rows)


def solve_counts(histogram: np.ndarray, combos: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts >= 0 of the combinations that come nearest to the histogram.

    Non-negative least squares by coordinate descent: each step sets one count to its best
    value, the others held. Pairs come first, so the solution stays sparse.
    """
    left = histogram.astype(float).tolist()
    counts = [0.0] * len(combos)
    listed = [[x for x in row if x] for row in combos.tolist()]
    for sweep in range(sweeps):
        for k, row in enumerate(listed):
            if sweep and not counts[k]:
                continue
            # A length that stands twice in a combination weighs four times.
            slope = norm = 0.0
            for x in row:
                slope += left[x]
            times = 1 if len(set(row)) == len(row) else 2
            norm = len(row) if times == 1 else sum(row.count(x) ** 2 for x in set(row))
            new = counts[k] + slope / norm
            new = new if new > 0 else 0.0
            step = new - counts[k]
            if step:
                counts[k] = new
                for x in row:
                    left[x] -= step
    return np.array(counts)


def plan_patterns(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, repeats), using each length exactly as often as it occurs."""
    left = histogram.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        patterns.append(((window,), int(left[window])))
        left[window] = 0
    present = np.flatnonzero(left)
    if len(present):
        combos = combinations(present, window)
        solved = solve_counts(left, combos)
        for k in np.argsort(-solved, kind="stable").tolist():
            repeats = int(solved[k])
            if repeats < 1:
                break
            row = [x for x in combos[k].tolist() if x]
            for x in set(row):
                repeats = min(repeats, int(left[x]) // row.count(x))
            if repeats > 0:
                patterns.append((tuple(row), repeats))
                for x in row:
                    left[x] -= repeats
    # Greedy on the residual: the longest piece, filled up with the longest that fit. A
    # pattern is repeated as often as the counts allow, so a step uses up a length.
    while True:
        present = np.flatnonzero(left)
        if not len(present):
            return patterns
        row, room = [], window
        free = left.copy()
        while room > 0:
            fits = present[: np.searchsorted(present, room, "right")]
            fits = fits[free[fits] > 0]
            if not len(fits):
                break
            longest = int(fits[-1])
            row.append(longest)
            free[longest] -= 1
            room -= longest
        repeats = min(int(left[x]) // row.count(x) for x in set(row))
        patterns.append((tuple(row), repeats))
        for x in row:
            left[x] -= repeats


class Part(NamedTuple):
    """Ids ``begin`` to ``begin + size`` of a piece, at ``offset`` in a group's ``sequence``."""

    sequence: int
    offset: int
    begin: int
    size: int


class Group(NamedTuple):
    """Pieces, by length, that fill a few sequences together; used ``repeats`` times."""

    pieces: list[tuple[int, list[Part]]]
    sequences: int
    repeats: int


def whole_group(row: tuple[int, ...], repeats: int) -> Group:
    ends = np.cumsum(row).tolist()
    return Group([(x, [Part(0, end - x, 0, x)]) for x, end in zip(row, ends, strict=True)], 1, repeats)


def cut_groups(left: np.ndarray, window: int = WINDOW, grain: int = GRAIN, most: int = GROUP) -> list[Group]:
    """Pieces of a histogram laid end to end, longest first, and cut where a sequence ends.

    Cuts lie at multiples of ``grain``, so less than that is lost at each. A group ends where
    a sequence is full without a cut, or after ``most`` sequences, and is repeated as often
    as the counts allow, so the plan has few groups however many pieces there are.
    """
    left = left.copy()
    groups: list[Group] = []
    while left.any():
        free = left.copy()
        pieces: list[tuple[int, list[Part]]] = []
        sequence, offset = 0, 0
        lengths = np.flatnonzero(free)[::-1].tolist()
        while lengths:
            length = lengths[0]
            free[length] -= 1
            if not free[length]:
                lengths.pop(0)
            room = window - offset
            if length <= room:
                parts = [Part(sequence, offset, 0, length)]
                offset += length
            else:
                cut = room // grain * grain
                parts = [Part(sequence, offset, 0, cut), Part(sequence + 1, 0, cut, length - cut)]
                sequence, offset = sequence + 1, length - cut
            pieces.append((length, parts))
            if window - offset < grain:
                break
            if sequence + 1 >= most:
                # The last sequence of the group takes whole pieces only.
                lengths = [x for x in lengths if x <= window - offset]
        used = np.bincount([x for x, _ in pieces], minlength=len(left))
        repeats = int((left[used > 0] // used[used > 0]).min())
        groups.append(Group(pieces, sequence + 1, repeats))
        left -= used * repeats
    return groups


def plan_groups(histogram: np.ndarray, window: int = WINDOW, grain: int = GRAIN) -> list[Group]:
    """The patterns that fill their sequence; the pieces of all others are cut."""
    groups, open_ = [], np.zeros(window + 1, np.int64)
    for row, repeats in plan_patterns(histogram, window):
        if window - sum(row) < grain:
            groups.append(whole_group(row, repeats))
        else:
            np.add.at(open_, list(row), repeats)
    return groups + cut_groups(open_, window, grain)


class Places:
    """Where the n-th piece of each length goes, as arrays of rank intervals.

    Takes groups, or patterns of whole pieces.
    """

    def __init__(self, plan: list[Group] | list[tuple[tuple[int, ...], int]], window: int = WINDOW):
        used = np.zeros(window + 1, np.int64)
        rows, base = [], 0
        for group in plan:
            if not isinstance(group, Group):
                group = whole_group(*group)
            for length, parts in group.pieces:
                first, second = parts[0], parts[1] if len(parts) > 1 else Part(0, 0, length, 0)
                rows.append(
                    (length, int(used[length]), group.sequences, base + first.sequence, first.offset)
                    + (first.size, base + second.sequence)
                )
                used[length] += group.repeats
            base += group.sequences * group.repeats
        table = np.array(sorted(rows), np.int64).reshape(-1, 7)
        self.sequences = base
        self.length, self.first, self.stride, self.base, self.offset, self.cut, self.next = table.T.copy()
        self.begin = np.searchsorted(self.length, np.arange(window + 2))

    def _interval(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        order = np.argsort(length, kind="stable")
        at = np.empty(len(length), np.int64)
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(own):
                lo, hi = self.begin[length[own[0]]], self.begin[length[own[0]] + 1]
                at[own] = lo + np.searchsorted(self.first[lo:hi], rank[own], "right") - 1
        return at

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, or of their first parts, by length and rank from 0."""
        at = self._interval(length, rank)
        return self.base[at] + (rank - self.first[at]) * self.stride[at], self.offset[at]

    def cuts(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids the first part of a piece has, and the sequence that begins with the others."""
        at = self._interval(length, rank)
        return self.cut[at], self.next[at] + (rank - self.first[at]) * self.stride[at]


# What a bit of a checksum becomes when 2**k more ids follow it; the checksum is linear but
# for its start, which the second term takes away.
_SHIFTS = [
    np.array([zlib.crc32(bytes(4 << k), 1 << bit) ^ zlib.crc32(bytes(4 << k)) for bit in range(32)], np.uint32)
    for k in range(16)
]


def crc_behind(before: np.ndarray, whole: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """Checksums of the last ``n_ids`` ids, from those of what is before and of the whole."""
    value = before.astype(np.uint32)
    for k, shift in enumerate(_SHIFTS):
        own = np.flatnonzero(n_ids >> k & 1)
        if len(own):
            old, new = value[own], np.zeros(len(own), np.uint32)
            for bit in range(32):
                new ^= np.where(old >> np.uint32(bit) & np.uint32(1), shift[bit], np.uint32(0))
            value[own] = new
    return whole.astype(np.uint32) ^ value


def _placed(places: Places):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy().astype(np.int64)
            sequence, offset = places.of(length, rank)
            cut, following = places.cuts(length, rank)
            start = batch.column("start").to_numpy().astype(np.int64)
            crc = batch.column("ids_crc32").to_numpy().astype(np.int64)
            parted = np.flatnonzero(cut < length)
            marks = batch.column("marks").take(pa.array(parted)).to_pylist()
            at = (cut[parted] // GRAIN * 4).tolist()
            before = np.array(
                [int.from_bytes(m[i : i + 4], "little") for m, i in zip(marks, at, strict=True)], np.uint32
            )
            rest = length[parted] - cut[parted]
            behind = crc_behind(before, crc[parted], rest).astype(np.int64)
            crc = crc.copy()
            crc[parted] = before
            rows = pa.array(np.concatenate([np.arange(len(length)), parted]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    pa.array(np.concatenate([start, start[parted] + cut[parted]])),
                    pa.array(np.concatenate([cut, rest])),
                    pa.array(np.concatenate([crc, behind])),
                    batch.column("doc_tokens").take(rows),
                    pa.array(np.concatenate([sequence, following[parted]])),
                    pa.array(np.concatenate([offset, np.zeros_like(rest)])),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return placed


def pack_documents(
    docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, window: int = WINDOW
) -> DataFrame:
    """Pieces of every row of (doc_id, text), packed into sequences of ``window`` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. Where no
    combination fills a sequence, the rest of a document is cut once more. A null or empty
    text is a piece of one id, the end. Repeated rows are documents of their own. Empty input
    gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
            _cut(tokenizer, end_id, window), _PIECES
        ),
        "pieces",
    )
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    # At most window * SALTS rows, whatever the input.
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    cells = saved(cells, "lengths")
    histogram = np.zeros(window + 1, np.int64)
    for row in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
        histogram[row["length"]] = row["n"]
    places = Places(plan_groups(histogram, window), window)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = (
        salted.withColumn("inside", inside)
        .join(F.broadcast(cells.select("length", "salt", before.alias("before"))), ["length", "salt"])
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "marks",
            (F.col("before") + F.col("inside")).alias("rank"),
        )
    )
    return ranked.mapInArrow(
        _placed(places),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
