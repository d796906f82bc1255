"""Packing of token sequences by exact complements, then best fit.

Only counts of lengths decide which lengths share a sequence, so the plan is
made on the driver from ``capacity`` numbers, whatever the input. For each
length, longest first, an index of single, pair and triple length sums is asked
for what fills its gap exactly; the combination is consumed as often as the
counts of its lengths allow. What finds no complement is packed best-fit
decreasing, whole groups of equal sequences at a time. Pieces then take their
places by their rank among the pieces of their length.

The plan is broadcast. Each step of it uses up a length, or opens or closes a
group, so its runs are bounded by the capacity, whatever the input:
``RUNS`` times the capacity is asserted.

Defined results: a null or empty text has the end token alone; a text is cut
into pieces of ``capacity`` and its last piece may be shorter; a null id stays
null; ids keep the type that they have; repeated rows are packed each; an empty
table gives no pieces. Columns other than the id and the text aren't in the
result, so their names can't clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_words import slices
from .dense import dense_positions, part_counts
from .storage import written
from .token_ids import tokenizer_of

RUNS = 64
Runs = tuple[tuple[int, int], ...]  # (length, times)


class SumIndex:
    """Which sums of one, two and three available lengths there are."""

    def __init__(self, counts: list[int]):
        self.counts, self.size = counts, len(counts)
        self.present = sum(1 << n for n, c in enumerate(counts) if c)
        self._pairs: int | None = None

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for n in lengths:
            self.counts[n] -= times
            if not self.counts[n]:
                self.drop(n)

    def drop(self, n: int) -> None:
        self.present &= ~(1 << n)
        self._pairs = None

    def often(self, lengths: tuple[int, ...]) -> int:
        return min(self.counts[n] // lengths.count(n) for n in lengths)

    def pair(self, total: int, above: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths of that sum, the longer one as long as can be, available together with ``above``."""
        backwards = int(f"{self.present & ((1 << total) - 1):0{total}b}"[::-1], 2) << 1 if total > 0 else 0
        both = self.present & backwards  # n is in both if n and total - n are available
        while both:
            n = both.bit_length() - 1
            if 2 * n < total:
                return None
            if self.often((*above, n, total - n)):
                return n, total - n
            both &= ~(1 << n)
        return None

    def pairs(self) -> int:
        """Bits of all sums of two lengths, an over-estimate where one length is there once."""
        if self._pairs is None:
            out, rest = 0, self.present
            while rest:
                low = rest & -rest
                out |= self.present << (low.bit_length() - 1)
                rest ^= low
            self._pairs = out & ((1 << self.size) - 1)
        return self._pairs

    def filling(self, gap: int, own: int, most: int) -> tuple[int, ...] | None:
        """The fewest lengths, up to ``most``, that fill the gap exactly beside a piece of length ``own``."""
        if not most:
            return None
        if gap < self.size and self.present >> gap & 1 and self.often((own, gap)):
            return (gap,)
        if most > 1 and (two := self.pair(gap, (own,))):
            return two
        if most < 3:
            return None
        sums, rest = self.pairs(), self.present & ((1 << max(gap, 0)) - 1)
        while rest:
            n = rest.bit_length() - 1
            if 3 * n < gap:
                return None
            rest &= ~(1 << n)
            if sums >> (gap - n) & 1 and self.often((own, n)) and (two := self.pair(gap - n, (own, n))):
                return (n, *two)
        return None


def _runs(lengths: list[int]) -> Runs:
    out: list[list[int]] = []
    for n in lengths:
        if out and out[-1][0] == n:
            out[-1][1] += 1
        else:
            out.append([n, 1])
    return tuple((n, k) for n, k in out)


def exact_plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[int, Runs]]:
    """Exact combinations of up to 1 + ``most`` pieces, then best fit of the rest."""
    left = [counts.get(n, 0) for n in range(capacity + 1)]
    out: list[tuple[int, Runs]] = []
    if left[capacity]:
        out.append((left[capacity], ((capacity, 1),)))
        left[capacity] = 0
    index, residual = SumIndex(left), {}
    for own in range(capacity - 1, 0, -1):
        while left[own]:
            found = index.filling(capacity - own, own, most)
            if not found:
                residual[own], left[own] = left[own], 0
                index.drop(own)
                break
            times = index.often((own, *found))
            index.take((own, *found), times)
            out.append((times, _runs([own, *found])))
    return out + best_fit(residual, capacity)


def plans(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, Runs]]]:
    """The plans with triples (3), with pairs (2) and with single complements (1) at most, by the sequences they need.

    Long combinations can use up short pieces that would have closed other
    gaps, so shorter ones may need fewer sequences. Of equal plans that with
    the longer combinations comes first.
    """
    every = {most: exact_plan(counts, capacity, most) for most in (3, 2, 1)}
    return dict(sorted(every.items(), key=lambda p: sum(many for many, _ in p[1])))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, Runs]]:
    """(number of sequences, the lengths in each) for so many pieces of each length: the first of ``plans``."""
    return next(iter(plans(counts, capacity).values()))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Runs]]:
    """Best-fit decreasing of groups: each piece goes where it leaves the least room."""
    room: list[int] = []  # the rooms of open groups, sorted
    groups: dict[int, list[list]] = {}

    def put(space: int, many: int, runs: Runs) -> None:
        if space not in groups:
            groups[space] = []
            insort(room, space)
        groups[space].append([many, runs])

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            at = bisect_left(room, n)
            if at == len(room):
                space, many, runs = capacity, todo, ()
            else:
                space = room[at]
                many, runs = groups[space].pop()
                if not groups[space]:
                    del groups[space], room[at]
            each = min(space // n, todo)
            used = min(many, todo // each)
            put(space - each * n, used, (*runs, (n, each)))
            todo -= used * each
            if runs and many > used:
                put(space, many - used, runs)
    return [(many, runs) for space in groups for many, runs in groups[space]]


def places(planned: list[tuple[int, Runs]]) -> tuple[np.ndarray, np.ndarray]:
    """(first, fields) of runs of ranks: first is length << 40 | rank; fields are the rank, the first sequence, times in a sequence and offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for many, runs in planned:
        offset = 0
        for n, times in runs:
            at = used.get(n, 0)
            rows.append((n << 40 | at, at, sequence, times, offset))
            used[n] = at + many * times
            offset += n * times
        sequence += many
    rows.sort()
    table = np.asarray(rows, np.int64).reshape(-1, 5)
    return table[:, 0].copy(), table[:, 1:].copy()


PIECE = "doc_id {}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, doc_id: str, text: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every text: doc_id, piece, start, length and the crc of its ids (little-endian, 32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        for batch in slices(batches, "text"):
            ids, bounds = tokenizer.ids(batch.column("text"), end_id)
            lengths = np.diff(bounds)
            cuts = -(-lengths // capacity)
            owner = np.repeat(np.arange(len(lengths)), cuts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            size = np.minimum(capacity, lengths[owner] - start)
            begin = bounds[:-1][owner] + start
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(view[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, PIECE.format(own.schema["doc_id"].dataType.simpleString()))


def best_fit_packing(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    # repeated rows spread too, by where they stand; written, so it is the same for all that reads it
    spread = F.xxhash64("doc_id", "piece").bitwiseXOR(F.monotonically_increasing_id())
    pieces = written(token_pieces(docs, tokenizer_path, doc_id, text, capacity, end_id).withColumn("spread", spread), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    placed = places(plan(counts, capacity))
    if len(placed[0]) > RUNS * capacity:
        raise AssertionError("the plan grows with the input")
    shared = docs.sparkSession.sparkContext.broadcast(placed)
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32", "spread")]
    ranked = dense_positions(pieces, "length", order, F.col("spread"), part_counts(counts), "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, fields = shared.value
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = fields[np.searchsorted(first, n << 40 | rank, side="right") - 1]
            ahead = rank - row[:, 0]
            sequence, offset = row[:, 1] + ahead // row[:, 2], row[:, 3] + ahead % row[:, 2] * n
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECE.format(pieces.schema["doc_id"].dataType.simpleString()) + ", sequence_id long, offset long")
