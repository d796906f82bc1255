"""Packed token-id matrices by best-fit decreasing with a segment tree.

Each task tokenises its documents, cuts overlong ones into pieces of
``capacity`` without losing a token, and packs the pieces of up to ``window``
tokens at a time: longest first, each into the open row with the least room
that holds it. A segment tree over the possible rooms finds that row in
log2(capacity) steps. Rows are written as they will be read in training: ids
(little-endian, padded to the capacity), cumulative segment lengths and
positions that restart with every segment.

Nothing is shuffled, and a task holds one window of tokens at most, plus the
longest document. Row ids count within a task's partition.

Defined results: a null or empty text is its end token; a null id stays null in
its rows; ids keep the type that they have; repeated rows are packed each, and
pieces of equal lengths in the order of their rows; an empty table gives no
rows. Columns other than the id and the text aren't in the result, so their
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_words import slices
from .token_ids import tokenizer_of

ROW = "row_id long, n_tokens int, doc_ids array<{}>, starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"


class RoomTree:
    """Counts of open rows by room, 0 to ``most``; finds the least room of some size at least."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def at_least(self, room: int) -> int | None:
        at, count = room + self.leaves, self.count
        if count[at]:
            return room
        while at > 1:
            if not at & 1 and count[at + 1]:  # the right sibling holds the next larger rooms
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not count[2 * at])
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of indices of pieces."""
    tree, open_rows, rows = RoomTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.at_least(n)
        if room is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        open_rows[room - n].append(row)
        tree.add(room - n, 1)
    return rows


def token_matrix(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, pad_id: int = 0, dtype: str = "<u2", window: int = 4 << 20) -> DataFrame:
    """The packed rows of all documents. ``dtype``: of ids and positions."""

    def packed(docs_of: list, ids: list[np.ndarray], first_row: int, id_type: pa.DataType) -> pa.RecordBatch:
        owner, start, pieces = [], [], []
        for d, tokens in zip(docs_of, ids, strict=True):
            for s in range(0, len(tokens), capacity):
                owner.append(d)
                start.append(s)
                pieces.append(tokens[s : s + capacity])
        rows = best_fit_decreasing(np.fromiter(map(len, pieces), np.int64, len(pieces)), capacity)
        out: list[list] = [[] for _ in range(7)]
        for k, row in enumerate(rows):
            sizes = [len(pieces[i]) for i in row]
            matrix, positions = np.full(capacity, pad_id, dtype), np.zeros(capacity, dtype)
            ends = np.cumsum(sizes)
            matrix[: ends[-1]] = np.concatenate([pieces[i] for i in row])
            positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            made = (first_row + k, int(ends[-1]), [owner[i] for i in row], [start[i] for i in row], [0, *ends.tolist()], matrix.tobytes(), positions.tobytes())
            for column, x in zip(out, made, strict=True):
                column.append(x)
        kinds = [pa.int64(), pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = ["row_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "position_ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        if tokenizer.size - 1 > np.iinfo(dtype).max:
            raise ValueError(f"ids up to {tokenizer.size - 1} don't fit {dtype}")
        docs_of, held, size, row = [], [], 0, TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            ids, bounds = tokenizer.ids(batch.column("text"), end_id)
            ids = ids.astype(dtype)
            docs_of += batch.column("doc_id").to_pylist()
            id_type = batch.column("doc_id").type
            held += [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            size += len(ids)
            if size >= window:
                yield (out := packed(docs_of, held, row, id_type))
                row += out.num_rows
                docs_of, held, size = [], [], 0
        if held:
            yield packed(docs_of, held, row, id_type)

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, ROW.format(own.schema["doc_id"].dataType.simpleString()))
