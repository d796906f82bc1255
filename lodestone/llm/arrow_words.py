"""Texts of Arrow batches as flat arrays of word codes.

Words are maximal runs of characters other than ASCII white space. Batches are
handled in slices of bounded size, so memory doesn't grow with a partition; a
single text longer than the bound is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 3 << 20
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library than glibc
        return lambda pad: 0


def give_back() -> None:
    """Return the memory of freed arrays to the system: workers live on, and others run beside them."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES, least: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a slice hold ``limit`` bytes at most, each taken as ``least`` or more."""
    for batch in batches:
        column = batch.column(text)
        length = pc.multiply(pc.list_value_length(column), 8) if pa.types.is_list(column.type) else pc.binary_length(column)
        sizes = np.cumsum(np.maximum(least, pc.fill_null(length, 0).to_numpy(zero_copy_only=False)), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
        give_back()


def flat_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, the distinct words, offsets of the texts in the codes)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    words, bounds = lists.flatten(), lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = pc.dictionary_encode(words.filter(full))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, before[bounds]


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same on every machine."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    ends = np.cumsum(lengths)
    out = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


def fresh(name: str, columns: list[str]) -> str:
    """The name, longer by underscores until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keeping(docs, added, apply):
    """``apply(docs)`` with the columns of ``docs`` alone, as they are there: those named as one of ``added`` go round the operator."""
    taken = {a.lower() for a in added}
    names, used = {}, [*docs.columns, *added]
    for c in docs.columns:
        if c.lower() in taken:
            names[c] = fresh(f"{c}_", used)
            used.append(names[c])
    out = apply(docs.withColumnsRenamed(names))
    return out.select(*(out[names.get(c, c)].alias(c) for c in docs.columns))


def add_columns(df, text: str, fields: str, make, limit: int = SLICE_BYTES, least: int = 128):
    """``df`` with the columns of the DDL ``fields`` that ``make(texts)`` returns, in that order.

    Other columns pass through; those of the same name as a new one are replaced.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    kept = [c for c in df.columns if c.lower() not in new.names]
    column = fresh("_source", df.columns) if text.lower() in new.names else text
    source = df.select(*kept, df[text].alias(column)) if column != text else df.select(*kept)
    schema = StructType([*(f for f in source.schema if f.name in kept), *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, limit, least):
            made = make(batch.column(column))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *new.names])

    return source.mapInArrow(run, schema)
