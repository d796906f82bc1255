"""Lookups of whole arrays: a hash table of pairs of numbers, and merging of symbol pairs over it."""

from __future__ import annotations

import numpy as np

NONE = np.int32(0x7FFFFFFF)  # above all ranks
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_M = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """A whole number for each of some pairs (a, b) of numbers below 2^31; open addressing, looked up for arrays at once."""

    def __init__(self, a: np.ndarray, b: np.ndarray, values: np.ndarray, default: int = int(NONE)):
        keys = self._key(a, b)
        self.bits, self.default = max(4, (2 * len(keys)).bit_length()), default
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.full(1 << self.bits, default, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == _EMPTY]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (np.asarray(a).astype(np.uint64) << np.uint64(32)) | np.asarray(b).astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _M) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs' numbers; ``default`` for a pair that isn't there."""
        keys = self._key(a, b)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(self.default))
        todo = np.flatnonzero((there != keys) & (there != _EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != _EMPTY)]
        return out


def merge_pairs(symbols: np.ndarray, sizes: np.ndarray, ranks: PairTable, results: PairTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All merges of many short strings at once: in each the pair of the least rank, the leftmost of equals, until none is left.

    ``symbols``: a row for each string, of which the first ``sizes`` columns
    count; ``results``: the symbol that each pair makes. Gives the symbols and
    sizes that are left, and the two symbols that were merged last in each.
    """
    symbols, sizes = symbols.astype(np.int32), sizes.astype(np.int64).copy()
    out, last = symbols.copy(), np.full((len(symbols), 2), -1, np.int32)
    if symbols.shape[1] < 2:
        return out, sizes, last
    inside = np.arange(symbols.shape[1] - 1) < (sizes - 1)[:, None]
    rank = np.full(inside.shape, NONE, np.int32)
    rank[inside] = ranks.get(symbols[:, :-1][inside], symbols[:, 1:][inside])
    row, now = np.arange(len(symbols)), symbols
    while True:
        at = rank.argmin(axis=1)
        best = rank[np.arange(len(row)), at]
        going = best < NONE
        done = row[~going]
        out[done, : now.shape[1]] = now[~going]
        row, now, rank, at = row[going], now[going], rank[going], at[going]
        if not len(row):
            return out, sizes, last
        each = np.arange(len(row))
        last[row, 0], last[row, 1] = now[each, at], now[each, at + 1]
        keep = np.arange(now.shape[1] - 1)
        now = np.where(keep <= at[:, None], now[:, :-1], now[:, 1:])
        now[each, at] = results.get(last[row, 0], last[row, 1])
        sizes[row] -= 1
        keep = keep[:-1]
        rank = np.where(keep < at[:, None], rank[:, :-1], rank[:, 1:])
        if not rank.shape[1]:
            rank = np.full((len(row), 1), NONE, np.int32)
            continue
        for side in (at - 1, at):
            ok = np.flatnonzero((side >= 0) & (side < sizes[row] - 1))
            rank[ok, side[ok]] = ranks.get(now[ok, side[ok]], now[ok, side[ok] + 1])
        # the pair behind the last symbol is none
        ended = np.flatnonzero((at >= sizes[row] - 1) & (at < rank.shape[1]))
        rank[ended, at[ended]] = NONE
