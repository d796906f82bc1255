"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled, once and on the driver, into arrays that are shared
with all tasks: the normaliser (the model's own table of replacements; a space
becomes the piece mark, one mark comes first), the lexicon (a trie of the
pieces; a character that is no piece goes to its bytes) and, for merged
vocabularies, an acceptor of neighbours. Encoding composes them with the text
and takes the path of the least weight in the tropical semiring.

For vocabularies with unigram scores an arc weighs minus its piece's score.
For merged ones (BPE) an arc weighs nothing where the piece and the one before
are neighbours that merging alone would leave apart, and infinity otherwise:
a sequence of pieces is the result of all merges if and only if each two
neighbours are the result of theirs, so exactly one path has a finite weight,
and every prefix has one last piece.

A piece is compiled to the two symbols whose
merge made it, so the symbols that stand at a boundary, and when they did, are
the right spine of the left piece and the left spine of the right one. Two
pieces stay apart if and only if no two of these symbols that stood side by
side make a piece that would have been merged before either was used up. Pairs
with a piece whose own merges don't go by rank, for which this would not hold,
are few (pieces of spaces) and are merged instead.

No piece holds certain pairs of characters, so texts are cut between them. The
distinct chunks of a slice of texts are composed together, one position of each
at a time; chunks above ``LONG`` characters are composed alone. Nothing is kept
between slices but the arrays.

Defined results: a null text has null ids and decodes to null; an empty text
has no ids; control pieces in a text are ordinary characters; repeated rows are
treated alike; other columns pass through.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .arrow_words import add_columns, ranges
from .tables import NONE, PairTable, merge_pairs

MARK = "▁"
LONG = 256
SLICE = 1 << 20  # bytes of texts that are composed at a time
UNKNOWN_COST = 100.0  # of a character's bytes in unigram models, above any piece
NORMAL, UNKNOWN, BYTE = 1, 2, 6  # Fixed values: kinds of pieces in the model file
UNIGRAM, BPE = 1, 2  # Fixed values: kinds of models
_START, _OTHER, _OPEN = -1, -2, -3  # before a chunk; a character that no piece holds; not reached


def fields(blob: bytes):
    """(number, value) of a message in the wire format of protocol buffers."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = blob[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(blob):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, blob[at : at + n]
            at += n


def replacements(blob: bytes) -> dict[str, str]:
    """The rules of a compiled normaliser: a double-array trie over UTF-8, then the replacements, each ended by a zero byte."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
    below = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)  # noqa: E731  where a unit's children are, relative to it
    out, todo = {}, [(b"", below(units[0]))]
    while todo:
        prefix, base = todo.pop()
        for c in range(1, 256):
            at = base ^ c
            if at < len(units) and units[at] & 0x800000FF == c:
                word, child = prefix + bytes([c]), at ^ below(units[at])
                if units[at] >> 8 & 1:
                    start = units[child] & 0x7FFFFFFF
                    out[word.decode()] = texts[start : texts.index(0, start)].decode()
                todo.append((word, child))
    return out


class PieceTransducer:
    """The compiled machines. Symbols are pieces by id, then characters within pieces that are no pieces themselves."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = BPE, prefix: bool = True, rules: dict[str, str] | None = None, squeeze: bool = False):
        """``pieces``: (piece, score, kind of piece), by id. ``squeeze``: the normaliser drops spaces at the ends and after another."""
        self.kind, self.prefix, self.squeeze, self.rules = kind, prefix, squeeze, rules or {}
        self.longest_rule = max(map(len, self.rules), default=0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        said = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k == NORMAL else b"" for p, _, k in pieces]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_size = np.fromiter(map(len, said), np.int64, len(said))
        self.said_start = np.cumsum(self.said_size) - self.said_size
        own = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        symbols = dict(own)
        for p in own:
            for c in p:
                symbols.setdefault(c, len(pieces) + len(symbols) - len(own))
        self.weight = np.full(len(pieces), 0.0)
        self._known: dict[tuple[int, int], bool] = {}
        for p, i in own.items():
            self.weight[i] = -pieces[i][1]
        if kind == BPE:
            own = self._compile_neighbours(own, symbols, len(pieces))
        self._compile_lexicon(own, symbols)

    def _compile_neighbours(self, own: dict[str, int], symbols: dict[str, int], n_pieces: int) -> dict[str, int]:
        """When a symbol is made and of which two; the pieces that merging their characters gives."""
        n = n_pieces + len(symbols) - len(own)
        scores = [-self.weight[i] for i in own.values()]
        rank_of = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.time = np.full(n, -1, np.int32)  # characters are there from the start
        for p, i in own.items():
            if len(p) > 1:
                self.time[i] = rank_of[-self.weight[i]]
                for k in range(1, len(p)):
                    if (x := symbols.get(p[:k])) is not None and (y := symbols.get(p[k:])) is not None:
                        pairs[x, y] = (int(self.time[i]), i)
        a, b = np.asarray([*pairs], np.int64).reshape(-1, 2).T
        ranks, made = np.asarray([*pairs.values()], np.int32).reshape(-1, 2).T
        self.ranks, self.made = PairTable(a, b, ranks), PairTable(a, b, made)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        names = [p for p in own if len(p) > 1]
        kept = {p: i for p, i in own.items() if len(p) == 1}
        self.spelled = {i: [symbols[c] for c in p] for p, i in symbols.items()}
        for low, high in pairwise((1, 4, 8, 16, max(17, *map(len, names), 17))):
            some = [p for p in names if low < len(p) <= high]
            rows, size = self._rows([self.spelled[own[p]] for p in some])
            _, left, last = merge_pairs(rows, size, self.ranks, self.made)
            for p, m, (x, y) in zip(some, left.tolist(), last.tolist(), strict=True):
                if m == 1:  # else merging its characters never gives the piece
                    kept[p] = own[p]
                    self.left[own[p]], self.right[own[p]] = x, y
        # pieces whose own merges don't go by rank: spines don't tell when their symbols stood
        self.odd = np.zeros(n, bool)
        many = Counter(scores)
        self.odd[[i for p, i in own.items() if len(p) > 1 and many[-self.weight[i]] > 1]] = True
        for p in sorted(kept, key=len):
            if len(p) > 1:
                i = own[p]
                parts = [self.left[i], self.right[i]]
                self.odd[i] |= self.odd[parts].any() or self.time[i] <= self.time[parts].max()
        return kept

    @staticmethod
    def _rows(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        rows = np.zeros((len(lists), int(size.max(initial=0))), np.int32)
        rows[np.arange(rows.shape[1]) < size[:, None]] = [i for x in lists for i in x]
        return rows, size

    def _compile_lexicon(self, own: dict[str, int], symbols: dict[str, int]) -> None:
        states, edges = {"": 0}, []
        for p in own:
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    edges.append((states[p[: k - 1]], ord(p[k - 1]), states[p[:k]]))
        a, b, to = (np.asarray(x, np.int64) for x in zip(*edges, strict=True)) if edges else (np.empty(0, np.int64),) * 3
        self.next = PairTable(a, b, to.astype(np.int32), -1)
        self.piece = np.full(len(states), -1, np.int32)
        for p, i in own.items():
            self.piece[states[p]] = i
        self.longest = max(map(len, own), default=0)
        # characters by class: 0 where no piece of two characters and more holds it
        inner = sorted({c for p in own if len(p) > 1 for c in p})
        self.cls = np.zeros(0x110000, np.uint16)
        self.cls[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.together = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in own:
            for x, y in pairwise(p):
                self.together[self.cls[ord(x)], self.cls[ord(y)]] = True
        chars = {ord(p): i for p, i in symbols.items() if len(p) == 1}
        self.chars = PairTable(np.asarray([*chars], np.int64), np.zeros(len(chars), np.int64), np.asarray([*chars.values()], np.int32), _OTHER)

    @classmethod
    def load(cls, path: str) -> PieceTransducer:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, blob: bytes) -> PieceTransducer:
        pieces, kind, prefix, rules, squeeze = [], UNIGRAM, True, {}, True
        for number, value in fields(blob):
            inner = dict(fields(value)) if isinstance(value, bytes) else {}
            if number == 1:
                score = np.frombuffer(inner.get(2, b"\0\0\0\0"), "<f4")[0]
                pieces.append((inner[1].decode(), float(score), inner.get(3, NORMAL)))
            elif number == 2:
                kind = inner.get(3, UNIGRAM)
            elif number == 3:
                prefix, squeeze, rules = bool(inner.get(3, 1)), bool(inner.get(4, 1)), replacements(inner.get(2, b""))
                if not inner.get(5, 1):
                    raise ValueError("a normaliser that keeps spaces")
        return cls(pieces, kind, prefix, rules, squeeze)

    def normal(self, text: str) -> str:
        """The normaliser: the longest rule at each place, then marks for spaces and one in front."""
        if self.rules:
            out, at = [], 0
            while at < len(text):
                for k in range(min(self.longest_rule, len(text) - at), 0, -1):
                    if (new := self.rules.get(text[at : at + k])) is not None:
                        out.append(new)
                        at += k
                        break
                else:
                    out.append(text[at])
                    at += 1
            text = "".join(out)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        return ((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else ""

    def apart(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether merging leaves the pieces of each pair as they are: both spines are undone, what was made last first."""
        out = np.ones(len(before), bool)
        there = before >= 0  # nothing is merged with the start, or with a character that no piece holds
        odd = there & (self.odd[before] | self.odd[after])
        if odd.any():
            out[odd] = self._apart_by_merging(before[odd], after[odd])
        todo = np.flatnonzero(there & ~odd)
        x, y = before[todo].astype(np.int32), after[todo].astype(np.int32)
        used_x, used_y = np.full(len(todo), NONE), np.full(len(todo), NONE)  # when each symbol was used up
        while len(todo):
            rank = self.ranks.get(x, y)
            merged = (rank < used_x) & (rank <= used_y)  # of equals the left one is merged first
            out[todo[merged]] = False
            made_x, made_y = self.time[x], self.time[y]
            going = ~merged & ((made_x >= 0) | (made_y >= 0))
            todo, x, y, used_x, used_y, made_x, made_y = (v[going] for v in (todo, x, y, used_x, used_y, made_x, made_y))
            undo = made_x > made_y
            used_x, used_y = np.where(undo, made_x, used_x), np.where(undo, used_y, made_y)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return out

    def _apart_by_merging(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        both, at = np.unique(np.stack([before, after], 1), axis=0, return_inverse=True)
        rows, size = self._rows([self.spelled[x] + self.spelled[y] for x, y in both.tolist()])
        merged, left, _ = merge_pairs(rows, size, self.ranks, self.made)
        return ((left == 2) & (merged[:, :2] == both).all(axis=1))[at.ravel()]

    def _arcs(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece in the chunks; ``ends``: where the chunk of each character ends."""
        at = np.arange(len(points))
        state, found = np.zeros(len(points), np.int32), []
        for k in range(self.longest):
            inside = at + k < ends[at]
            at, state = at[inside], state[inside]
            state = self.next.get(state, points[at + k])
            going = state >= 0
            at, state = at[going], state[going]
            if not len(at):
                break
            piece = self.piece[state]
            some = piece >= 0
            found.append((at[some], at[some] + k + 1, piece[some]))
        return tuple(np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in range(3))

    def paths(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of the least path of each chunk, one after the other, how many each has). A negative symbol stands for a character, -1 - it."""
        n = len(bounds) - 1
        length = np.diff(bounds)
        start, end, piece = self._arcs(points, np.repeat(bounds[1:], length))
        # states: one before and one behind each character of a chunk
        chunk = np.repeat(np.arange(n), length)
        base = bounds[:-1] + np.arange(n)
        i, j = start + chunk[start], end + chunk[start]
        step = start - bounds[:-1][chunk[start]]
        order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 65536 else step, kind="stable")
        i, j, piece = i[order], j[order], piece[order]
        cuts = np.searchsorted(step[order], np.arange(int(length.max(initial=0)) + 1))
        cost, last = np.full(len(points) + n, np.inf), np.full(len(points) + n, _OPEN, np.int32)
        cost[base], last[base] = 0.0, _START
        back = np.zeros(len(points) + n, np.int64)
        by_length = np.argsort(-length, kind="stable")
        going = np.searchsorted(-length[by_length], -np.arange(int(length.max(initial=0))), side="left")
        for s, (low, high) in enumerate(pairwise(cuts.tolist())):
            a, b, p = i[low:high], j[low:high], piece[low:high]
            if self.kind == BPE:
                free = last[b] == _OPEN  # a path of weight 0 can't be bettered
                a, b, p = a[free], b[free], p[free]
                ok = self.apart(last[a], p)
                total = np.zeros(int(ok.sum()))
                a, b, p = a[ok], b[ok], p[ok]
            else:
                total = cost[a] + self.weight[p]
                ok = total < cost[b]
                a, b, p, total = a[ok], b[ok], p[ok], total[ok]
            cost[b], last[b], back[b] = total, p, a
            here = base[by_length[: going[s]]] + s
            bare = here[last[here + 1] == _OPEN]
            if len(bare):  # no piece ends here: the character's bytes
                c = points[bare - np.searchsorted(base, bare, side="right") + 1]
                cost[bare + 1], back[bare + 1] = cost[bare] + UNKNOWN_COST, bare
                last[bare + 1] = self.chars.get(c, np.zeros(len(c), np.int64))
        at, owner, out = base + length, np.arange(n), []
        while len(at):
            more = at > base[owner]
            at, owner = at[more], owner[more]
            out.append((owner, at))
            at = back[at]
        owner, at = (np.concatenate([o[k] for o in out] or [np.empty(0, np.int64)]) for k in (0, 1))
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        symbol = last[at].astype(np.int64)
        bare = (symbol < 0) | (symbol >= len(self.weight))
        symbol[bare] = -1 - points[at[bare] - 1 - owner[bare]].astype(np.int64)
        return symbol, np.bincount(owner, minlength=n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; their bounds)."""
        plain = not self.rules and not self.squeeze
        if plain:
            made = [(MARK + t if self.prefix else t) if t else "" for t in texts]
        else:
            made = list(map(self.normal, texts))
        points = np.frombuffer("".join(made).encode("utf-32-le"), np.uint32)
        if plain:
            points = np.where(points == 32, np.uint32(ord(MARK)), points)
        text_bounds = np.cumsum([0, *map(len, made)])
        if not len(points):
            return np.empty(0, np.int32), text_bounds
        cls = self.cls[points]
        first = np.ones(len(points), bool)
        first[1:] = ~self.together[cls[:-1], cls[1:]]
        first[text_bounds[:-1][np.diff(text_bounds) > 0]] = True
        starts = np.append(np.flatnonzero(first), len(points))
        raw = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64) * 4), pa.py_buffer(np.ascontiguousarray(points, "<u4"))])
        coded = pc.dictionary_encode(raw)
        codes, chunks = coded.indices.to_numpy(), coded.dictionary
        flat = np.frombuffer(chunks.buffers()[2], "<u4") if chunks.buffers()[2] else np.empty(0, np.uint32)
        bounds = np.frombuffer(chunks.buffers()[1], np.int64)[: len(chunks) + 1] // 4
        flat, long = flat[: bounds[-1]], np.diff(bounds) > LONG
        symbols, count = self._composed(flat, bounds, long)
        ids, size = self._ids(symbols)
        per_symbol = np.concatenate([[0], np.cumsum(size)])
        ends = per_symbol[np.concatenate([[0], np.cumsum(count)])]
        lengths = np.diff(ends)[codes]
        out = ids[ranges(ends[:-1][codes], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        out_bounds = total[np.searchsorted(starts, text_bounds)]
        if not self.bytes:  # characters that are no pieces are one unknown piece in a row
            again = np.zeros(len(out), bool)
            again[1:] = (out[1:] == self.unknown) & (out[:-1] == self.unknown)
            again[out_bounds[:-1][np.diff(out_bounds) > 0]] = False
            out_bounds = np.concatenate([[0], np.cumsum(~again)])[out_bounds]
            out = out[~again]
        return out, out_bounds

    def _composed(self, flat: np.ndarray, bounds: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The paths of all chunks; long ones alone, so a step of one position isn't taken for all."""
        if not long.any():
            return self.paths(flat, bounds)
        size = np.diff(bounds)
        count, parts = np.zeros(len(size), np.int64), []
        short = np.flatnonzero(~long)
        groups = [(short, *self.paths(flat[ranges(bounds[short], size[short])], np.concatenate([[0], np.cumsum(size[short])])))]
        for k in np.flatnonzero(long):
            symbols = np.asarray(self.path_alone(flat[bounds[k] : bounds[k + 1]]), np.int64)
            groups.append((np.asarray([k]), symbols, np.asarray([len(symbols)])))
        for own, _, many in groups:
            count[own] = many
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for own, symbols, many in groups:
            out[ranges(start[own], many)] = symbols
        return out, count

    def path_alone(self, points: np.ndarray) -> list[int]:
        """The least path of one chunk, as ``paths`` gives it, for any length."""
        n = len(points)
        start, end, piece = self._arcs(points, np.full(n, n))
        order = np.lexsort((end, start))
        arcs = zip(start[order].tolist(), end[order].tolist(), piece[order].tolist(), strict=True)
        own = self.chars.get(points, np.zeros(n, np.int64)).tolist()
        cost, last, back = [0.0] + [np.inf] * n, [_START] + [_OPEN] * n, [0] * (n + 1)
        arc = next(arcs, None)
        for s in range(n):
            while arc and arc[0] == s:
                _, e, p = arc
                if self.kind != BPE:
                    total = cost[s] + self.weight[p]
                else:
                    total = 0.0 if last[e] == _OPEN and self._apart(last[s], p) else np.inf
                if total < cost[e]:
                    cost[e], last[e], back[e] = total, p, s
                arc = next(arcs, None)
            if last[s + 1] == _OPEN:
                cost[s + 1], last[s + 1], back[s + 1] = cost[s] + UNKNOWN_COST, own[s], s
        out, at = [], n
        while at:
            out.append(last[at] if 0 <= last[at] < len(self.weight) else -1 - int(points[at - 1]))
            at = back[at]
        return out[::-1]

    def _apart(self, before: int, after: int) -> bool:
        """``apart`` for one pair; what was found is kept for the chunk's other places."""
        if (out := self._known.get((before, after))) is None:
            if len(self._known) > 100_000:
                self._known.clear()
            out = self._known[before, after] = bool(self.apart(np.asarray([before]), np.asarray([after]))[0])
        return out

    def _ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of symbols, how many each has): a piece is one, a character those of its bytes."""
        size = np.ones(len(symbols), np.int64)
        bare = np.flatnonzero(symbols < 0)
        if not len(bare):
            return symbols.astype(np.int32), size
        which, at = np.unique(symbols[bare], return_inverse=True)
        spelled = [[self.bytes[b] for b in chr(-1 - c).encode()] if self.bytes else [self.unknown] for c in which.tolist()]
        size[bare] = np.asarray([*map(len, spelled)])[at]
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        pieces = symbols >= 0
        out[start[pieces]] = symbols[pieces]
        flat = np.asarray([i for x in spelled for i in x], np.int32)
        begin = np.cumsum([0, *map(len, spelled)])[:-1]
        out[ranges(start[bare], size[bare])] = flat[ranges(begin[at], size[bare])]
        return out, size

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids: bytes as UTF-8, marks as spaces, without the one that comes first."""
        size = self.said_size[ids]
        raw = self.said[ranges(self.said_start[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
        texts = (raw[a:b].decode("utf-8", "replace") for a, b in pairwise(ends))
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=2)
def _broadcast(spark: SparkSession, model_path: str, changed: float) -> Broadcast:
    return spark.sparkContext.broadcast(PieceTransducer.load(model_path))


def _shared(df: DataFrame, model_path: str) -> Broadcast:
    """The machine of a model file, one for all that encodes and decodes with it."""
    return _broadcast(df.sparkSession, model_path, os.path.getmtime(model_path))


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (array of int)."""
    shared = _shared(docs, model_path)

    def make(texts: pa.Array) -> list[pa.Array]:
        ids, bounds = shared.value.encode(pc.fill_null(texts, "").to_pylist())
        return [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()), mask=texts.is_null())]

    return add_columns(docs, text, "ids array<int>", make, SLICE)


def decode_pieces(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with decoded (the text of its ids)."""
    shared = _shared(encoded, model_path)

    def make(rows: pa.Array) -> list[pa.Array]:
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(rows.flatten(), shared.value.unknown).to_numpy(zero_copy_only=False)
        texts = shared.value.decode(flat, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
        return [pa.array(texts, pa.string(), mask=rows.is_null().to_numpy(zero_copy_only=False))]

    return add_columns(encoded, ids, "decoded string", make, SLICE)
