"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut
greedily into the longest phrases that occur in a language's labelled text;
the language that needs the fewest phrases, times the logarithm of the length
of its labelled text, wins. A character that the labelled text lacks counts as
two phrases, an escape and itself. Ties go to the first language by name.

Texts are lower-cased, runs of other characters than letters count as one
space. Whole texts are parsed as one: all blocks of ``BLOCK`` characters of many
texts are parsed together, one character of each at a time, as if each began a
text; then the states in which blocks truly begin are carried on, until both
parses of a block stand in the same state, from where on they agree.

The labelled text is bounded: that of the ``max_languages`` languages with the
most labelled documents, per language the ``sample_docs`` documents with the
least hashes, and ``sample_chars`` characters of them at most. The automata are
lists of edges in a hash table, so letters of large scripts cost no more room
than others: about 100 bytes for each character of labelled text.

Defined results: ``und`` and score 0 where the text is null or has no letter,
or where no labelled text was given; other columns pass through, and those
named as the added ones are replaced; repeated rows are treated alike; a null
doc_id counts as held out.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow_words import add_columns
from .tables import PairTable

BLOCK = 1024
SLICE = 3 << 19  # bytes of texts that are parsed at a time
UNKNOWN = "und"
ADDED = ("lang_pred", "score", "known_letters")


def crc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(parts))


def letters_only(text: str) -> str:
    """Lower case, every run of other characters one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton of all substrings of ``text``; state 0 is the start."""
    edges: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in edges[at]:
            edges[at][c] = new
            at = link[at]
        if at >= 0:
            to = edges[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(edges)
                edges.append(dict(edges[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and edges[at].get(c) == to:
                    edges[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return edges


class CrossParser:
    """The automata of all languages in one table of edges.

    A step gives the next state, times 4, plus the phrases that end with it:
    one where the phrase so far can't be longer, two more where the character
    is in no phrase of the language.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.alphabet = sorted({c for s in samples.values() for c in s} | {" "})
        width = len(self.alphabet) + 1  # the last class: letters that are in no sample
        code = {c: i for i, c in enumerate(self.alphabet)}
        self.roots = np.zeros((len(self.languages), 1), np.int32)
        self.begin = np.zeros((len(self.languages), width), np.int32)  # the step of a character that begins a phrase
        self.factor = [log2(len(samples[name]) + 2) for name in self.languages]
        state, letter, to, base = [], [], [], 0
        for k, name in enumerate(self.languages):
            edges = suffix_automaton(samples[name])
            self.roots[k] = base
            self.begin[k] = base * 4 + 2
            for c, x in edges[0].items():
                self.begin[k, code[c]] = (base + x) * 4
            for s, out in enumerate(edges):
                for c, x in out.items():
                    state.append(base + s)
                    letter.append(code[c])
                    to.append((base + x) * 4)
            base += len(edges)
        self.edges = PairTable(np.asarray(state, np.int64), np.asarray(letter, np.int64), np.asarray(to, np.int32), -1)

    def classes(self) -> np.ndarray:
        """The class of every code point: letters by their lower case, all else a space."""
        out = np.full(0x110000, self.alphabet.index(" "), np.uint16)
        code = {c: i for i, c in enumerate(self.alphabet)}
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                out[i] = code.get(c.lower(), len(self.alphabet))
        return out

    def step(self, language: np.ndarray, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        got = self.edges.get(state, codes)
        ends = got < 0
        # a phrase that ends before the character, if there is one, and the character's own step
        again = self.begin[language, codes] + (state != self.roots[language, 0])
        return np.where(ends, again, got)

    def phrases(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases (languages x texts) of texts that are ranges of ``codes``."""
        lengths = np.diff(bounds)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(lengths)), blocks)
        first = np.cumsum(blocks) - blocks
        start = bounds[:-1][owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        size = np.minimum(BLOCK, bounds[1:][owner] - start)
        n_langs, n = len(self.languages), len(owner)
        language = np.repeat(np.arange(n_langs), n)
        start, size = np.tile(start, n_langs), np.tile(size, n_langs)
        final, count = self._parsed(codes, language, self.roots[language, 0], start, size)
        # blocks that begin within a phrase: both parses go on side by side until they agree
        follows = np.tile(np.concatenate([owner[1:] == owner[:-1], np.zeros(min(1, n), bool)]), n_langs)
        alone, final = final, final.copy()
        changed = np.zeros(len(language), np.int64)  # by how much the entering state changes a block's phrases
        todo = np.flatnonzero(follows & (final != self.roots[language, 0])) + 1
        while len(todo):
            end, more = self._joined(codes, language[todo], final[todo - 1], start[todo], size[todo])
            changed[todo] = more
            end = np.where(end >= 0, end, alone[todo])
            moved = end != final[todo]
            final[todo[moved]] = end[moved]
            todo = todo[moved & follows[todo]] + 1
        count += changed
        count += (final != self.roots[language, 0]) & ~follows
        out = np.zeros((n_langs, len(lengths)), np.int64)
        for k in range(n_langs):
            out[k] = np.bincount(owner, count[k * n : (k + 1) * n], len(lengths))
        return out

    def _parsed(self, codes: np.ndarray, language: np.ndarray, state: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the last state of each block, the phrases that end in it)."""
        order = np.argsort(-size, kind="stable")
        language, state, start, size = language[order], state[order].copy(), start[order], size[order]
        count = np.zeros(len(order), np.int64)
        going = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for t, n in enumerate(going):
            step = self.step(language[:n], state[:n], codes[start[:n] + t])
            count[:n] += step & 3
            state[:n] = step >> 2
        back = np.argsort(order, kind="stable")
        return state[back], count[back]

    def _joined(self, codes: np.ndarray, language: np.ndarray, state: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the last state of each block, or -1 where the parse from the root is joined before; by how many phrases it differs from that one)."""
        end, more = np.full(len(state), -1, np.int32), np.zeros(len(state), np.int64)
        own, x, y = np.arange(len(state)), state.copy(), self.roots[language, 0]
        for t in range(BLOCK):
            ended = size[own] <= t
            end[own[ended]] = x[ended]
            going = ~ended & (x != y)
            own, x, y = own[going], x[going], y[going]
            if not len(own):
                break
            at = codes[start[own] + t]
            x, y = self.step(language[own], x, at), self.step(language[own], y, at)
            more[own] += (x & 3) - (y & 3)
            x, y = x >> 2, y >> 2
        end[own] = x
        return end, more


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, sample_docs: int, sample_chars: int, max_languages: int) -> dict[str, str]:
    """The bounded labelled text of each language, from the given documents."""
    own = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    own = own.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id).cast("string")).alias("h"), F.col(text).alias("text"))
    names = [r.lang for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
    ranked = own.select("lang", "h").where(F.col("lang").isin(names)).withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample_docs)
    chosen = ranked.select("lang", "h").distinct()
    rows = own.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, sample_chars)).alias("text")).orderBy("lang", "h").collect()
    return {n: letters_only("\n".join(r.text for r in rows if r.lang == n)[: 4 * sample_chars])[:sample_chars] for n in names}


def identify_language(
    docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 32, sample_chars: int = 30_000, max_languages: int = 64
) -> DataFrame:
    """``docs`` with lang_pred, score (the winner's lead over the second, 0 to 1) and known_letters (the share of the text's letters that occur in the winner's labelled text)."""
    samples = sample(labelled, doc_id, text, lang, sample_docs, sample_chars, max_languages)
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(samples))
    memo: dict[str, np.ndarray] = {}

    def make(texts: pa.Array) -> list[pa.Array]:
        parser: CrossParser = shared.value
        if "classes" not in memo:
            memo["classes"] = parser.classes()
            memo["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        points = [np.frombuffer((t or "").encode("utf-32-le"), np.uint32) for t in texts.to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int64)
        flat = np.concatenate([*points, np.empty(0, np.uint32)])
        is_letter = memo["letters"][flat]
        letter = np.concatenate([[0], np.cumsum(is_letter)])
        n_letters = letter[bounds[1:]] - letter[bounds[:-1]]
        known = n_letters > 0
        if not parser.languages:
            return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts))), pa.array(np.zeros(len(texts)))]
        codes = memo["classes"][flat]
        space = parser.alphabet.index(" ")
        # the first of each run of spaces stays
        stays = (codes != space) | np.concatenate([[True], codes[1:] != space])[: len(codes)]
        kept = np.concatenate([[0], np.cumsum(stays)])
        costs = parser.phrases(codes[stays], kept[bounds]) * np.asarray(parser.factor)[:, None]
        best = costs.argmin(axis=0)
        low = np.sort(costs, axis=0)
        second = low[1] if len(low) > 1 else np.maximum(low[0], 1) * 2
        lead = np.where(known & (second > 0), 1 - low[0] / np.maximum(second, 1e-9), 0.0)
        names = np.where(known, np.asarray(parser.languages, object)[best], UNKNOWN)
        own = is_letter & ((parser.begin & 3) == 0)[np.repeat(best, np.diff(bounds)), codes]
        owned = np.concatenate([[0], np.cumsum(own)])
        share = (owned[bounds[1:]] - owned[bounds[:-1]]) / np.maximum(n_letters, 1)
        return [pa.array(list(names), pa.string()), pa.array(np.clip(lead, 0, 1)), pa.array(share)]

    return add_columns(docs, text, "lang_pred string, score double, known_letters double", make, SLICE)
