"""Token ids of texts by a public vocabulary.

Where the vocabulary's file says that texts are lower-cased, cut at white space
and into runs of letters, and merged from bytes with a mark at the end of each
run, a word of letters with signs around it takes a short way: words are told
apart for a whole slice of texts, and their letters are merged all at once. All
other words are encoded by the tokenizer itself, as are whole texts with any
other vocabulary. Nothing is kept between slices.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrow_words import flat_words, ranges
from .tables import PairTable, merge_pairs

BATCH = 20_000
LONGEST = 48  # bytes of letters that are merged here; longer ones are encoded by the tokenizer

# What the vocabulary's file says where the short way holds.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}
# letters that have one lower case each and no marks of their own, and ASCII signs, which are neither letters nor digits
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_PARTS = rf"^(?P<before>[!-&(-/:-@\[-`{{-~]*)(?P<letters>[{_LETTERS}]+)(?P<after>[{_SIGNS}]*)$"


def short_way(spec: dict) -> bool:
    """Whether a vocabulary's file allows words to be encoded by their parts."""
    before = spec.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [])
    split = len(steps) == 2 and steps[0] == {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    by_bytes = split and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return bool(by_bytes and (spec.get("normalizer") or {}).get("normalizers") == _LOWER and all(spec["model"].get(k) == v for k, v in _MODEL.items()))


def byte_signs() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else one of those from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Merges:
    """The merges of a vocabulary over bytes."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        signs = byte_signs()
        self.inner, self.last = (np.asarray([vocab.get(s + e, -1) for s in signs], np.int32) for e in ("", end))
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        a, b, made = (np.asarray(x, np.int32) for x in zip(*((vocab[x], vocab[y], vocab[x + y]) for x, y in pairs), strict=True))
        self.ranks, self.results = PairTable(a, b, np.arange(len(a))), PairTable(a, b, made)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other; how many each has). No word is empty or longer than ``LONGEST``."""
        words = words.cast(pa.binary())
        raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.empty(0, np.uint8)
        bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        size = np.diff(bounds)
        counts, found = np.zeros(len(words), np.int64), []
        for low, high in pairwise((0, 4, 6, 8, 10, 12, 16, 24, LONGEST)):
            own = np.flatnonzero((size > low) & (size <= high))
            if not len(own):
                continue
            width = np.arange(int(size[own].max()))
            inside = width < size[own, None]
            symbols = np.zeros(inside.shape, np.int32)
            symbols[inside] = self.inner[raw[ranges(bounds[own], size[own])]]
            symbols[np.arange(len(own)), size[own] - 1] = self.last[raw[bounds[own] + size[own] - 1]]
            merged, left, _ = merge_pairs(symbols, size[own], self.ranks, self.results)
            counts[own] = left
            found.append((own, merged, left))
        start = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for own, merged, left in found:
            out[ranges(start[own], left)] = merged[np.arange(merged.shape[1]) < left[:, None]]
        return out, counts


class Tokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"]) if short_way(spec) else None
        self.size = self.tokenizer.get_vocab_size()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, found = [], [np.empty(0, np.uint32)]
        for k in range(0, len(texts), BATCH):
            got = [x.ids for x in self.tokenizer.encode_batch_fast(texts[k : k + BATCH], add_special_tokens=False)]
            counts += map(len, got)
            found.append(np.fromiter((i for x in got for i in x), np.uint32, sum(map(len, got))))
        return np.concatenate(found), np.asarray(counts, np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words, how many each has), by their parts where that is the same."""
        parts = pc.extract_regex(words, _PARTS)
        fine = pc.and_(parts.is_valid(), pc.less_equal(pc.binary_length(words), LONGEST))
        short = np.flatnonzero(fine.to_numpy(zero_copy_only=False))
        parts = parts.take(pa.array(short))
        letters = pc.utf8_lower(parts.field("letters")).dictionary_encode()
        ids, counts = self.merges.encode(letters.dictionary)
        rest = np.flatnonzero(~fine.to_numpy(zero_copy_only=False))
        signs = [parts.field(f).dictionary_encode() for f in ("before", "after")]
        others = [*words.take(pa.array(rest)).to_pylist(), *(s for x in signs for s in x.dictionary.to_pylist())]
        more, more_counts = self._encode(others)
        flat, size = np.concatenate([ids, more]), np.concatenate([counts, more_counts])
        start = np.cumsum(size) - size
        # the parts of each word as rows of ``size``
        first = len(counts) + len(rest)
        code = np.full((len(words), 3), -1, np.int64)
        code[short, 0] = first + signs[0].indices.to_numpy()
        code[short, 1] = letters.indices.to_numpy()
        code[short, 2] = first + len(signs[0].dictionary) + signs[1].indices.to_numpy()
        code[rest, 1] = len(counts) + np.arange(len(rest))
        there = code >= 0
        own = code[there]
        per_part = np.zeros(code.shape, np.int64)
        per_part[there] = size[own]
        return flat[ranges(start[own], size[own])], per_part.sum(axis=1)

    def ids(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end`` if given; their bounds). A null text is empty."""
        if self.merges:
            codes, words, bounds = flat_words(texts)
            flat, size = self._words(words.cast(pa.string()))
            start, lengths = np.cumsum(size) - size, size[codes]
            source = flat[ranges(start[codes], lengths)]
            per_text = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        else:
            source, lengths = self._encode(pc.fill_null(texts.cast(pa.large_string()), "").to_pylist())
            per_text = np.concatenate([[0], np.cumsum(lengths)])
        if end is None:
            return source, per_text
        n = len(texts)
        out = np.full(len(source) + n, end, np.uint32)
        out[np.arange(len(source)) + np.repeat(np.arange(n), np.diff(per_text))] = source
        return out, per_text + np.arange(n + 1)


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> Tokenizer:
    return Tokenizer(path)
