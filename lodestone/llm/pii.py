"""Personal data: base patterns, and disguised identifiers found through offset-preserving transducers.

Two transducers rewrite a text. The first maps characters: homoglyphs, wide
and foreign digits, dashes and spaces become ASCII, and characters without
width go. The second maps phrases: bracketed or spelled "at" and "dot",
spelled digits and "plus". Each keeps, for every character it writes, where
the characters that it stands for begin and end. The base patterns then run on
the rewritten text, and what they find there is mapped back to the source.

Base spans stay as they are. A span of the method is added when it holds a
rewritten part and isn't a base span of its kind.

Defined results: a null text is empty; offsets count code points; other
columns pass through; repeated rows are treated alike.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_words import add_columns

KINDS = ("email", "ip", "card", "phone")
ADDED = (*(f"n_{k}" for k in KINDS), "base", "spans", "redacted")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where its run of digits does, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: its local part is the run of characters before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by start, then kind."""
    out: list[Span] = [("email", *x) for x in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Letters of other scripts that look like ASCII ones, and their ASCII letters.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁһӏԛԝАВЕЅІЈКМНОРСТХҮΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѵνɡɑı",
        "aeopcyxijsdhlqwABESIJKMHOPCTXYABEZHIKMNOPTYXovvgai",
        strict=True,
    )
)
WIDTHLESS = "­​‌‍⁠﻿"
PLAIN = {"。": ".", "﹒": ".", "․": ".", "﹫": "@", "−": "-", " ": " ", " ": " ", "　": " "}
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


@lru_cache(maxsize=4096)
def plain(c: str) -> str:
    """The first transducer, for one character."""
    if c < "\x80":
        return c
    if c in WIDTHLESS:
        return ""
    if c in HOMOGLYPHS or c in PLAIN:
        return HOMOGLYPHS.get(c) or PLAIN[c]
    if 0xFF01 <= ord(c) <= 0xFF5E:
        return chr(ord(c) - 0xFEE0)
    if "‐" <= c <= "―":
        return "-"
    return str(unicodedata.decimal(c, c))


class Rewritten:
    """A text after a transducer: pieces that were rewritten, and the rest, which only moved."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        self.edits = edits  # (start, end, replacement) of the source, in order
        parts, at, to = [], 0, 0
        self.begins, self.sources = [], []  # where each edit begins in the new text; its (start, end) in the source
        for start, end, new in edits:
            parts += (source[at:start], new)
            to += start - at
            self.begins.append(to)
            self.sources.append((to + len(new), start, end))
            to, at = to + len(new), end
        self.text = "".join([*parts, source[at:]])

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Where [start, end) comes from, and whether a part of it was rewritten."""
        first, last = self._of(start), self._of(end - 1)
        i = bisect_right(self.begins, start) - 1
        j = bisect_right(self.begins, end - 1) - 1
        return first[0], last[1], j > i or i >= 0 and start < self.sources[i][0]

    def _of(self, at: int) -> tuple[int, int]:
        """Start and end in the source of what became the character ``at``."""
        i = bisect_right(self.begins, at) - 1
        # an edit that writes nothing begins where the next character stands
        if i < 0:
            return at, at + 1
        end, start, stop = self.sources[i]
        return (start, stop) if at < end else (stop + at - end, stop + at - end + 1)


_OPEN, _CLOSE = r"\s{0,4}[\[({<]\s{0,4}", r"\s{0,4}[\])}>]\s{0,4}"
_DOT = rf"(?:{_OPEN}(?:dot|point|\.){_CLOSE}|\s{{1,4}}dot\s{{1,4}})"
_NUM = rf"(?:\b(?:{'|'.join(DIGIT_WORDS)})\b|[0-9])"
_HOST = r"[A-Za-z0-9-]{1,63}"
_RUN = re.compile(rf"(?:\bplus\s{{1,4}})?{_NUM}(?:(?:{_DOT}|[\s().-]{{0,4}}){_NUM}){{3,}}", re.I)
_TOKEN = re.compile(rf"(?P<plus>plus\s{{1,4}})|(?P<word>{'|'.join(DIGIT_WORDS)})|(?P<dot>{_DOT})|(?P<gap>[\s-]+)|.", re.I | re.S)
_MAIL = re.compile(
    rf"(?P<at>{_OPEN}(?:at|@){_CLOSE})(?={_HOST}(?:(?:{_DOT}|\.){_HOST})+)"
    rf"|(?P<spelled>(?<=[A-Za-z0-9_])\s{{1,4}}at\s{{1,4}})(?={_HOST}(?:{_DOT}{_HOST})+)"
    rf"|(?P<near>(?<=[A-Za-z0-9])@(?={_HOST}{_DOT}{_HOST}))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9]))",
    re.I,
)
# What a run must hold to be rewritten: a spelled digit, or "plus" before a digit.
_SPELLED = re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS)})\b|\bplus\s{{1,4}}[0-9]", re.I)
# What every match of _MAIL holds: a bracketed sign or word, or a spelled "dot" (a spelled "at" needs a dot behind it).
_GATE_MAIL = re.compile(r"[\[({<]\s{0,4}(?:at|@|dot|point|\.)\s{0,4}[\])}>]|\sdot\s", re.I)


def _characters(text: str) -> Rewritten:
    return Rewritten(text, [(i, i + 1, new) for i, c in enumerate(text) if c >= "\x80" and (new := plain(c)) != c])


def _run_edits(m: re.Match) -> list[tuple[int, int, str]]:
    """Spelled digits become digits; what stands between one and its neighbour goes."""
    tokens, out = [(t.lastgroup, m.start() + t.start(), m.start() + t.end(), t[0]) for t in _TOKEN.finditer(m[0])], []
    for i, (kind, start, end, said) in enumerate(tokens):
        if kind == "plus":
            out.append((start, end, "+"))
        elif kind == "word":
            out.append((start, end, str(DIGIT_WORDS.index(said.casefold()))))
        elif kind == "dot":
            out.append((start, end, "."))
        elif kind == "gap" and 0 < i < len(tokens) - 1 and "word" in (tokens[i - 1][0], tokens[i + 1][0]):
            out.append((start, end, ""))
    return out


def _phrases(text: str, gated: bool = True) -> Rewritten:
    """The second transducer. The gates only save time: without them the edits are the same."""
    edits = []
    if not gated or _SPELLED.search(text):
        for m in _RUN.finditer(text):
            if _SPELLED.search(m[0]):
                edits += _run_edits(m)
    if not gated or _GATE_MAIL.search(text):
        taken = sorted(edits)
        for m in _MAIL.finditer(text):
            i = bisect_right(taken, (m.start(), len(text), ""))
            if (i == 0 or taken[i - 1][1] <= m.start()) and (i == len(taken) or taken[i][0] >= m.end()):
                edits.append((*m.span(), "." if m.lastgroup == "dot" else "@"))
    return Rewritten(text, sorted(e for e in edits if text[e[0] : e[1]] != e[2]))


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """The base spans and those that show only after the transducers."""
    first = None if text.isascii() or all(plain(c) == c for c in set(text)) else _characters(text)
    second = _phrases(first.text if first else text)
    if not first and not second.edits:
        return base
    known, out = set(base), list(base)
    for kind, start, end in base_spans(second.text):
        start, end, changed = second.back(start, end)
        if first:
            start, end, earlier = first.back(start, end)
            changed = changed or earlier
        if changed and (kind, start, end) not in known:
            out.append((kind, start, end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, or union of spans that overlap, replaced by its first kind in brackets."""
    parts, at = [], 0
    merged: list[list] = []
    for kind, start, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        parts += (text[at:start], f"[{kind.upper()}]")
        at = end
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with n_<kind> (base spans), base, spans (kind:start:end, comma-joined) and redacted, if asked for (null for null)."""

    def make(texts: pa.Array) -> list[pa.Array]:
        counts, bases, spans, new = {k: [] for k in KINDS}, [], [], []
        for source in texts.to_pylist():
            found = base_spans(source or "")
            every = all_spans(source or "", found)
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in found))
            bases.append(joined(found))
            spans.append(joined(every))
            new.append(redacted(source, every) if redact and source else source)
        out = [*(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(bases, pa.string()), pa.array(spans, pa.string())]
        return [*out, pa.array(new, pa.string())] if redact else out

    fields = ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string" + ", redacted string" * redact
    return add_columns(docs, text, fields, make)


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
