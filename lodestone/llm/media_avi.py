"""AVI files of lossless motion JPEG: writing, reading by index, and shots.

A payload is laid out as frames of 64 x 16 samples of 8 bits (zeros fill the
last frame; an INFO chunk keeps the payload's length). A frame is a JPEG of
process 14 (lossless, Huffman, predictor 1) with one restart interval per line,
so all lines of many frames are coded and decoded together, one sample of each
at a time.

Reading walks the RIFF chunks, takes the frames from the index and the Huffman
table and size from each frame's own header. Shots are cut where the
difference of neighbouring frames' histograms exceeds what the last frames'
differences make likely.

Defined results: a null text is empty, and an empty one is 64 zero bytes;
equal payloads give equal files; other columns pass through.
"""

from __future__ import annotations

import struct
from statistics import fmean, pstdev

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_words import add_columns

WIDTH, HEIGHT, FPS, UNIT = 64, 16, 25, 64
FRAME = WIDTH * HEIGHT
BINS, TRAIL, SPREADS, LEAST = 16, 8, 2.0, 0.08
SLICE = 1 << 20

# Lengths of the Huffman codes of the difference classes 0 to 8. The code of ones alone stays free, as JPEG asks.
CODE_LENGTHS = {0: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 1: 4, 8: 5}
LONGEST = 13


def canonical(lengths: dict[int, int]) -> dict[int, int]:
    """Codes in the order of the table: by length, then as listed."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol], last = code, n
        code += 1
    return out


def tables(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code and length of each difference from -255, and for each 13 bits the difference * 16 + length they begin with)."""
    codes = canonical(lengths)
    word, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    first = np.zeros(1 << LONGEST, np.int32)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << c) - 1
        w, n = (codes[c] << c) | (extra if c else 0), lengths[c] + c
        word[d + 255], size[d + 255] = w, n
        first[w << (LONGEST - n) : (w + 1) << (LONGEST - n)] = d * 16 + n
    return word, size, first


def jpeg_header() -> bytes:
    by_length = [[s for s, n in CODE_LENGTHS.items() if n == k] for k in range(1, 17)]
    dht = bytes([0]) + bytes(map(len, by_length)) + bytes(s for row in by_length for s in row)
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    return (
        b"\xff\xd8"
        + part(0xC3, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + bytes([1, 0x11, 0]))
        + part(0xC4, dht)
        + part(0xDD, struct.pack(">H", WIDTH))
        + part(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    )


def parse_header(head: bytes) -> tuple[int, int, dict[int, int]]:
    """(height, width, code lengths) of a frame's header; only what this module writes is accepted."""
    at, height, width, lengths, restart = 2, 0, 0, {}, 0
    while at < len(head):
        marker, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + n]
        if marker == 0xC3:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("only frames of one component of 8 bits")
        elif marker == 0xC4:
            k = 17
            for size, many in enumerate(body[1:17], 1):
                lengths |= dict.fromkeys(body[k : k + many], size)
                k += many
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA and body[3] != 1:
            raise ValueError("only predictor 1")
        at += 2 + n
    if restart != width:
        raise ValueError("only restart intervals of one line")
    return height, width, lengths


_HEADER = jpeg_header()


def encode_lines(samples: np.ndarray, lines_per_frame: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all lines, each followed by its marker; where each line's end in them)."""
    word, size, _ = tables(CODE_LENGTHS)
    diff = samples.astype(np.int16)
    diff[:, 1:] -= samples[:, :-1]
    diff[:, 0] -= 128
    diff += 255
    bits = size[diff]
    ends = np.cumsum(bits, axis=1)
    n_bytes = (ends[:, -1] + 7) >> 3
    line_end = np.cumsum(n_bytes)
    start = (line_end - n_bytes) * 8
    out = np.zeros(int(line_end[-1]) + 3, np.uint8)
    for k in range(samples.shape[1]):
        at = start + ends[:, k] - bits[:, k]
        w = word[diff[:, k]] << (24 - bits[:, k] - (at & 7)).astype(np.uint32)
        at >>= 3
        out[at] |= (w >> 16).astype(np.uint8)
        out[at + 1] |= (w >> 8 & 255).astype(np.uint8)
        out[at + 2] |= (w & 255).astype(np.uint8)
    out = out[:-3]
    out[line_end - 1] |= ((1 << (n_bytes * 8 - ends[:, -1])) - 1).astype(np.uint8)
    full = np.flatnonzero(out == 255)  # each is followed by a zero byte
    out = np.insert(out, full + 1, 0)
    line_end = line_end + np.searchsorted(full, line_end)
    lines = np.arange(len(line_end))
    stuffed = np.zeros(len(out) + 2 * len(lines), np.uint8)
    shift = np.repeat(2 * lines, np.diff(np.concatenate([[0], line_end])))
    stuffed[np.arange(len(out)) + shift] = out
    ends = line_end + 2 * lines + 2
    in_frame = lines % lines_per_frame
    stuffed[ends - 2] = 255
    stuffed[ends - 1] = np.where(in_frame == lines_per_frame - 1, 0xD9, 0xD0 + in_frame % 8)
    return stuffed, ends


def decode_lines(coded: np.ndarray, width: int, lengths: dict[int, int]) -> np.ndarray:
    """The samples of all lines of entropy-coded segments that end with their markers."""
    _, _, first = tables(lengths)
    mark = np.flatnonzero((coded[:-1] == 255) & (coded[1:] >= 0xD0) & (coded[1:] <= 0xD9))
    drop = np.zeros(len(coded), bool)
    drop[1:] = (coded[:-1] == 255) & (coded[1:] == 0)
    drop[mark] = drop[mark + 1] = True
    kept = np.concatenate([[0], np.cumsum(~drop)])
    pos = np.concatenate([[0], kept[mark]])[:-1] * 8
    plain = np.concatenate([coded[~drop], np.zeros(4, np.uint8)]).astype(np.uint32)
    triple = (plain[:-2] << 16) | (plain[1:-1] << 8) | plain[2:]
    out = np.empty((len(mark), width), np.uint8)
    value = np.full(len(mark), 128, np.int32)
    for k in range(width):
        step = first[(triple[pos >> 3] >> (24 - LONGEST - (pos & 7)).astype(np.uint32)) & ((1 << LONGEST) - 1)]
        value += step >> 4
        pos += step & 15
        out[:, k] = value
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi_file(frames: list[bytes], payload_bytes: int) -> bytes:
    """A RIFF AVI file of the given frames, with an index."""
    longest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, longest * FPS, 0, 0x10, len(frames), 0, 1, longest, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), longest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    picture = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload_bytes=%d\0" % payload_bytes))
    parts, index, at = [b"movi"], [], 4
    for frame in frames:
        parts.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(parts[-1])
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


def parse_avi(media: bytes) -> tuple[list[tuple[int, int]], int]:
    """((start, end) of each frame by the index, payload length)."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, payload, frames = 12, 0, 0, []
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        kind = media[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"LIST" and kind == b"INFO":
            body = media[at + 12 : at + 8 + n]
            payload = int(body[8:].split(b"\0")[0].partition(b"=")[2])
        elif name == b"idx1":
            for k in range(at + 8, at + 8 + n, 16):
                _, _, offset, size = struct.unpack_from("<4sIII", media, k)
                frames.append((movi + offset + 8, movi + offset + 8 + size))
        at += 8 + n + n % 2
    return frames, payload


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """An AVI file of each payload."""
    many = [max(1, -(-len(p) // FRAME)) for p in payloads]
    laid = b"".join(p.ljust(n * FRAME, b"\0") for p, n in zip(payloads, many, strict=True))
    coded, ends = encode_lines(np.frombuffer(laid, np.uint8).reshape(-1, WIDTH), HEIGHT)
    stops = ends[HEIGHT - 1 :: HEIGHT].tolist()
    data, out, k, start = coded.tobytes(), [], 0, 0
    for p, n in zip(payloads, many, strict=True):
        frames = []
        for stop in stops[k : k + n]:
            frames.append(_HEADER + data[start:stop])
            start = stop
        k += n
        out.append(avi_file(frames, len(p)))
    return out


def decode_all(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, frames x samples) of each file."""
    parts, counts, sizes, header = [], [], [], None
    for media in files:
        frames, payload = parse_avi(media)
        counts.append(len(frames))
        sizes.append(payload)
        for start, stop in frames:
            if header is None or media[start : start + len(header)] != header:
                scan = media.index(b"\xff\xda", start)
                own = media[start : scan + 2 + struct.unpack_from(">H", media, scan + 2)[0]]
                if header is not None and parse_header(own) != parse_header(header):
                    raise ValueError("frames of one call share their size and Huffman table")
                header = own
            parts.append(media[start + len(header) : stop])
    height, width, lengths = parse_header(header)
    lines = decode_lines(np.frombuffer(b"".join(parts), np.uint8), width, lengths).reshape(-1, height * width)
    out, k = [], 0
    for n, size in zip(counts, sizes, strict=True):
        own = lines[k : k + n]
        out.append((own.tobytes()[:size], own))
        k += n
    return out


def histograms(frames: np.ndarray) -> np.ndarray:
    """Shares of BINS grey levels, frames x BINS."""
    at = np.arange(len(frames))[:, None] * BINS + (frames >> 4)
    return np.bincount(at.ravel(), minlength=len(frames) * BINS).reshape(-1, BINS) / frames.shape[1]


def clips(shares: np.ndarray, means: np.ndarray) -> list[dict]:
    """Timed clips: a shot ends where a difference exceeds the mean of its last TRAIL by SPREADS deviations, and LEAST."""
    steps = (np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2).tolist()
    cuts, trail = [0], []
    for i, step in enumerate(steps, 1):
        if len(trail) >= 2 and step > max(LEAST, fmean(trail) + SPREADS * pstdev(trail)):
            cuts.append(i)
            trail = []
        else:
            trail = [*trail[1 - TRAIL :], step]
    ends = [*cuts[1:], len(shares)]
    return [{"clip": k, "start_s": s / FPS, "end_s": e / FPS, "frames": e - s, "mean": round(float(means[s:e].mean()), 3)} for k, (s, e) in enumerate(zip(cuts, ends, strict=True))]


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def write_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes (of the text) and media (the AVI file)."""

    def make(texts: pa.Array) -> list[pa.Array]:
        source = texts.to_pylist()
        files = encode_all([padded(t) for t in source]) if source else []
        return [pa.array([len((t or "").encode()) for t in source], pa.int64()), pa.array(files, pa.binary())]

    return add_columns(docs, text, "n_bytes long, media binary", make, SLICE, FRAME)


CLIP = "array<struct<clip: int, start_s: double, end_s: double, frames: int, mean: double>>"


def read_media(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with payload (binary, read back from the file) and clips (timed rows, one for each shot)."""

    def make(files: pa.Array) -> list[pa.Array]:
        found = decode_all(files.to_pylist()) if len(files) else []
        shots = [clips(histograms(f), f.mean(axis=1)) for _, f in found]
        kind = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("mean", pa.float64())]))
        return [pa.array([p for p, _ in found], pa.binary()), pa.array(shots, kind)]

    return add_columns(media, column, f"payload binary, clips {CLIP}", make, SLICE, FRAME)
