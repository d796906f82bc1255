import random

import numpy as np
import pytest
from helpers import empty, rows, table

from lodestone.llm import media_avi as m


def test_round_trip_of_any_bytes():
    rng = random.Random(4)
    payloads = [bytes(rng.choices(range(256), k=64 * rng.randint(1, 60))) for _ in range(30)]
    payloads += [b"\xff" * 640, bytes(range(256)) * 4, b"\0" * 64, b"\x80\x7f" * 3200]
    files = m.encode_all(payloads)
    assert [p for p, _ in m.decode_all(files)] == payloads
    assert files[0][:4] == b"RIFF" and files[0][8:12] == b"AVI " and int.from_bytes(files[0][4:8], "little") == len(files[0]) - 8


def test_a_frame_decoded_bit_by_bit():
    """One frame read with nothing but the tables of its own header."""
    payload = bytes(random.Random(6).choices(range(256), k=1024))
    media = m.encode_all([payload])[0]
    (start, stop), = m.parse_avi(media)[0]
    frame = media[start:stop]
    scan = frame.index(b"\xff\xda")
    begin = scan + 2 + int.from_bytes(frame[scan + 2 : scan + 4], "big")
    _, width, lengths = m.parse_header(frame[:begin])
    codes = {(n, c): s for s, (n, c) in ((s, (lengths[s], c)) for s, c in m.canonical(lengths).items())}
    out, at = bytearray(), begin
    while frame[at : at + 2] != b"\xff\xd9" and at < len(frame):
        end = at
        while not (frame[end] == 0xFF and frame[end + 1] != 0):
            end += 1
        bits = "".join(f"{b:08b}" for b in frame[at:end].replace(b"\xff\0", b"\xff"))
        value, k = 128, 0
        for _ in range(width):
            n = next(n for n in range(1, 17) if (n, int(bits[k : k + n], 2)) in codes)
            c = codes[n, int(bits[k : k + n], 2)]
            k += n
            extra = int(bits[k : k + c] or "0", 2)
            k += c
            value += extra if c == 0 or extra >> (c - 1) else extra - (1 << c) + 1
            out.append(value)
        at = end if frame[end + 1] == 0xD9 else end + 2
    assert bytes(out) == payload


def test_clips_cut_where_the_picture_changes():
    still = lambda v: np.full((6, 1024), v, np.uint8)
    frames = np.concatenate([still(10), still(200), still(90)])
    got = m.clips(m.histograms(frames), frames.mean(axis=1))
    assert [(c["start_s"], c["end_s"], c["mean"]) for c in got] == [(0.0, 0.24, 10.0), (0.24, 0.48, 200.0), (0.48, 0.72, 90.0)]


def test_foreign_files_are_refused():
    with pytest.raises(ValueError):
        m.parse_avi(b"RIFF\0\0\0\0WAVE")


def test_operator(spark):
    stored = m.write_media(table(spark).selectExpr("doc_id", "text", "'mine' AS media", "2 AS clips"))
    out = m.read_media(stored).collect()
    assert sorted(r.payload for r in out) == sorted(map(bytearray, (m.padded(t) for _, t in rows())))
    assert all(r.clips[-1].end_s == pytest.approx(sum(c.frames for c in r.clips) / m.FPS) for r in out)
    assert m.read_media(m.write_media(empty(spark))).count() == 0
