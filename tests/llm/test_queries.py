"""The registered queries themselves, every column of their contracts against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import rows, text
from test_language_and_quality import brute_measures, brute_ratios
from test_near_dedup import brute_force, copies

from lodestone.llm import queries as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, score string, shard string"
HARD = [
    (201, "mail joe@example.com or +1 (555) 010-9999, host 10.0.0.1, card 4111 1111 1111 1111", "en"),
    (202, "joe [at] example [dot] com and joe ＠ x", "en"),
    (203, "é ñ 中文 🙂 İ ſ", "xx"),
    (204, "L1 a\nL1 a\n\n \nL1 a", None),
]


def fixture_rows():
    rng = random.Random(7)
    out = [(i, t, rng.choice(["en", "en", None])) for i, t in rows() if i is not None] + [(i, t, "en") for i, t in copies()[:45]] + HARD
    return out + [(900 + k, " ".join(rng.choice(["der", "die", "und", "katze", "hund"]) for _ in range(40)), "de") for k in range(12)]


def store(spark, path, data):
    df = spark.createDataFrame([(i, t, x, "s", None if t is None else len(t), 5, "mine", "clash") for i, t, x in data], SCHEMA)
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i, _, _ in data if i % 3 == 0], "doc_id long, quality int, toxic int").dropDuplicates(["doc_id"]).write.parquet(f"{path}/labels.parquet")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    store(spark, path, fixture_rows())
    return path, fixture_rows()


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    store(spark, path, [])
    return path


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    """One text above every slice and block (9 MB), between short ones."""
    path = str(tmp_path_factory.mktemp("long"))
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**5)}" for _ in range(1_300_000)]
    words[650_000] = "joe@example.com"
    data = [(1, "a b c", "en"), (2, " ".join(words), "en"), (3, text(rng, 50), "en")]
    store(spark, path, data)
    return path, data


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_an_empty_table_gives_no_rows(spark, none, name):
    assert q.queries()[name](spark, none).count() == 0


def crc(t):
    return zlib.crc32((t or "").encode())


def test_op1(spark, small):
    path, data = small
    want, n = brute_force([(i, t) for i, t, _ in data])
    got = q.op1_prob_minhash(spark, path).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == want and sum(r.kept for r in got) == n
    sizes = Counter((r.class_id, r.class_size) for r in got)
    assert all(size == n for (_, size), n in sizes.items())


def test_op2(spark, small):
    path, data = small
    got = q.op2_ring_shards(spark, path).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, crc(t)) for i, t, _ in data)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def payload(t):
    raw = (t or "").encode()
    return raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)


def check_op3(got, data):
    want = Counter((i, len((t or "").encode()), len(p := payload(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, t, _ in data)
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    for column in ("media_bytes", "media_sha256", "feature"):
        by_text = defaultdict(set)
        for r in got:
            by_text[r.payload_sha256].add(r[column])
        assert all(len(v) == 1 for v in by_text.values())


def test_op3(spark, small):
    check_op3(q.op3_avi_shots(spark, small[0]).collect(), small[1])


def reference_ids(data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.word_bpe())
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch([x or "" for _, x, _ in data], add_special_tokens=False)]


def check_op4(got, data):
    """Every token of every document, in rows whose segments start anew."""
    pieces = Counter()
    for r in got:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 4096 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert (positions[a:b] == np.arange(b - a)).all()
            pieces[d, s, ids[a:b].tobytes()] += 1
    want = Counter()
    for (i, _, _), ids in zip(data, reference_ids(data), strict=True):
        for s in range(0, len(ids), 4096):
            want[i, s, np.asarray(ids[s : s + 4096], "<u2").tobytes()] += 1
    assert pieces == want


def test_op4(spark, small):
    check_op4(q.op4_token_matrix(spark, small[0]).collect(), small[1])


def check_op5(got, data):
    want = Counter()
    for (i, _, _), ids in zip(data, reference_ids(data), strict=True):
        for k, s in enumerate(range(0, len(ids), 4096)):
            piece = ids[s : s + 4096]
            want[i, k, s, len(piece), zlib.crc32(np.asarray(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(sequences) - math.ceil(sum(r.length for r in got) / 4096) <= 1


def test_op5(spark, small):
    check_op5(q.op5_complement_packing(spark, small[0]).collect(), small[1])


def check_op6(got, data):
    learned = {x for i, t, x in data if x and zlib.crc32(str(i).encode()) % 5}
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in data)
    letters = {i: any(c.isalpha() for c in t or "") for i, t, _ in data}
    assert all(r.lang_pred in learned if letters[r.doc_id] else r.lang_pred == "und" for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_op6(spark, small):
    got = q.op6_cross_parsing(spark, small[0]).collect()
    check_op6(got, small[1])
    assert all(r.lang_pred == "de" for r in got if 900 <= r.doc_id < 912)


def brute_spans(t):
    """The base patterns as they are written in the contract."""
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def check_op7(got, data):
    want = Counter()
    for i, t, _ in data:
        spans = brute_spans(t)
        kinds = Counter(s[0] for s in spans)
        want[i, kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    text_of = {i: t for i, t, _ in data}
    for r in got:
        base = {f"{k}:{a}:{b}" for k, a, b in brute_spans(text_of[r.doc_id])}
        assert base <= set(r.spans.split(",")) | {""}


def test_op7(spark, small):
    got = q.op7_deobfuscated_pii(spark, small[0]).collect()
    check_op7(got, small[1])
    disguised = dict((r.doc_id, r.spans) for r in got)[202]
    assert disguised == f"email:0:{len('joe [at] example [dot] com')}"


def check_op8(got, data):
    import public_tokenizers as P
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = Counter((i, None if t is None else tuple(sp.encode(t))) for i, t, _ in data)
    assert Counter((r.doc_id, None if r.ids is None else tuple(r.ids)) for r in got) == want
    text_of = {i: t for i, t, _ in data}
    for r in got:
        t = text_of[r.doc_id]
        assert r.decoded_crc32 == (None if t is None else crc(t)) and r.round_trip and (t is None or r.n_ids == len(r.ids))


def test_op8(spark, small):
    check_op8(q.op8_piece_transducer(spark, small[0]).collect(), small[1])


def check_op9(got, data):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t, _ in data if not held(i) for w in [*words(t), "</s>"])
    n, v = counts.total(), len(counts)
    by_key = defaultdict(list)
    for i, t, _ in data:
        ts = [*words(t), "</s>"]
        by_key[i].append((held(i), len(ts), sum(counts[w] > 0 for w in ts), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)))
    for r in got:
        want = by_key[r.doc_id].pop()
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4] and r.base_score == pytest.approx(want[4], rel=1e-9)
        assert r.score < 0
    assert not any(by_key.values())


def test_op9(spark, small):
    check_op9(q.op9_katz_backoff(spark, small[0]).collect(), small[1])


def check_op10(got, data):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[c] for c in names)) for r in got) == Counter((i, *brute_measures(t)) for i, t, _ in data)


def test_op10(spark, small):
    path, data = small
    got = q.op10_ngram_ratio(spark, path).collect()
    check_op10(got, data)
    good = {i for i, _, _ in data if i % 3 == 0 and i % 2 == 1}
    trusted = {k for k, (i, _, _) in enumerate(data) if i in good}
    ratios = brute_ratios([t for _, t, _ in data], [x or "" for _, _, x in data], trusted, 16384)
    assert Counter((r.doc_id, r.ratio) for r in got) == Counter((i, x) for (i, _, _), x in zip(data, ratios, strict=True))
    for lang in {x or "" for _, _, x in data}:
        own = [k for k, (_, _, x) in enumerate(data) if (x or "") == lang]
        low = sorted(ratios[k] for k in own if k in trusted and brute_measures(data[k][1])[0] >= 20)
        cut = low[max(0, math.ceil(q.TRUSTED_LOSS * len(low)) - 1)] if low else -(10**9)
        want = Counter((data[k][0], not brute_measures(data[k][1])[-1] and ratios[k] >= cut) for k in own)
        ids = {data[k][0] for k in own}
        assert not want - Counter((r.doc_id, r.kept) for r in got if r.doc_id in ids), lang


@pytest.mark.parametrize(
    "name, check",
    [("op3_avi_shots", check_op3), ("op4_token_matrix", check_op4), ("op5_complement_packing", check_op5), ("op6_cross_parsing", check_op6), ("op7_deobfuscated_pii", check_op7), ("op8_piece_transducer", check_op8), ("op9_katz_backoff", check_op9), ("op10_ngram_ratio", check_op10)],
)
def test_one_text_above_every_slice(spark, long, name, check):
    check(q.queries()[name](spark, long[0]).collect(), long[1])


def test_a_long_text_near_its_copy(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**5)}" for _ in range(400_000)]
    data = [(1, " ".join(words), "en"), (2, " ".join([*words[:-100], "end"]), "en"), (3, "a b c", "en")]
    store(spark, str(tmp_path), data)
    assert {(r.doc_id, r.class_id) for r in q.op1_prob_minhash(spark, str(tmp_path)).collect()} == {(1, 1), (2, 1), (3, 3)}
