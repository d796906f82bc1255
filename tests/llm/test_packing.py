import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import empty, rows, table

from lodestone.llm import best_fit_packing as bp
from lodestone.llm import token_matrix as tm
from lodestone.llm.queries import word_bpe
from lodestone.llm.token_ids import Tokenizer


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_tokenizers():
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZÀÖØÿñçßéÉ'’.,!?-()[]<|>0123 \n\téıİſ中文😀ǅ́"
    texts = [t for _, t in rows()] + ["Σ ΑΣ", "é x́", "<|endoftext|> a", "don't 12.5", "a\xa0b c\x85d", "日本 🙂🙂", "İ ﬁ ½", "x" * 200, "('ll) 'tis"]
    texts += ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    ids, bounds = Tokenizer(word_bpe()).ids(pa.array(texts), 1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == reference_ids(texts)


def test_other_vocabularies_are_encoded_whole():
    """One that tells cases and leading spaces apart, and one of words in which case counts."""
    import public_tokenizers as P
    from tokenizers import Tokenizer as T

    texts = ["Hello hello  world", None, "", "Don't\n\nDO it"]
    path = P.path("byte_bpe_50k.json")
    t = T.from_file(path)
    t.encode_special_tokens = True
    ids, bounds = Tokenizer(path).ids(pa.array(texts), None)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_case_counts_where_the_file_says_so(tmp_path):
    import json

    spec = json.load(open(word_bpe(), encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    own = Tokenizer(str(path))
    assert own.merges is None
    ids, _ = own.ids(pa.array(["Hello hello"]), None)
    assert ids.tolist() == own.tokenizer.encode("Hello hello", add_special_tokens=False).ids


def brute_sequences(counts, capacity, most):
    """Sequences as sorted tuples of lengths, by trying all combinations of single pieces."""
    left, out, rest = Counter(counts), [], []
    for own in range(capacity, 0, -1):
        while left[own]:
            left[own] -= 1
            gap, found = capacity - own, () if own == capacity else None
            for size in range(1, most + 1 if gap else 0):
                some = sorted((n for n in left.elements() if n <= gap), reverse=True)
                found = max((c for c in set(itertools.combinations(some, size)) if sum(c) == gap), default=None)
                if found:
                    break
            if found is None:
                rest.append(own)
                continue
            left.subtract(found)
            out.append(tuple(sorted((own, *found))))
    rooms = []
    for n in sorted(rest, reverse=True):
        at = min((k for k, r in enumerate(rooms) if r >= n), key=lambda k: rooms[k], default=None)
        if at is None:
            rooms.append(capacity)
            at = len(rooms) - 1
        rooms[at] -= n
    return out, rooms


@pytest.mark.parametrize("most", [1, 2, 3])
def test_plan_against_brute_force(most):
    rng = random.Random(most)
    for _ in range(40):
        capacity = rng.choice([12, 20, 30])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 14)))
        exact, rooms = brute_sequences(counts, capacity, most)
        planned = bp.exact_plan(dict(counts), capacity, most)
        full = Counter(tuple(sorted(n for n, k in runs for _ in range(k))) for many, runs in planned for _ in range(many) if sum(n * k for n, k in runs) == capacity)
        assert Counter(exact) - full == Counter(), (counts, capacity)
        assert sorted(capacity - sum(n * k for n, k in runs) for many, runs in planned for _ in range(many)) == sorted([0] * len(exact) + rooms)


def test_the_plan_of_fewest_sequences_is_taken_and_named():
    sizes = lambda p: sum(many for many, _ in p)
    rng = random.Random(9)
    won = Counter()
    for _ in range(80):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 60)))
        every = bp.plans(dict(counts), 40)
        first = next(iter(every))
        won[first] += 1
        assert sizes(every[first]) == min(map(sizes, every.values())) and bp.plan(dict(counts), 40) == every[first]
    assert won[3] > 40


def test_best_fit_decreasing_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([7, 16, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        rooms = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in rooms if r >= lengths[i]]
            if fits:
                at = rooms.index(min(fits))
            else:
                rooms.append(capacity)
                at = len(rooms) - 1
            rooms[at] -= lengths[i]
        packed = tm.best_fit_decreasing(np.array(lengths, np.int64), capacity)
        assert sorted(i for r in packed for i in r) == list(range(len(lengths)))
        assert sorted(capacity - sum(lengths[i] for i in r) for r in packed) == sorted(rooms)


def test_plans_place_every_piece():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([16, 64, 300])
        counts = Counter(rng.randint(1, capacity if rng.random() < 0.7 else max(1, capacity // 5)) for _ in range(rng.randint(1, 300)))
        planned = bp.plan(dict(counts), capacity)
        used = Counter()
        for many, runs in planned:
            assert many > 0 and sum(n * k for n, k in runs) <= capacity
            for n, k in runs:
                used[n] += many * k
        assert used == counts
        lengths = np.array([n for n, k in counts.items() for _ in range(k)])
        packed = tm.best_fit_decreasing(lengths, capacity)
        assert sorted(i for r in packed for i in r) == list(range(len(lengths)))
        assert sum(many for many, _ in planned) <= len(packed) + 1


def test_exact_complements_are_consumed():
    assert bp.exact_plan({60: 3, 40: 2, 30: 1, 10: 1}, 100, 3)[:2] == [(2, ((60, 1), (40, 1))), (1, ((60, 1), (30, 1), (10, 1)))]


def test_best_fit_packing(spark):
    out = bp.best_fit_packing(table(spark), word_bpe(), capacity=512).collect()
    wanted = Counter()
    for (i, _), ids in zip(rows(), reference_ids([t for _, t in rows()])):
        for k, s in enumerate(range(0, len(ids), 512)):
            piece = ids[s : s + 512]
            wanted[i, k, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == wanted
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert bp.best_fit_packing(empty(spark), word_bpe()).count() == 0


def test_token_matrix_loses_nothing(spark):
    out = tm.token_matrix(table(spark), word_bpe(), capacity=512).collect()
    found = defaultdict(list)
    for r in out:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == 512 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            found[d].append((s, ids[a:b].tolist()))
    got = Counter((d, tuple(t)) for d, parts in found.items() for t in [sum((x for _, x in sorted(parts)), [])])
    once = {i for i, n in Counter(i for i, _ in rows()).items() if n == 1}
    wanted = {(i, tuple(ids)) for (i, _), ids in zip(rows(), reference_ids([t for _, t in rows()])) if i in once}
    assert wanted <= set(got)
    assert sum(r.n_tokens for r in out) == sum(map(len, reference_ids([t for _, t in rows()])))
    assert tm.token_matrix(empty(spark), word_bpe()).count() == 0


def test_a_type_that_does_not_hold_the_ids_is_refused(spark):
    with pytest.raises(Exception, match="don't fit"):
        tm.token_matrix(table(spark), word_bpe(), dtype="u1").collect()


def test_ids_of_text_and_clashing_names(spark):
    docs = spark.createDataFrame([("a", "x y", 1, 2), (None, None, 3, 4)], "doc_id string, text string, length int, sequence_id int")
    assert {(r.doc_id, r.length) for r in bp.best_fit_packing(docs, word_bpe()).collect()} == {("a", 3), (None, 1)}
    assert [d for r in tm.token_matrix(docs, word_bpe()).collect() for d in r.doc_ids if d] == ["a"]
