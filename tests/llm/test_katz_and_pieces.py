import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import empty, rows, table
from pyspark.sql import functions as F

from lodestone.llm import katz
from lodestone.llm import piece_transducer as pt
from lodestone.llm.language_id import crc_bucket


def brute_force(data, order):
    """Scores by dictionaries and recursion; also checks that every history's probabilities sum to one."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"] for _, t in data]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in data]
    counts = [Counter() for _ in range(order)]
    for ts, out in zip(tokens, held):
        padded = ["<s>"] * (order - 1) + ts
        for k in range(order):
            if not out:
                counts[k].update(tuple(padded[i - k : i + 1]) for i in range(order - 1, len(padded)))
    one = counts[0]
    n, v = sum(one.values()), len(one)
    texts = held.count(False)
    factors = [katz.discounts([0, *(sum(x == r for x in c.values()) for r in range(1, 7))]) for c in counts]
    kept = lambda k, c: c * factors[k][c] if c <= katz.LARGEST else c - katz.FLOOR
    unknown = sum(c - kept(0, c) for c in one.values()) / n
    after = defaultdict(list)
    for c in counts[1:]:
        for gram in c:
            after[gram[:-1]].append(gram)
    total = lambda h: texts if set(h) == {"<s>"} else counts[len(h) - 1][h]

    @functools.cache
    def weight(h):
        k = len(h)
        return sum(counts[k][g] - kept(k, counts[k][g]) for g in after[h]) / total(h) / (1 - sum(p(h[1:], g[-1]) for g in after[h]))

    def p(h, w):
        if not h:
            return kept(0, one[w,]) / n if one[w,] else unknown
        if c := counts[len(h)][*h, w]:
            return kept(len(h), c) / total(h)
        return (weight(h) if total(h) else 1.0) * p(h[1:], w)

    for h in list(after)[:: max(1, len(after) // 30)]:
        assert sum(p(h, w) for (w,) in one) + p(h, "never seen") == pytest.approx(1)
    out = []
    for (i, _), ts, held_out in zip(data, tokens, held):
        padded = ["<s>"] * (order - 1) + ts
        base = sum(math.log10((one[w,] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
        score = sum(math.log10(p(tuple(padded[j - order + 1 : j]), padded[j])) for j in range(order - 1, len(padded)))
        out.append((i, held_out, len(ts), sum(one[w,] > 0 for w in ts), base, score))
    return out, n


KEY = lambda r: (str(r[0]), *r[1:4], round(r[4], 5))


@pytest.mark.parametrize("order, fan", [(1, 128), (2, 128), (2, 2), (3, 128), (3, 4), (4, 128)])
def test_scores_equal_brute_force(spark, monkeypatch, order, fan):
    """With blocks of few texts, and bundles of few blocks."""
    monkeypatch.setattr(katz, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(katz, "FAN", fan)
    data = rows(n=60) + [(k, " ".join(f"w{(k * j) % 13}" for j in range(30))) for k in range(200, 230)]
    want, n = brute_force(data, order)
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("held_out", crc_bucket(F.col("doc_id"), 10) == 0)
    out, model = katz.katz_scores(df.withColumn("score", F.lit(1)), order=order)
    got = sorted(map(tuple, out.collect()), key=KEY)
    assert model.tokens == n and [r[:4] for r in got] == [r[:4] for r in sorted(want, key=KEY)]
    for a, b in zip(got, sorted(want, key=KEY)):
        assert a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5], rel=1e-9)


def test_scores_are_equal_on_a_rerun(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 4000)
    df = table(spark, n=120).repartition(5, "text").withColumn("held_out", F.lit(False))
    runs = [sorted(map(tuple, katz.katz_scores(df)[0].collect()), key=KEY) for _ in range(2)]
    assert runs[0] == runs[1]


def test_katz_without_rows_or_training(spark):
    none = empty(spark).withColumn("held_out", F.lit(False))
    assert katz.katz_scores(none)[0].count() == 0
    out, model = katz.katz_scores(table(spark).withColumn("held_out", F.lit(True)))
    assert model.tokens == 0 and all(r.n_known == 0 and r.score == 0 for r in out.collect())
    named = spark.createDataFrame([("a", "x y", None), (None, None, True)], "doc_id string, text string, held_out boolean")
    assert {(r.doc_id, r.held_out, r.n_tokens) for r in katz.katz_scores(named)[0].collect()} == {("a", False, 3), (None, True, 1)}


def test_packed_numbers():
    for x in ([], [0], [0, 0], [5, 1 << 40, 0]):
        assert katz.unpacked_counts(katz.packed_counts(np.array(x, np.int64))).tolist() == x
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 1000, np.uint64))
    assert (katz.unpacked_keys(katz.packed_keys(keys)) == keys).all()


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers as P
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    return path, pt.PieceTransducer.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_ids_and_texts_equal_sentencepiece(pieces):
    _, machine, sp = pieces
    rng = random.Random(5)
    texts = ["a  b   cc é\n\t日", "   ", "a ", "<s> </s><0x41>", "▁a ▁▁", "🙂🙂 नमस्ते", "x" * 300, " " * 50, "\x00​", "don't 12.5 ®", ""]
    texts += ["".join(rng.choice("ab e thinrs  ▁é日🙂\n") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 1000, "=" * 3000, "".join(rng.choice("0123456789abcdef") for _ in range(2000)), "".join(rng.choice("aeinst") for _ in range(2000))]
    ids, bounds = machine.encode(texts)
    for t, a, b, back in zip(texts, bounds[:-1], bounds[1:], machine.decode(ids, bounds), strict=True):
        assert ids[a:b].tolist() == sp.encode(t) and back == sp.decode(ids[a:b].tolist()), t


def test_spines_agree_with_merging(pieces):
    """The compiled neighbour relation against merging the characters of both pieces."""
    _, machine, _ = pieces
    rng = np.random.default_rng(8)
    own = np.flatnonzero(machine.left >= 0)
    x, y = rng.choice(own, 50_000), rng.choice(own, 50_000)
    assert (machine.apart(x, y) == machine._apart_by_merging(x, y)).all()
    some = slice(0, 300)
    assert [machine._apart(int(a), int(b)) for a, b in zip(x[some], y[some])] == machine.apart(x[some], y[some]).tolist()


def test_the_models_own_normaliser():
    """Its table, read from the model, against the library's normaliser; pieces are single characters."""
    import sentencepiece

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf", add_dummy_prefix=True, remove_extra_whitespaces=True)
    blob = rule.serialized_model_proto()
    machine = pt.PieceTransducer.parse(blob)
    assert len(machine.rules) > 5000
    for t in ("Ｈｅｌｌｏ  Ｗｏｒｌｄ ", "ﬁne ½ ①②", " A\tb\nc  ", "Straße ÀÉ é", "ﾊﾝｶｸ ㌔", "", "   "):
        want = rule.normalize(t)
        assert machine.normal(t).replace(pt.MARK, " ").strip() == want.replace(pt.MARK, " ").strip(), t


def test_unigram_paths_are_least():
    """Against all segmentations, for a small table with scores."""
    table_ = [("<unk>", 0.0, pt.UNKNOWN), *((p, s, pt.NORMAL) for p, s in (("▁", -2.0), ("a", -3.0), ("b", -3.5), ("ab", -4.0), ("▁a", -2.5), ("aba", -5.0), ("▁ab", -6.5)))]
    machine = pt.PieceTransducer(table_, pt.UNIGRAM)
    score = {p: s for p, s, _ in table_[1:]}

    def every(t):
        if not t:
            yield 0.0, []
        for k in range(1, len(t) + 1):
            if t[:k] in score:
                for c, rest in every(t[k:]):
                    yield c - score[t[:k]], [t[:k], *rest]

    for t in ("▁ab", "▁abab", "▁aabba", "▁babab"):
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        best = [[i for i, (p, _, _) in enumerate(table_) if p == q][0] for q in min(every(t), key=lambda x: x[0])[1]]
        assert machine.path_alone(points) == best
        assert machine.paths(points, np.array([0, len(t)]))[0].tolist() == best
    ids, bounds = machine.encode(["q", "qq a", ""])
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[1, 0], [1, 0, 5], []]


def test_operator(spark, pieces):
    path, _, sp = pieces
    out = pt.decode_pieces(pt.encode_pieces(table(spark).withColumn("decoded", F.lit(1)), path), path).collect()
    assert len(out) == len(rows())
    for r in out:
        assert (r.ids is None and r.decoded is None) if r.text is None else (r.ids == sp.encode(r.text) and r.decoded == r.text)
    assert pt.decode_pieces(pt.encode_pieces(empty(spark), path), path).count() == 0
