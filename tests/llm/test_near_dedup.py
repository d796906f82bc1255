import random
from collections import Counter, defaultdict

import numpy as np
from helpers import SCHEMA, WORDS, empty, rows, table

from lodestone.llm import near_dedup as nd


def copies(seed=2):
    rng, out = random.Random(seed), []
    for _ in range(4):
        base = [rng.choice(WORDS) for _ in range(rng.choice([40, 120, 180]))]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randint(0, 7)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            out.append(" ".join(own))
    return [(1000 + i, t) for i, t in enumerate(out)]


def brute_force(data):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = [shingles(t) for _, t in data], list(range(len(data)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = data[i][1] is not None and data[i][1] == data[j][1]
            if same or (a and b and 9 * len(a & b) >= 4 * (len(a) + len(b))):
                up[top(i)] = top(j)
    classes = defaultdict(list)
    for i in range(len(data)):
        classes[top(i)].append(data[i][0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return Counter((i, least(ids)) for ids in classes.values() for i in ids), len(classes)


def test_classes_equal_brute_force(spark):
    data = rows() + copies()
    want, n = brute_force(data)
    got = nd.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    assert sum(r.kept for r in got) == n


def test_deduplicated_keeps_one_row_and_all_columns(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, f"x{i}", 1, -7, None) for i, t in data], "doc_id long, text string, node string, kept int, _id int, _node string")
    out = nd.deduplicated(df)
    assert out.columns == df.columns and out.count() == brute_force(data)[1]
    assert all((r.node, r.kept, r._id, r._node) == (f"x{r.doc_id}", 1, -7, None) for r in out.collect())


def test_empty(spark):
    assert nd.near_duplicates(empty(spark)).count() == 0
    assert table(spark).count() > 0


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    a, b = {i: rng.integers(1, 5) for i in range(60)}, {i: rng.integers(1, 5) for i in range(20, 80)}
    doc = np.repeat([0, 1], [len(a), len(b)])
    element = nd.mix(np.array([*a, *b], np.uint64) + np.uint64(7))
    sig = nd.prob_minhash(doc, element, np.array([*a.values(), *b.values()], float), 2, 4096)
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in {*a} & {*b})
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def test_repetition_hides_no_pair(spark):
    """Pairs with a Jaccard of 0.8 and more, of which one text repeats a part 50 times."""
    rng, data = random.Random(6), []
    for k in range(60):
        base = [f"p{k}x{i}" for i in range(170)]
        part = [f"q{k}x{rng.randrange(10**6)}" for _ in range(36)]
        data += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + 50 * part))]
    want, n = brute_force(data)
    assert n == 60
    got = nd.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == want


def texts_in_groups(seed=11, groups=25, size=8):
    """Variants of texts with repeated passages: (id, text); ids divisible by 50 are the queries."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 150, 300]))]
        passage = base[5:25] * rng.choice([0, 1, 50])
        for _ in range(size):
            own = base + passage * rng.randint(0, 1)
            for _ in range(rng.randint(0, len(base) // 60)):
                own[rng.randrange(len(base))] = f"n{rng.randrange(10**6)}"
            out.append((len(out), " ".join(own)))
    return out


def test_recall_of_banding(spark):
    """Of the pairs of similarity 0.8 and more of a query (ids divisible by 50) with any row, the share that shares a band."""
    data = texts_in_groups()
    df = spark.createDataFrame([(i, t) for i, t in data], "node long, text string")
    signed = {r.node: set(r.bands) for r in df.mapInArrow(nd._signed(nd.BANDS, nd.ROWS), "node long, n_shingles int, bands array<long>").collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in data}
    pairs = [(q, i) for q in sets if q % 50 == 0 for i in sets if i != q and 9 * len(sets[q] & sets[i]) >= 4 * (len(sets[q]) + len(sets[i]))]
    assert len(pairs) >= 8
    every = [(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    for some in (pairs, every):
        assert sum(bool(signed[a] & signed[b]) for a, b in some) >= 0.99 * len(some)


def test_outsiders_meet_all_candidates(spark, monkeypatch):
    """Chains of near copies: the ends aren't like the hub, but like each other's neighbours; in small blocks, by band and at once."""
    monkeypatch.setattr(nd, "BLOCK", 3)
    rng, data = random.Random(3), []
    for g in range(3):
        own = [f"c{g}w{i}" for i in range(100)]
        for k in range(12):
            data.append((len(data), " ".join(own)))
            for _ in range(2):
                own[rng.randrange(100)] = f"c{g}n{k}x{rng.randrange(10**6)}"
    want, _ = brute_force(data)
    got = nd.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == want


def test_texts_of_one_hash_stay_apart(spark, monkeypatch):
    """With a first hash that is the same for all texts."""
    from pyspark.sql import functions as F

    data = [(1, "a b c d e f"), (2, "q r s t u v"), (3, "a b c d e f"), (4, None), (5, "")]
    true_hash = F.xxhash64
    monkeypatch.setattr(nd.F, "xxhash64", lambda *c: true_hash(*c) if c != ("text",) else F.lit(7).cast("long"))
    monkeypatch.setattr(nd, "_second", lambda text: F.when(F.col(text) == "q r s t u v", true_hash(text)).otherwise(F.lit(-1).cast("long")))
    got = nd.near_duplicates(spark.createDataFrame(data[:4], SCHEMA)).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(1, 1), (2, 2), (3, 1), (4, 4)}
