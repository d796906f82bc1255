import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import empty, rows, table
from pyspark.sql import functions as F

from lodestone.llm import language_id as li
from lodestone.llm import quality_rules as qr

DATA = "/root/testdata/sf0.001"


def brute_phrases(text, sample):
    """Longest phrases that occur in the sample, over the whole text."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1 + (text[at] not in sample)
    return n


@pytest.mark.parametrize("block", [1, 7, 64, 1024])
def test_phrases_equal_substring_search(monkeypatch, block):
    """Texts of up to 10,000 characters, whose phrases cross the blocks; a repeated one, on which parses join late."""
    monkeypatch.setattr(li, "BLOCK", block)
    rng = random.Random(9)
    samples = {k: "".join(rng.choice(a) for _ in range(300)) for k, a in (("x", "abc d"), ("y", "bcde "))}
    samples["z"] = "ab" * 200
    parser = li.CrossParser(samples)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 2500))) for _ in range(20)] + ["", "f", "a", "ab" * 1000, "a" + "ab" * 700]
    texts.append("".join(rng.choice("abcd ") for _ in range(10_000)))
    code = {c: i for i, c in enumerate(parser.alphabet)}
    flat = np.array([code.get(c, len(code)) for t in texts for c in t], np.int64)
    got = parser.phrases(flat, np.cumsum([0, *map(len, texts)]))
    assert got.tolist() == [[brute_phrases(t, samples[k]) for t in texts] for k in ("x", "y", "z")]


def test_many_letters_and_many_languages(spark):
    """3,000 distinct letters take little room; 40 languages keep their whole samples; of more than ``max_languages`` the largest are learned."""
    import pickle

    rng = random.Random(1)
    han = [chr(0x4E00 + i) for i in range(3000)]
    labelled = [(0, "".join(rng.choice(han) for _ in range(9000)), "zh")]
    words = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(50)] for k in range(40)}
    labelled += [(k * 2 + i + 1, " ".join(rng.choice(w) for _ in range(300)), name) for k, (name, w) in enumerate(words.items()) for i in range(2)]
    df = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    samples = li.sample(df, "doc_id", "text", "lang", 32, 30_000, 64)
    assert len(samples) == 41 and all(len(s) > 2000 for s in samples.values())
    assert len(pickle.dumps(li.CrossParser({"zh": samples["zh"]}))) < 4_000_000
    asked = [(k, " ".join(rng.choice(w) for _ in range(40)), name) for k, (name, w) in enumerate(words.items())] + [(99, "".join(rng.choice(han) for _ in range(30)), "zh")]
    out = li.identify_language(spark.createDataFrame(asked, "doc_id long, text string, want string"), df).collect()
    assert all(r.lang_pred == r.want and r.known_letters > 0.9 for r in out)
    assert "zh" not in li.sample(df, "doc_id", "text", "lang", 32, 30_000, 40)


def test_ties_go_to_the_first_language_by_name(spark):
    labelled = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id long, text string, lang string")
    out = li.identify_language(spark.createDataFrame([(1, "same words")], "doc_id long, text string"), labelled).first()
    assert out.lang_pred == "a" and out.score == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("held_out", li.crc_bucket(F.col("doc_id"), 5) == 0)
    out = li.identify_language(docs, docs.where("not held_out")).where("held_out and n_chars > 40").collect()
    assert len(out) > 20 and sum(r.lang == r.lang_pred for r in out) / len(out) >= 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in out)


def test_language_of_hard_rows(spark):
    labelled = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "?!", "fr"), (5, "x", None)], "doc_id long, text string, lang string")
    df = table(spark).withColumn("score", F.lit("mine"))
    out = li.identify_language(df, labelled).collect()
    assert Counter(r.text for r in out) == Counter(t for _, t in rows())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    assert {r.lang_pred for r in li.identify_language(df, labelled.where("false")).collect()} == {"und"}
    assert li.identify_language(empty(spark), labelled).count() == 0


def brute_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def hard_texts():
    rng = random.Random(3)
    loop = " ".join(f"w{i % 9}" for i in range(60))
    mixed = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) for _ in range(40)]
    return [t for _, t in rows()] + [loop, loop + " x " + loop, "a\na\n\n \nb\na", "é| <b>#*$%&|", "a\x0bb\x0cc\rd\te", "  x y"] + mixed


def test_measures_equal_brute_force(spark):
    texts = hard_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'mine' AS Kept", "1 AS _words", "2 AS _h1")
    trusted = spark.createDataFrame([(0,), (None,), (5,), (5,)], "doc_id long")
    got = {r.doc_id: tuple(r[m] for m in qr.MEASURES) for r in qr.quality_rules(df, trusted).collect()}
    assert got == {i: brute_measures(t) for i, t in enumerate(texts)}


def brute_ratios(texts, groups, trusted, buckets, folds=4, prior=1.0):
    """The ratio of every text, by plain counts: models of its group without the trusted texts of its fold."""
    h = lambda w: xxhash.xxh64(w.encode(), seed=42).intdigest()

    def grams(t):
        one = [h(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return [x % buckets for x in one] + [((a << 1) & (2**64 - 1) ^ b) % buckets for a, b in zip(one, one[1:])]

    # a signed hash; that of a null is the seed
    signed = lambda t: 42 if t is None else (x := h(t)) - (x >> 63 << 64)
    fold = [signed(t) % folds for t in texts]
    out = []
    for i, t in enumerate(texts):
        own = [k for k in range(len(texts)) if groups[k] == groups[i]]
        raw = Counter(g for k in own for g in grams(texts[k]))
        good = Counter(g for k in own if k in trusted and fold[k] != fold[i] for g in grams(texts[k]))
        mass, total = prior * buckets, 0
        for g in grams(t):
            p = (raw[g] + prior) / (raw.total() + mass)
            total += round(1e6 * math.log((good[g] / p + mass) / (good.total() + mass)))
        n = len(grams(t))
        out.append(total // n if n and any(k in trusted for k in own) else 0)
    return out


def test_ratio_equals_brute_force(spark):
    texts, trusted = hard_texts(), {0, 5, 7, 8, 9, 11, 12, 15, 60, 61, 62, 63, 64, 65}
    want = brute_ratios(texts, [0] * len(texts), trusted, 64)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = qr.quality_rules(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), buckets=64).collect()
    assert [r.ratio for r in sorted(out, key=lambda r: r.doc_id)] == want and any(want)
    assert all(r.kept == (not r.base_failed and r.ratio >= -60_000) for r in out)


def test_groups_and_cuts_equal_brute_force(spark):
    texts, trusted = hard_texts(), {0, 5, 7, 8, 9, 11, 12, 15, 60, 61, 62, 63, 64, 65}
    groups = [(i // 2) % 4 if i % 2 else 0 for i in range(len(texts))]
    want = brute_ratios(texts, groups, trusted, 64)
    df = spark.createDataFrame([(str(i), t, str(groups[i])) for i, t in enumerate(texts)], "doc_id string, text string, lang string")
    good = spark.createDataFrame([(str(i),) for i in trusted], "doc_id string")
    out = sorted(qr.quality_rules(df, good, buckets=64, group="lang", loss=0.0).collect(), key=lambda r: int(r.doc_id))
    assert [r.ratio for r in out] == want
    for g in set(groups):
        low = min((want[i] for i in trusted if groups[i] == g and brute_measures(texts[i])[0] >= 20), default=-(10**9))
        assert all(r.kept == (not r.base_failed and r.ratio >= low) for r in out if r.lang == str(g))
    # more groups than models: those with the most trusted documents, then the rest together
    ranked = [g for g, _ in sorted(Counter(groups[i] for i in trusted).items(), key=lambda x: (-x[1], str(x[0])))]
    pooled = [g if g in ranked[:2] else -1 for g in groups]
    out = sorted(qr.quality_rules(df, good, buckets=64, group="lang", loss=0.0, max_groups=2).collect(), key=lambda r: int(r.doc_id))
    assert [r.ratio for r in out] == brute_ratios(texts, pooled, trusted, 64)


def test_every_trusted_document_counts(spark):
    """Of 300,000 trusted ids each counts: none are left out of the groups, models or cuts."""
    texts, trusted = hard_texts(), {0, 5, 7, 8, 9, 11, 12, 15, 60, 61, 62, 63, 64, 65}
    groups = [(i // 2) % 4 if i % 2 else 0 for i in range(len(texts))]
    want = brute_ratios(texts, groups, trusted, 64)
    df = spark.createDataFrame([(i, t, str(groups[i])) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    good = spark.range(-300_000, 0).unionByName(spark.createDataFrame([(i,) for i in trusted], "id long"))
    out = sorted(qr.quality_rules(df, good, buckets=64, group="lang", loss=0.0).collect(), key=lambda r: r.doc_id)
    assert [r.ratio for r in out] == want
    for g in set(groups):
        low = min((want[i] for i in trusted if groups[i] == g and brute_measures(texts[i])[0] >= 20), default=-(10**9))
        assert all(r.kept == (not r.base_failed and r.ratio >= low) for r in out if r.lang == str(g))


def test_shuffled_ids_equal_broadcast_ones(spark, monkeypatch):
    """Null and repeated ids, and a sieve so small that most rows pass it: the join decides."""
    df = table(spark, n=120).withColumn("lang", F.when(F.length("text") % 3 == 0, "x"))
    good = spark.createDataFrame([(i,) for i in [*range(0, 60, 2), 3, 3, 100, 102, 105, None]], "doc_id long")
    run = lambda: Counter(qr.quality_rules(df, good, buckets=64, group="lang", loss=0.1).collect())
    want = run()
    assert qr.Trust(good).few
    monkeypatch.setattr(qr, "BROADCAST_IDS", 3)
    for slots, chunk in ((64, 1), (256, 2)):
        monkeypatch.setattr(qr, "SLOTS", slots)
        monkeypatch.setattr(qr, "CHUNK", chunk)
        trust = qr.Trust(good)
        own = df.selectExpr("CAST(doc_id AS string) _id", "text")
        assert not trust.few and trust.sieve.count() == slots // 64 // chunk
        assert trust.marked(own).count() == df.count() and trust.only(own).count() == own.join(trust.ids, "_id").count()
        assert run() == want


def test_a_label_does_not_change_its_own_verdict(spark):
    texts = hard_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratio = lambda ids: {r.doc_id: r.ratio for r in qr.quality_rules(df, spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    with_, without = ratio([0, 5, 7, 60, 61]), ratio([0, 5, 7, 60])
    assert with_[61] == without[61] and with_ != without


def test_quality_without_rows_or_trust(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert qr.quality_rules(empty(spark), none).count() == 0
    out = qr.quality_rules(table(spark), none).where("kept").collect()
    assert all(r.ratio == 0 and not r.base_failed for r in out) and out


def labelled_languages(path, spark):
    """300 clean documents of each of two languages, of which en has 150 trusted ones and de 60; 20 of junk in each."""
    rng, docs, good = random.Random(8), [], []
    for lang, n in (("en", 150), ("de", 60)):
        vocabulary = [f"{lang}{i}" for i in range(60)]
        for k in range(300):
            docs.append((len(docs), " ".join(rng.choice(vocabulary) for _ in range(60)), lang))
            good += [docs[-1][0]] * (k < n)
        docs += [(len(docs) + k, " ".join(f"junk{rng.randrange(400)}" for _ in range(60)), lang) for k in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, set(good)


def test_clean_documents_of_an_under_labelled_language_are_kept(spark, tmp_path):
    import corpus_pipeline

    from lodestone.llm.queries import op10_ngram_ratio

    docs, good = labelled_languages(tmp_path, spark)
    kept = {r.doc_id for r in op10_ngram_ratio(spark, str(tmp_path)).where("kept").collect()}
    for lang in ("en", "de"):
        clean = [i for i, t, x in docs if x == lang and i not in good and "junk" not in t]
        junk = [i for i, t, x in docs if x == lang and "junk" in t]
        assert len(kept & set(clean)) >= 0.9 * len(clean) and not kept & set(junk), lang
    stage = corpus_pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in stage.collect()} == kept
