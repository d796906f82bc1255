from collections import Counter

import corpus_pipeline
from helpers import rows
from test_language_and_quality import brute_measures
from test_near_dedup import brute_force, copies


def test_stages_against_plain_loops(spark, tmp_path):
    """Base rules, language, one of each class, and every kept text in the packed pieces."""
    data = [(i, t) for i, t in rows() + copies() if i is not None]
    data.append((9000, data[0][1] and "mail joe@example.com now " + " ".join(f"w{k}" for k in range(40))))
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = [(i, t) for i, t in data if not brute_measures(t)[-1]]
    assert Counter(r.doc_id for r in kept["quality_rules"]) == Counter(i for i, _ in good)
    assert len(kept["language_id"]) == len(good)
    assert len(kept["near_dedup"]) == brute_force(good)[1]
    redacted = {r.doc_id: r for r in kept["personal_data"]}[9000]
    assert redacted.text.startswith("mail [EMAIL] now") and redacted.n_chars == len(redacted.text)
    assert {r.doc_id for r in kept["best_fit_packing"]} == {r.doc_id for r in kept["personal_data"]}


CLASHING = ["kept", "ratio", "n_words", "base_failed", "lang_pred", "score", "Known_Letters", "n_email", "base", "spans", "redacted", "node", "_id", "_node", "_row", "_text", "_g", "_h1", "label", "keep"]


def test_columns_of_clashing_names_keep_their_values(spark, tmp_path):
    from pyspark.sql import functions as F

    words = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(1, words + " joe@example.com", "en", 9), (2, words.replace("w", "v"), "en", 9)], "doc_id long, text string, lang string, n_chars long")
    docs = docs.select("*", *(F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in CLASHING))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # the labelled ids are those whose crc32 leaves a remainder
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows_ = out.collect()
        assert len(rows_) == 2, name
        assert all(r[c] == f"{c}:{r.doc_id}" for r in rows_ for c in CLASHING), name
        docs = corpus_pipeline.written(out, name)
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()} == {1, 2}


def test_empty_table_and_nulls_in_every_column(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data in ([], [(None,) * 5] * 3):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() == (0 if not data or name in ("quality_rules", "language_id") else 3), name


def test_a_text_in_an_unlearned_script_goes(spark, tmp_path):
    words = " ".join(f"word{k}" for k in "abcdefghijklmnopqrstuvwxyz")
    docs = [(k, words, "en", "s", 1) for k in range(5)] + [(9, "这是一个没有学过的文字 " * 5, None, "s", 1)]
    out = corpus_pipeline.language(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {0, 1, 2, 3, 4}
