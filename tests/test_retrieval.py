import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as r
from lodestone.plans.views import view

DATA = "/root/testdata/sf0.001"


def test_recall_of_the_approximate_leg(spark):
    """Queries: every vector whose id is divisible by 50, against all."""
    vectors = view(spark, DATA, "vectors").cache()
    chunks = vectors.select(F.col("chunk_id").alias("id"))
    hits = total = 0
    for q in vectors.where("vec_id % 50 = 0").orderBy("vec_id").collect():
        target = [float(x) for x in q.vector]
        exact = {x.id for x in r.knn_scan(chunks, vectors, target).collect()}
        found = {x.id for x in r.knn_two_stage(chunks, vectors, target).collect()}
        hits, total = hits + len(exact & found), total + len(exact)
    assert hits / total >= 0.9


def row(i, score, path="a.py", start=1):
    return (i, "r", path, start, start + 5, "python", "function", f"s{i}", None, "text", score)


COLUMNS = "id string, repository_id string, file_path string, start_line int, end_line int, language string, node_type string, symbol_name string, parent_symbol string, content string, score double"


def test_fusion_dedups_locations_and_adds_ranks(spark):
    one = spark.createDataFrame([row("a", 0.9), row("b", 0.8, "b.py")], COLUMNS)
    two = spark.createDataFrame([row("b", 5.0, "b.py"), row("c", 4.0)], COLUMNS)
    got = [(x.id, x.score) for x in r.rrf([one, two], 10).collect()]
    assert got == [("b", round(1 / 61 + 1 / 62, 6)), ("a", round(1 / 61, 6))]


def test_penalty_and_floors(spark):
    df = spark.createDataFrame([row("a", 0.15, "tests/a.py"), row("b", 0.05)], COLUMNS)
    assert {x.id: x.score for x in r.test_penalty(df).collect()} == {"a": 0.075, "b": 0.05}
    assert [x.id for x in r.pre_floor(df, False).collect()] == ["a"] and r.pre_floor(df, True).count() == 2


def test_failed_list_scorer_keeps_scores(spark):
    df = spark.createDataFrame([row("a", 0.1), row("b", 0.2)], COLUMNS)
    assert [x.id for x in r.rerank_listed(df, "q", lambda *_: [1.0], 5).collect()] == ["b", "a"]
    assert [x.id for x in r.rerank_listed(df, "q", lambda _, t: [0.1, 0.9], 5).collect()] == ["a", "b"]


def test_fetch_limits():
    assert [r.fetch_limit(n, True) for n in (10, 50, 100)] == [27, 63, 122] and r.fetch_limit(10, False) == 10


def test_an_index_gives_the_scores_of_the_scan(spark):
    from lodestone.operators import retrieval as r

    rows = [(f"c{i}", "r", f"f{i}.py", 1, 2, " ".join(["alpha"] * (i % 3) + ["beta"] * (i % 2) + ["Gamma!"] * i), "alpha" if i == 4 else None) for i in range(8)] + [("empty", "r", "e.py", 1, 2, None, None)]
    chunks = spark.createDataFrame(rows, "id string, repository_id string, file_path string, start_line int, end_line int, content string, symbol_name string")
    index = r.TextIndex(chunks)
    for query in ("alpha", "beta gamma", "nothing", ""):
        assert [(x.id, x.score) for x in index.bm25(chunks, query).collect()] == [(x.id, x.score) for x in r.bm25(chunks, query).collect()], query
    assert r.TextIndex(chunks.where("false")).bm25(chunks, "alpha").count() == 0


def test_a_port_is_asked_for_a_page_at_most(spark, monkeypatch):
    from lodestone.operators import retrieval as r

    monkeypatch.setattr(r, "LISTED", 2)
    rows = spark.createDataFrame([(f"c{i}", None, "block", "x", float(i)) for i in range(3)], "id string, symbol_name string, node_type string, content string, score double")
    with pytest.raises(ValueError):
        r.rerank_listed(rows, "q", lambda q, texts: [1.0] * len(texts), 2)
    assert [x.id for x in r.rerank_listed(rows.limit(2), "q", lambda q, texts: [0.1, 0.9], 2).collect()] == ["c0", "c1"]
