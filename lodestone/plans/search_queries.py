"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import retrieval as r
from lodestone.plans.registry import query
from lodestone.plans.views import sql, view

QUERY_ID, TEXT, TERMS = 7, "the thing of that", ["the", "that", "thing"]
_COS = f"round(list_cosine_similarity(CAST(v.vector AS DOUBLE[]), (SELECT CAST(vector AS DOUBLE[]) FROM vectors WHERE vec_id = {QUERY_ID})), 6)"


def _tables(spark, sf_dir):
    return view(spark, sf_dir, "chunks"), view(spark, sf_dir, "vectors")


def _target(vectors) -> list[float]:
    return [float(x) for x in vectors.where(f"vec_id = {QUERY_ID}").first()["vector"]]


def _knn(limit: int, where: str = "TRUE") -> str:
    return f"(SELECT c.id, c.repository_id, c.file_path, c.start_line, c.end_line, {_COS} AS score FROM chunks c JOIN vectors v ON v.chunk_id = c.id WHERE {where} ORDER BY score DESC, id LIMIT {limit})"


SHOWN = ("id", "score")
FILTER = "c.language IN ('en') AND c.node_type IN ('function', 'class')"


@query("knn_scan", sql(f"SELECT id, score FROM {_knn(10)}", "chunks", "vectors"))
def knn_scan(spark, sf_dir):
    chunks, vectors = _tables(spark, sf_dir)
    return r.knn_scan(chunks, vectors, _target(vectors)).select(*SHOWN)


@query("flt_search", sql(f"SELECT id, score FROM {_knn(10, FILTER)}", "chunks", "vectors"))
def flt_search(spark, sf_dir):
    chunks, vectors = _tables(spark, sf_dir)
    return r.knn_scan(r.matching(chunks, ["en"], ["function", "class"]), vectors, _target(vectors)).select(*SHOWN)


@query("min_score", sql(f"SELECT id, score FROM {_knn(10)} WHERE score >= 0.2", "chunks", "vectors"))
def min_score(spark, sf_dir):
    chunks, vectors = _tables(spark, sf_dir)
    return r.knn_scan(chunks, vectors, _target(vectors), min_score=0.2).select(*SHOWN)


@query("knn_hnsw")
def knn_hnsw(spark, sf_dir):
    """Approximate candidates, then exact scores; knn_scan is the exact form. tests/test_retrieval.py measures recall."""
    chunks, vectors = _tables(spark, sf_dir)
    return r.knn_two_stage(chunks, vectors, _target(vectors)).select(*SHOWN)


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_TERMS = "(SELECT unnest(['of', 'that', 'the', 'thing']) AS t)"
_BM25 = f"""(WITH w AS (SELECT id, repository_id, file_path, start_line, end_line, {_WORDS.format("concat_ws(' ', content, symbol_name)")} AS ws FROM chunks),
tf AS (SELECT w.*, t.t, CAST(len(list_filter(ws, lambda x: x = t.t)) AS DOUBLE) AS f, CAST(len(ws) AS DOUBLE) AS dl FROM w, {_TERMS} t),
g AS (SELECT avg(len(ws)) AS av, count(*) AS n FROM w), df AS (SELECT t, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END) AS d FROM tf GROUP BY t)
SELECT id, repository_id, file_path, start_line, end_line, round(sum(ln(1 + (g.n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / g.av))), 6) AS score FROM tf JOIN df USING (t), g GROUP BY ALL HAVING sum(f) > 0 ORDER BY score DESC, id LIMIT 10)"""


@query("bm25", sql(f"SELECT id, score FROM {_BM25}", "chunks"))
def bm25(spark, sf_dir):
    return r.bm25(view(spark, sf_dir, "chunks"), TEXT).select(*SHOWN)


@query("bm25_index", sql(f"SELECT id, score FROM {_BM25}", "chunks"))
def bm25_index(spark, sf_dir):
    """From postings that are built once for many queries."""
    chunks = view(spark, sf_dir, "chunks")
    return r.TextIndex(chunks).bm25(chunks, TEXT).select(*SHOWN)


def _overlap(limit: int) -> str:
    points = " + ".join(f"CAST(contains(lower(content), '{t}') AS INT) + 2 * CAST(contains(lower(coalesce(symbol_name, '')), '{t}') AS INT)" for t in TERMS)
    return f"(SELECT id, repository_id, file_path, start_line, end_line, round(({points}) / {3.0 * len(TERMS)}::DOUBLE, 6) AS score FROM chunks WHERE ({points}) > 0 ORDER BY score DESC, id LIMIT {limit})"


@query("text_overlap", sql(f"SELECT id, score FROM {_overlap(10)}", "chunks"))
def text_overlap(spark, sf_dir):
    return r.text_overlap(view(spark, sf_dir, "chunks"), TERMS).select(*SHOWN)


def _rrf(legs: list[str], limit: int) -> str:
    parts = " UNION ALL ".join(f"SELECT *, CAST(1.0 AS DOUBLE) / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part FROM {leg}" for leg in legs)
    return f"(WITH every AS ({parts}), fused AS (SELECT id, any_value(repository_id) AS repository_id, any_value(file_path) AS file_path, any_value(start_line) AS start_line, any_value(end_line) AS end_line, round(sum(part), 6) AS score FROM every GROUP BY id) SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY repository_id, file_path, start_line, end_line ORDER BY score DESC, id) = 1 ORDER BY score DESC, id LIMIT {limit})"


@query("rrf", sql(f"SELECT id, score FROM {_rrf([_knn(20), _overlap(20)], 15)}", "chunks", "vectors"))
def rrf(spark, sf_dir):
    chunks, vectors = _tables(spark, sf_dir)
    return r.rrf([r.knn_scan(chunks, vectors, _target(vectors), 20), r.text_overlap(chunks, TERMS, 20)], 15).select(*SHOWN)


@query("hybrid", sql(f"SELECT id, score FROM {_rrf([_knn(10), _BM25], 10)}", "chunks", "vectors"))
def hybrid(spark, sf_dir):
    chunks, vectors = _tables(spark, sf_dir)
    return r.hybrid(chunks, vectors, _target(vectors), TEXT).select(*SHOWN)


@query("hybrid_mem", sql(f"SELECT id, score FROM {_rrf([_knn(20), _overlap(20)], 10)} WHERE score >= 0.01", "chunks", "vectors"))
def hybrid_mem(spark, sf_dir):
    chunks, vectors = _tables(spark, sf_dir)
    return r.hybrid_overlap(chunks, vectors, _target(vectors), " ".join(TERMS), 10, 0.01).select(*SHOWN)


@query("test_penalty", sql(f"SELECT id, CASE WHEN contains(file_path, '/tests/') THEN round(score * 0.5, 6) ELSE score END AS score FROM {_knn(50)}", "chunks", "vectors"))
def test_penalty(spark, sf_dir):
    chunks, vectors = _tables(spark, sf_dir)
    return r.test_penalty(r.knn_scan(chunks, vectors, _target(vectors), 50)).select(*SHOWN)


@query("query_expand", sql(f"SELECT id, score FROM {_rrf([_overlap(20), _overlap(20).replace(chr(39) + 'the' + chr(39), chr(39) + 'ing' + chr(39))], 10)}", "chunks"))
def query_expand(spark, sf_dir):
    chunks = view(spark, sf_dir, "chunks")
    return r.rrf([r.text_overlap(chunks, t, 20) for t in (TERMS, ["ing", *TERMS[1:]])], 10).select(*SHOWN)


@query("fetch_limit", "SELECT * FROM (VALUES (10, 27), (50, 63), (100, 122)) t(asked, fetched)")
def fetch_limit(spark, sf_dir):
    return spark.createDataFrame([(n, r.fetch_limit(n, True)) for n in (10, 50, 100)], "asked int, fetched int")


def _definitions(chunks, references):
    """Chunks that define the symbols of the call graph: one for each callee, named without its class."""
    own = references.groupBy("callee_symbol").agg(F.min("reference_file_path").alias("file_path"), F.min("repository_id").alias("repository_id"))
    return own.select(
        F.concat(F.lit("d"), "callee_symbol").alias("id"), "file_path", F.lit("").alias("content"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit("python").alias("language"),
        F.lit("function").alias("node_type"), F.col("callee_symbol").alias("symbol_name"), F.lit(None).cast("string").alias("parent_symbol"), "repository_id",
    )


_IMPACT = "('call', 'method_call', 'instantiation', 'macro_invocation', 'implementation', 'inheritance')"


@query("graph_expand", sql(f"""+ defs AS (SELECT DISTINCT 'd' || callee_symbol AS id, callee_symbol AS name FROM refs), seeds AS (SELECT name AS seed FROM defs WHERE contains(lower(name), 'm20') ORDER BY id LIMIT 5),
ed AS (SELECT * FROM refs WHERE reference_kind IN {_IMPACT} AND caller_symbol IS NOT NULL), nr AS (SELECT *, row_number() OVER (PARTITION BY seed, side ORDER BY reference_file_path, reference_line, id) AS n FROM (
SELECT seed, 'up' AS side, caller_symbol AS symbol, reference_file_path, reference_line, id FROM ed JOIN seeds ON callee_symbol = seed UNION ALL SELECT seed, 'down', callee_symbol, reference_file_path, reference_line, id FROM ed JOIN seeds ON caller_symbol = seed)),
ag AS (SELECT symbol, count(DISTINCT seed) AS seeds, count(*) AS edges FROM nr WHERE n <= 25 AND symbol NOT IN (SELECT seed FROM seeds) GROUP BY symbol)
SELECT id, seeds + edges / 1000.0::DOUBLE AS score FROM ag JOIN defs ON name = symbol ORDER BY seeds DESC, edges DESC, symbol LIMIT 20""", "refs"))
def graph_expand(spark, sf_dir):
    references = view(spark, sf_dir, "refs")
    chunks = _definitions(None, references)
    short = chunks.withColumn("symbol_name", F.substring_index("symbol_name", "#", -1))
    seeds = r.text_overlap(chunks, ["m20"], 5)
    return r.graph_expand(seeds, references, short).select(*SHOWN)


_HASHED = f"(('0x' || left(sha256('{TEXT}' || coalesce(symbol_name, '') || ' [' || node_type || '] ' || content), 8))::BIGINT % 10000) / 10000.0::DOUBLE"
_RERANKED = "SELECT id, h AS score FROM (SELECT id, {0} AS h FROM {1} JOIN (SELECT id, symbol_name, node_type, content FROM chunks) USING (id) ORDER BY h DESC, id LIMIT {2}) {3}"


@query("rerank", sql(_RERANKED.format(_HASHED, _knn(20), 10, ""), "chunks", "vectors"))
def rerank(spark, sf_dir):
    chunks, vectors = _tables(spark, sf_dir)
    return r.rerank(r.knn_scan(chunks, vectors, _target(vectors), 20), TEXT, r.hash_scorer, 10).select(*SHOWN)


@query("post_floor", sql(_RERANKED.format(_HASHED, _knn(20), 20, "WHERE h >= 0.1"), "chunks", "vectors"))
def post_floor(spark, sf_dir):
    chunks, vectors = _tables(spark, sf_dir)
    return r.rerank(r.knn_scan(chunks, vectors, _target(vectors), 20), TEXT, r.hash_scorer, 20).where(F.col("score") >= r.FLOOR).select(*SHOWN)


# words are no symbols of the references here, so no graph leg comes in; graph_expand has a twin of its own
@query("search", sql(_RERANKED.format(_HASHED, _rrf([_knn(27), _BM25], 27), 10, "WHERE h >= 0.1"), "chunks", "vectors"))
def search(spark, sf_dir):
    chunks, vectors = _tables(spark, sf_dir)
    return r.search(chunks, vectors, view(spark, sf_dir, "refs"), _target(vectors), TEXT, 10, r.hash_scorer).select(*SHOWN)


@query("snip_line", sql("SELECT repository_id, file_path, 1 AS line, arg_min(id, (end_line - start_line, id)) AS id FROM chunks WHERE 1 BETWEEN start_line AND end_line GROUP BY ALL", "chunks"))
def snip_line(spark, sf_dir):
    chunks = view(spark, sf_dir, "chunks")
    return r.chunk_at(chunks, chunks.select("repository_id", "file_path", F.lit(1).alias("line")).distinct()).select("repository_id", "file_path", "line", "id")


@query("snip_symbol", sql("SELECT id, file_path FROM chunks WHERE symbol_name = 'The' ORDER BY contains(file_path, 'src3') DESC, end_line - start_line, id LIMIT 1", "chunks"))
def snip_symbol(spark, sf_dir):
    return r.chunk_of_symbol(view(spark, sf_dir, "chunks"), "The", "src3").select("id", "file_path")


@query("chunks_file", sql("SELECT id, start_line FROM chunks WHERE file_path LIKE 'src0/%'", "chunks"))
def chunks_file(spark, sf_dir):
    return view(spark, sf_dir, "chunks").where(F.startswith("file_path", F.lit("src0/"))).select("id", "start_line")


@query("chunks_symbols", sql("SELECT id, symbol_name FROM chunks WHERE symbol_name IN ('The', 'Of', 'Th')", "chunks"))
def chunks_symbols(spark, sf_dir):
    return view(spark, sf_dir, "chunks").where(F.col("symbol_name").isin("The", "Of", "Th")).select("id", "symbol_name")


@query("symbol_file_map", sql("SELECT symbol_name, file_path FROM chunks WHERE symbol_name IS NOT NULL", "chunks"))
def symbol_file_map(spark, sf_dir):
    return view(spark, sf_dir, "chunks").where("symbol_name is not null").select("symbol_name", "file_path")


@query("has_vectors", "SELECT count(*) > 0 AS has, count(*) AS n FROM embeddings")
def has_vectors(spark, sf_dir):
    return view(spark, sf_dir, "vectors").agg((F.count("*") > 0).alias("has"), F.count("*").alias("n"))


@query("embed_mock")
def embed_mock(spark, sf_dir):
    """A stand-in for an embedding model: unit vectors of hashed words."""
    from lodestone.operators.embedding import hashed_embedding

    return view(spark, sf_dir, "chunks").select("id", hashed_embedding(F.col("content"), 16).alias("vector"))


@query("embed")
def embed(spark, sf_dir):
    from lodestone.operators.embedding import embed as run
    from lodestone.operators.embedding import hashed_embedding

    return run(view(spark, sf_dir, "chunks"), lambda c: hashed_embedding(c, 8), "hashed-8")


@query("count", "SELECT count(*) AS n FROM embeddings")
def count(spark, sf_dir):
    return view(spark, sf_dir, "vectors").agg(F.count("*").alias("n"))


@query("pre_floor", sql(f"SELECT id, score FROM {_knn(50)} WHERE score >= 0.1", "chunks", "vectors"))
def pre_floor(spark, sf_dir):
    chunks, vectors = _tables(spark, sf_dir)
    return r.pre_floor(r.knn_scan(chunks, vectors, _target(vectors), 50), False).select(*SHOWN)


@query("rerank_llm", sql(f"SELECT id, CAST(length(content) AS DOUBLE) AS score FROM {_knn(10)} JOIN (SELECT id, content FROM chunks) USING (id)", "chunks", "vectors"))
def rerank_llm(spark, sf_dir):
    """A port that scores a list; this one goes by length."""
    chunks, vectors = _tables(spark, sf_dir)
    found = r.knn_scan(chunks, vectors, _target(vectors))
    return r.rerank_listed(found, TEXT, lambda _, texts: [len(t.split("] ", 1)[1]) for t in texts], 10).select(*SHOWN)


@query("rerank_mock", sql(_RERANKED.format(_HASHED.replace(TEXT, "another query"), _knn(50), 50, ""), "chunks", "vectors"))
def rerank_mock(spark, sf_dir):
    """The scorer that stands in for a model, over all of fifty results."""
    chunks, vectors = _tables(spark, sf_dir)
    return r.rerank(r.knn_scan(chunks, vectors, _target(vectors), 50), "another query", r.hash_scorer, 50).select(*SHOWN)
