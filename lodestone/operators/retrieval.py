"""Top-k retrieval: exact cosine and text legs, fusion by reciprocal rank, graph expansion and reranking.

Legs are DataFrames with chunk columns and a score; ties always go by chunk id.
Every ``orderBy().limit()`` is a top-k per task first, so only k rows of each
task meet.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.names import split_qualified
from lodestone.functions.paths import is_test_file
from lodestone.functions.weights import IMPACT_KINDS, cosine
from lodestone.storage import written

RRF_K = 60
TEST_PENALTY = 0.5
FLOOR = 0.1
TEXT_CANDIDATES = 10
LISTED = 1000
SEEDS, NEIGHBOURS, GRAPH_LEG = 5, 25, 20


def matching(chunks: DataFrame, languages: list[str] | None = None, node_types: list[str] | None = None, repositories: list[str] | None = None) -> DataFrame:
    """Chunks that pass the filters; an absent filter passes all."""
    for column, values in (("language", languages), ("node_type", node_types), ("repository_id", repositories)):
        if values is not None:
            chunks = chunks.where(F.col(column).isin(values))
    return chunks


def ranked(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("score"), "id").limit(limit)


def knn_scan(chunks: DataFrame, vectors: DataFrame, query: list[float], limit: int = 10, min_score: float | None = None) -> DataFrame:
    """Exact cosine top-k of the chunks that have a vector."""
    target = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(F.col("chunk_id").alias("id"), F.round(cosine(F.col("vector"), target), 6).alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return ranked(chunks.join(scored, "id"), limit)


def lsh_candidates(vectors: DataFrame, query: list[float], tables: int = 24, bits: int = 4, seed: int = 7) -> DataFrame:
    """Approximate leg: vectors that share a random-hyperplane bucket with the query in one of the tables at least."""
    import numpy as np

    planes = np.random.default_rng(seed).standard_normal((tables, bits, len(query)))
    signs = (planes @ np.asarray(query) > 0).astype(int)
    hits = []
    for t in range(tables):
        same = []
        for b in range(bits):
            plane = F.array(*(F.lit(float(x)) for x in planes[t, b]))
            value = F.aggregate(F.zip_with("vector", plane, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
            same.append((value > 0) == bool(signs[t, b]))
        hits.append(reduce(lambda x, y: x & y, same))
    return vectors.where(reduce(lambda x, y: x | y, hits))


def knn_two_stage(chunks: DataFrame, vectors: DataFrame, query: list[float], limit: int = 10, **lsh) -> DataFrame:
    """Top-k of the approximate candidates; the exact scan where filters leave fewer than ``limit`` of them."""
    found = knn_scan(chunks, lsh_candidates(vectors, query, **lsh), query, limit)
    return found if found.count() >= limit else knn_scan(chunks, vectors, query, limit)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25(chunks: DataFrame, query: str, limit: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 over content and symbol name, without stemming; only chunks with a query word.

    Term counts are taken within each row, so no token leaves its task. Texts
    are split once: lengths and counts are written, the corpus figures and the
    scores come from them, and only the first ``limit`` rows meet their chunks.
    """
    terms = sorted(set(filter(None, _query_words(query))))
    text = words(F.concat_ws(" ", "content", "symbol_name"))
    counted = chunks.withColumn("_words", text).withColumn("_dl", F.size("_words").cast("double"))
    for i, t in enumerate(terms):
        counted = counted.withColumn(f"_tf{i}", F.size(F.filter("_words", _is(t))).cast("double"))
    counted = written(counted.select("id", "_dl", *(f"_tf{i}" for i in range(len(terms)))), "terms")
    figures = counted.agg(F.count("*").alias("n"), F.avg("_dl").alias("avg"), *(F.sum((F.col(f"_tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        df = figures[f"df{i}"] or 0
        idf = math.log(1 + ((figures["n"] or 0) - df + 0.5) / (df + 0.5))
        tf = F.col(f"_tf{i}")
        score = score + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_dl") / F.lit(figures["avg"] or 1.0)))
    found = reduce(lambda x, y: x | y, (F.col(f"_tf{i}") > 0 for i in range(len(terms))), F.lit(False))
    best = counted.where(found).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return ranked(chunks.join(F.broadcast(best), "id").select(*chunks.columns, "score"), limit)


class TextIndex:
    """Postings of a corpus (term, id, tf, dl), sorted by term, and its figures: a query reads its own terms' rows.

    Built once for many queries. A very common term's postings are many rows in
    many files, never one group.
    """

    def __init__(self, chunks: DataFrame):
        text = chunks.select("id", words(F.concat_ws(" ", "content", "symbol_name")).alias("w"))
        each = text.select("id", F.size("w").cast("double").alias("dl"), F.explode("w").alias("term"))
        each = each.groupBy("term", "id", "dl").agg(F.count("*").cast("double").alias("tf"))  # combined where the chunk is
        self.postings = written(each.repartitionByRange("term").sortWithinPartitions("term"), "postings")
        # the postings hold every word once, so the corpus isn't split again for its figures
        self.n, total = chunks.count(), self.postings.agg(F.sum("tf")).first()[0]
        self.average = total / self.n if total else None

    def bm25(self, chunks: DataFrame, query: str, limit: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """The same rows as ``bm25`` over the indexed chunks."""
        terms = sorted(set(filter(None, _query_words(query))))
        own = written(self.postings.where(F.col("term").isin(terms)), "hits")
        df = {r.term: r["count"] for r in own.groupBy("term").count().collect()}
        idf = F.lit(0.0)
        for t, d in df.items():
            idf = F.when(F.col("term") == t, F.lit(math.log(1 + (self.n - d + 0.5) / (d + 0.5)))).otherwise(idf)
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(self.average or 1.0)))
        best = own.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
        return ranked(chunks.join(F.broadcast(best), "id").select(*chunks.columns, "score"), limit)


def _is(term: str):
    return lambda word: word == F.lit(term)


def _query_words(query: str) -> list[str]:
    import re

    return re.split(r"[\W_]+", query.lower())


def text_overlap(chunks: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    """For each term 1 if in the content and 2 if in the symbol name, over three times the terms; zeros go."""
    low, name = F.lower("content"), F.lower(F.coalesce("symbol_name", F.lit("")))
    points = F.lit(0)
    for t in terms:
        points = points + F.contains(low, F.lit(t.lower())).cast("int") + 2 * F.contains(name, F.lit(t.lower())).cast("int")
    scored = chunks.withColumn("score", F.round(F.coalesce(points, F.lit(0)) / F.lit(3.0 * max(1, len(terms))), 6))
    return ranked(scored.where("score > 0"), limit)


def rrf(legs: list[DataFrame], limit: int) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (60 + rank) by id, the best of each location, the first ``limit``.

    Legs are top-k results, so ranking them in one task is bounded by k.
    """
    places = ("repository_id", "file_path", "start_line", "end_line")
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")
    parts = [leg.withColumn("_part", 1.0 / (RRF_K + F.row_number().over(order))) for leg in legs]
    every = reduce(DataFrame.unionByName, parts)
    own = [c for c in legs[0].columns if c not in ("id", "score")]
    fused = every.groupBy("id").agg(F.round(F.sum("_part"), 6).alias("score"), *(F.first(c).alias(c) for c in own))
    first = F.row_number().over(W.partitionBy(*places).orderBy(F.desc("score"), "id"))
    return ranked(fused.withColumn("_n", first).where("_n = 1").drop("_n"), limit).select(legs[0].columns)


def test_penalty(results: DataFrame) -> DataFrame:
    """Half the score for test files; nothing goes."""
    return results.withColumn("score", F.when(is_test_file(F.col("file_path")), F.round(F.col("score") * TEST_PENALTY, 6)).otherwise(F.col("score")))


def hybrid(chunks: DataFrame, vectors: DataFrame, query: list[float] | None, text: str, limit: int = 10, min_score: float | None = None) -> DataFrame:
    """Cosine leg of ``limit`` and BM25 leg of 10 (or more, where there is no cosine leg), fused; the floor comes after."""
    legs = [knn_scan(chunks, vectors, query, limit)] if query is not None else []
    legs.append(bm25(chunks, text, TEXT_CANDIDATES if legs else max(limit, TEXT_CANDIDATES)))
    out = rrf(legs, limit)
    return out if min_score is None else out.where(F.col("score") >= min_score)


def hybrid_overlap(chunks: DataFrame, vectors: DataFrame, query: list[float], text: str, limit: int = 10, min_score: float | None = None) -> DataFrame:
    """The variant with overlap scores: both legs fetch twice the limit, 20 at least."""
    fetch = max(2 * limit, 20)
    out = rrf([knn_scan(chunks, vectors, query, fetch), text_overlap(chunks, text.split(), fetch)], limit)
    return out if min_score is None else out.where(F.col("score") >= min_score)


def fetch_limit(limit: int, reranked: bool) -> int:
    if not reranked:
        return limit
    base = 20 if limit <= 10 else limit
    return base + math.ceil(base / math.log(base))


def graph_expand(results: DataFrame, references: DataFrame, chunks: DataFrame) -> DataFrame:
    """Definitions of the neighbours of the best results' symbols.

    Up to five distinct symbol names seed; each gives up to 25 callers and
    callees over impact edges; neighbours rank by seeds, edges and name, and
    map to the tightest chunk of that name, one whose path holds the class
    first.
    """
    seeds = results.where("symbol_name is not null").groupBy("symbol_name").agg(F.max("score").alias("best"), F.min("id").alias("first"))
    seeds = seeds.orderBy(F.desc("best"), "first").limit(SEEDS).select(F.col("symbol_name").alias("seed"))
    edges = references.where(F.col("reference_kind").isin(*IMPACT_KINDS) & F.col("caller_symbol").isNotNull())
    few = F.broadcast(seeds)  # five rows
    up = edges.withColumn("seed", F.col("callee_symbol")).join(few, "seed").select("seed", F.lit("up").alias("side"), F.col("caller_symbol").alias("symbol"), "reference_file_path", "reference_line", "id")
    down = edges.withColumn("seed", F.col("caller_symbol")).join(few, "seed").select("seed", F.lit("down").alias("side"), F.col("callee_symbol").alias("symbol"), "reference_file_path", "reference_line", "id")
    order = W.partitionBy("seed", "side").orderBy("reference_file_path", "reference_line", "id")
    near = up.unionByName(down).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= NEIGHBOURS)
    near = near.join(F.broadcast(seeds.select(F.col("seed").alias("symbol"))), "symbol", "left_anti").groupBy("symbol").agg(F.countDistinct("seed").alias("seeds"), F.count("*").alias("edges"))
    names = near.withColumn("_q", split_qualified(F.col("symbol"))).select("symbol", "seeds", "edges", F.col("_q.name").alias("name"), F.col("_q.hint").alias("hint"))
    found = chunks.join(F.broadcast(names.withColumnRenamed("name", "symbol_name")), "symbol_name")
    hinted = F.coalesce(F.contains("file_path", F.col("hint")), F.lit(False))
    best = W.partitionBy("symbol").orderBy(F.desc(hinted), F.col("end_line") - F.col("start_line"), "id")
    found = found.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    out = found.orderBy(F.desc("seeds"), F.desc("edges"), "symbol").limit(GRAPH_LEG)
    return out.select(*chunks.columns, (F.col("seeds") + F.col("edges") / 1000.0).alias("score"))


def rerank(results: DataFrame, query: str, scorer: Callable[[str, Column], Column], limit: int) -> DataFrame:
    """The first ``limit`` by the scorer's score of ``symbol [node_type] content``; the scorer is a port."""
    text = F.concat(F.coalesce("symbol_name", F.lit("")), F.lit(" ["), "node_type", F.lit("] "), "content")
    return ranked(results.withColumn("score", scorer(query, text)), limit)


def hash_scorer(query: str, text: Column) -> Column:
    """A stand-in for a model: a number from 0 to 1 that depends on query and text alone."""
    digest = F.sha2(F.encode(F.concat(F.lit(query), text), "UTF-8"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10000 / 10000.0


def rerank_listed(results: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]], limit: int) -> DataFrame:
    """Rerank by a port that scores the already limited rows as one list; a wrong number or an error, which is logged, leaves the scores.

    The port is for a page of results: more than ``LISTED`` rows raise an error.
    """
    rows = results.orderBy(F.desc("score"), "id").limit(LISTED + 1).select("id", "symbol_name", "node_type", "content").collect()
    if len(rows) > LISTED:
        raise ValueError(f"more than {LISTED} results; limit them first")
    try:
        scores = scorer(query, [f"{r.symbol_name or ''} [{r.node_type}] {r.content}" for r in rows])
    except Exception:
        logging.getLogger(__name__).exception("the scorer failed; scores stay")
        scores = []
    if len(scores) != len(rows) or not rows:
        return ranked(results, limit)
    new = results.sparkSession.createDataFrame([(r.id, float(s)) for r, s in zip(rows, scores, strict=True)], "id string, _score double")
    return ranked(results.join(F.broadcast(new), "id").withColumn("score", F.col("_score")).drop("_score"), limit)


def pre_floor(results: DataFrame, hybrid_scores: bool) -> DataFrame:
    """Before reranking, cosine scores below the floor go; fused ones are no such scores and stay."""
    return results if hybrid_scores else results.where(F.col("score") >= FLOOR)


def search(
    chunks: DataFrame,
    vectors: DataFrame,
    references: DataFrame,
    query: list[float] | None,
    text: str,
    limit: int = 10,
    scorer: Callable[[str, Column], Column] | None = None,
    expander: Callable[[str], list[str]] | None = None,
) -> DataFrame:
    """The whole pipeline: variants, legs, fusion, graph leg, penalty, floors and reranking."""
    fetch = fetch_limit(limit, scorer is not None)
    variants = [text, *(expander(text)[:3] if expander else [])]
    legs = [hybrid(chunks, vectors, query, v, fetch) for v in variants]
    out = rrf(legs, fetch) if len(legs) > 1 else legs[0]
    out = rrf([out, graph_expand(out, references, chunks)], fetch)
    out = test_penalty(out)
    if scorer is not None:
        out = rerank(out, text, scorer, limit).where(F.col("score") >= FLOOR)
    return ranked(out, limit)


def chunk_at(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """The smallest chunk around each (repository_id, file_path, line)."""
    inside = points.join(chunks, ["repository_id", "file_path"]).where("line between start_line and end_line")
    best = W.partitionBy("repository_id", "file_path", "line").orderBy(F.col("end_line") - F.col("start_line"), "id")
    return inside.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def chunk_of_symbol(chunks: DataFrame, name: str, hint: str | None = None, repository: str | None = None) -> DataFrame:
    """The chunk of a name: one whose path holds the hint first, then the smallest."""
    own = chunks.where(F.col("symbol_name") == name)
    if repository is not None:
        own = own.where(F.col("repository_id") == repository)
    hinted = F.contains("file_path", F.lit(hint)) if hint else F.lit(False)
    return own.orderBy(F.desc(hinted), F.col("end_line") - F.col("start_line"), "id").limit(1)
