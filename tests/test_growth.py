"""Steps whose work would grow faster than their input, or be done several times over."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import callgraph as cg
from lodestone.operators import channels as ch
from lodestone.operators.embedding import hashed_embedding
from lodestone.operators.retrieval import TextIndex, words
from lodestone.plans import graph_queries
from lodestone.sources import scip

from test_graphs import edges


def _nodes(plan):
    name = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
    yield name, plan
    for child in [inner] if inner else [plan.children().apply(i) for i in range(plan.children().size())]:
        yield from _nodes(child)


def rows_of(df, kind, metric):
    """The most rows by a metric of any physical node of the kind, after a run."""
    df.collect()
    found = [n.metrics().get(metric) for name, n in _nodes(df._jdf.queryExecution().executedPlan()) if kind in name]
    return max((m.get().value() for m in found if m.isDefined()), default=0)


@pytest.fixture
def counted(spark):
    """A function that passes a column on and counts its rows."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(x):
        seen.add(1)
        return x

    return F.udf(pass_on, "string").asNondeterministic(), seen


def _endpoints(spark, rows):
    shape = "id string, repository_id string, file_path string, line int, enclosing_symbol string, protocol string, role string, channel_normalized string, is_pattern boolean, confidence double, resolved boolean"
    return spark.createDataFrame([(f"{i}", "r", f, n, "s", p, role, name, False, c, True) for i, (f, n, p, role, name, c) in enumerate(rows)], shape)


def test_sites_meet_once_in_synthesis(spark):
    own = _endpoints(spark, [("a.js", 10, "http", "producer", "/x", 0.9)] * 300)
    refs = [(f"r{i:03d}", "r", "a.js", 8 + 5 * (i % 2), "send", "axios") for i in range(300)]
    refs = spark.createDataFrame(refs, "id string, repository_id string, caller_file_path string, reference_line int, callee_symbol string, callee_package string")
    out = ch.synthesize(own, refs)
    assert rows_of(out, "Join", "numOutputRows") < 10
    assert [(r.line, r.role, r.id, r.protocol, r.library) for r in out.collect()] == [(13, "producer", "r001", "http", "axios")]


def test_links_are_made_without_grouping_pairs(spark):
    rows = [(f"{role[0]}{i}.js", i, "kafka", role, "t", 0.5 + i / 100) for role in ("producer", "consumer") for i in range(40)]
    out = ch.link(_endpoints(spark, rows))
    assert rows_of(out, "ShuffleExchange", "shuffleRecordsWritten") < 400 and out.count() == 1600
    both = [("p.js", 1, "kafka", "producer", "t", 0.9), ("p.js", 2, "amqp", "producer", "t", 0.7), ("p.js", 3, "amqp", "producer", "t", 0.8), ("c.js", 4, "kafka", "consumer", "t", 0.9), ("c.js", 5, "amqp", "consumer", "t", 0.6)]
    got = ch.link(_endpoints(spark, both)).collect()
    assert [(r.protocol, r.weight, r.confidence, r.p_best.line, r.c_best.line) for r in got] == [("amqp", 6, 0.9, 1, 4)]


@pytest.mark.parametrize("report", [cg.leaves, cg.chains])
def test_a_traversal_is_read_once(spark, counted, report):
    nodes = spark.createDataFrame([("b", 1, "a", "1"), ("c", 2, "b", "2"), ("d", 3, "c", "3")], "symbol string, depth int, via_symbol string, reference_id string")
    passed, seen = counted
    assert [r[0] for r in report(nodes.withColumn("via_symbol", passed("via_symbol"))).collect()] == ["d"] and seen.value == 3


def test_roots_are_resolved_once(spark, counted):
    passed, seen = counted
    refs = edges(spark, [("a", "b", "call"), ("b", "c", "call")]).withColumn("callee_symbol", passed("callee_symbol"))
    roots, found = cg.resolve_roots(refs, "c")
    once = seen.value
    assert found and [r.symbol for r in roots.collect()] == ["c"] and seen.value == once <= 4


def test_traversals_take_references_as_they_are(spark):
    plan = graph_queries.edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_symbols_are_named_once(spark):
    rows = [("d.ts", 0, "typescript", "s npm lib 1.0 src/`a.ts`/C#m().", 1 if i == 0 else 0, i, 3, None) for i in range(50)]
    out = scip.references(spark.createDataFrame(rows, "document string, ordinal int, language string, symbol string, roles int, line int, column int, kind string"), "r")
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {(r.callee_symbol, r.caller_symbol, r.reference_line) for r in out.collect()} == {("C#m", "C#m", i + 1) for i in range(1, 50)}


def test_embeddings_of_many_dimensions(spark):
    df = spark.range(5).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(600)), lambda x: F.concat(F.lit("w"), F.pmod(x * (F.col("id") + 1), F.lit(977))))).alias("t"))
    found = df.select("t", hashed_embedding(F.col("t"), 64).alias("v")).collect()
    plain = spark.createDataFrame([("a b",)], "t string").select(hashed_embedding(F.col("t"), 64).alias("v"))
    # words are not gone through again for each dimension
    assert "transform(sequence(" not in plain._jdf.queryExecution().analyzed().toString()
    hashes = df.limit(1).select(F.transform(words(F.col("t")), lambda w: F.xxhash64(w)).alias("h")).first().h
    want = [0.0] * 64
    for h in hashes:
        want[h % 64] += 1.0 if (h >> 32) % 2 == 0 else -1.0
    norm = sum(x * x for x in want) ** 0.5
    assert found[0].v == pytest.approx([x / norm for x in want], abs=1e-6)


def test_a_corpus_is_split_once_for_its_postings(spark, counted):
    passed, seen = counted
    chunks = spark.createDataFrame([(f"c{i}", "one two two" if i else "", None) for i in range(20)], "id string, content string, symbol_name string")
    index = TextIndex(chunks.withColumn("content", passed("content")))
    assert seen.value == 20 and index.n == 20 and index.average == 57 / 20
