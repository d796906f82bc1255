"""Small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import callgraph as cg
from lodestone.operators import channels as ch
from lodestone.operators import communities as cm
from lodestone.operators import filegraph as fg
from lodestone.operators import flows as fl

SCHEMA = "id string, caller_symbol string, callee_symbol string, caller_file_path string, reference_file_path string, reference_line int, reference_column int, reference_kind string, language string, repository_id string, import_alias string"


def edges(spark, pairs):
    rows = [(str(i), a, b, f"{a}.py", f"{b}.py", i, 0, kind, "python", "r", None) for i, (a, b, kind) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA)


def depths(nodes):
    return {r.symbol: r.depth for r in nodes.collect()}


def test_chain(spark):
    refs = edges(spark, [("entry", "middle", "call"), ("middle", "root", "call"), ("root", "child", "call")])
    nodes = cg.impact(refs, "root")
    assert depths(nodes) == {"middle": 1, "entry": 2}
    assert [r.path for r in cg.chains(nodes).collect()] == [["entry", "middle", "root"]]
    assert [r.symbol for r in cg.leaves(nodes).collect()] == ["entry"]


@pytest.mark.parametrize("kinds, wanted", [(["import"], {"b": 1}), (["implementation"], {"b": 1, "c": 2}), (["import", "call"], {"b": 1, "c": 2})])
def test_structural_edges_are_reported_not_walked(spark, kinds, wanted):
    refs = edges(spark, [*(("b", "a", k) for k in kinds), ("c", "b", "call")])
    assert depths(cg.impact(refs, "a")) == wanted


def test_cycle_and_diamond(spark):
    refs = edges(spark, [("a", "b", "call"), ("b", "a", "call"), ("c", "a", "call"), ("c", "b", "call")])
    assert depths(cg.impact(refs, "a")) == {"b": 1, "c": 1}


def test_anonymous_callers(spark):
    refs = edges(spark, [(None, "a", "call"), ("b", "a", "call")])
    assert depths(cg.impact(refs, "a")) == {cg.ANONYMOUS: 1, "b": 1}


def test_unknown_and_leaf(spark):
    refs = edges(spark, [("a", "b", "call")])
    assert cg.resolve_roots(refs, "zzz")[1] is False and cg.impact(refs, "zzz").count() == 0
    assert cg.resolve_roots(refs, "a")[1] is True and cg.impact(refs, "a").count() == 0


def test_entry_points_and_features(spark):
    refs = edges(spark, [("main", "x", "call"), ("main", "y", "call"), ("x", "z", "call"), ("y", "z", "call"), (None, "main", "call")])
    assert [r[0] for r in fl.entry_points(refs).collect()] == ["main"]
    got = fl.features(refs).first()
    assert (got.reach, got.depth, got.file_count) == (4, 2, 4) and 0 < got.criticality <= 1


@pytest.mark.parametrize("dense", [60, 400])
def test_flows_and_their_totals_are_those_of_plain_walks(spark, dense):
    import random

    dice = random.Random(dense)
    pairs = {(f"e{i}", f"n{dice.randrange(90)}") for i in range(150) for _ in range(2)} | {(f"n{dice.randrange(90)}", f"n{dice.randrange(90)}") for _ in range(dense)} | {("n1", "n1"), ("e7", "n1")}
    refs = edges(spark, [(*p, "call") for p in sorted(pairs)]).withColumn("reference_file_path", F.concat(F.lit("f"), F.length("callee_symbol"), F.substring("callee_symbol", 2, 1)))
    entries = spark.createDataFrame([(f"e{i}",) for i in range(150)] + [("n1",), ("n2",), ("lonely",)], "entry_point string")
    want = {}
    for start in [r[0] for r in entries.collect()]:
        seen, level = {start: 0}, [start]
        while level:
            level = sorted({b for a, b in pairs if a in level} - set(seen))
            seen |= dict.fromkeys(level, max(seen.values()) + 1)
        want[start] = seen
    got = {}
    for r in fl.feature_nodes(refs, entries).collect():
        assert got.setdefault(r.entry_point, {}).setdefault(r.symbol, r.depth) == r.depth
    assert got == want
    files = {r.symbol: r.file_path for r in fl.symbol_places(refs).collect()}
    totals = {r.entry_point: (r.reach, r.depth, r.file_count) for r in fl.feature_totals(refs, entries).collect()}
    assert totals == {s: (len(seen), max(seen.values()), len({files[n] for n in seen if n in files})) for s, seen in want.items()}


def test_one_task_walks_many_starts(spark):
    """A thousand entry points over a chain of three hundred symbols: a join for each level would be three hundred rounds."""
    import time

    refs = edges(spark, [(f"e{i}", f"s{i % 10}", "call") for i in range(1000)] + [(f"s{i}", f"s{i + 1}", "call") for i in range(300)])
    began = time.time()
    got = {r.entry_point: (r.reach, r.depth) for r in fl.feature_totals(refs, fl.entry_points(refs)).collect()}
    assert got == {f"e{i}": (302 - i % 10, 301 - i % 10) for i in range(1000)} and time.time() - began < 60


def test_bits_are_counted():
    import numpy as np

    from lodestone.operators.reach import bit_counts

    bits = np.random.default_rng(1).integers(0, 2**63, (1001, 3), np.uint64)
    want = [sum(int(x) >> i & 1 for x in bits[:, w]) for w in range(3) for i in range(64)]
    assert bit_counts(bits).tolist() == want and bit_counts(bits[:0]).sum() == 0


def test_cliques_are_found(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 1.0) for i in range(6) for j in range(i)]
    found = cm.partition(cm.adjacency([*clique("a"), *clique("b"), ("a0", "b0", 0.5)]))
    assert {n: c[0] for n, c in found.items()} == {n: n[0] for n in found}


def test_hub_couples_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 1.0) for i in range(4) for j in range(i)]
    rows = [("r", *e) for e in [*clique("order"), *clique("billing"), *(("hub", f"{p}{i}", 1.0) for p in ("order", "billing") for i in range(4))]]
    got = cm.couplings(spark.createDataFrame(rows, "g string, a string, b string, weight double"), "g").orderBy(F.desc("strength")).first()
    assert got.node == "hub" and got.split_probability >= 0.5 and got.strength > 0


def test_messaging_services(spark):
    rows = [
        ("1", "scales", "weigh.rs", 31, "mqtt", "producer", "hall/3/weight", "report", 0.7),
        ("2", "scales", "weigh.rs", 44, "mqtt", "producer", "hall/3/fault", "alarm", 0.7),
        ("3", "labels", "print.go", 8, "http", "consumer", "/print/{parcel}/label", "print_label", 0.8),
        ("4", "sorter", "belt.kt", 15, "mqtt", "consumer", "hall/+/weight", "on_weight", 0.9),
        ("5", "sorter", "belt.kt", 22, "http", "producer", "https://labels.local/print/77/label?size=a6", "on_weight", 0.9),
    ]
    own = spark.createDataFrame(rows, "id string, repository_id string, file_path string, line int, protocol string, role string, channel_raw string, enclosing_symbol string, confidence double").withColumn("resolved", F.lit(True))
    own = ch.normalized(own)
    got = {(r.protocol, r.channel, r.p_best.symbol, r.c_best.symbol) for r in ch.link(own).collect()}
    assert got == {("mqtt", "hall/+/weight", "report", "on_weight"), ("http", "/print/{}/label", "on_weight", "print_label")}
    assert [r.id for r in ch.unmatched(own).collect()] == ["2"]


def test_all_routes_of_any_length(spark):
    pairs = [(f"s{i + 1}", f"s{i}") for i in range(12)] + [("s3", "s1"), ("s0", "s2"), ("s5", "s5"), ("x", "s10")]
    want, todo = [], [("s0",)]
    while todo:
        todo = [(a, *route) for route in todo for a, b in pairs if b == route[0] and a not in route]
        want += todo
    refs = edges(spark, [(*p, "call") for p in pairs])
    assert sorted(tuple(r.route) for r in cg.all_routes(refs, "s0").collect()) == sorted(want)
    assert max(map(len, want)) == 13
    assert sorted(tuple(r.route) for r in cg.all_routes(refs, "s0", 2).collect()) == sorted(w for w in want if len(w) <= 3)


def test_feature_of_a_name_and_its_path(spark):
    refs = edges(spark, [("pkg.Main#run", "x", "call"), ("pkg.Main#run", "y", "call"), ("x", "z", "method_call"), ("y", "z", "call"), ("z", "x", "call")])
    assert [r.entry_point for r in fl.get_feature(refs, "run").collect()] == ["pkg.Main#run"]
    assert fl.get_feature(refs, "x").count() == 0 and fl.get_feature(refs, "nowhere").count() == 0
    got = {r.symbol: (r.depth, r.file_path, r.line, r.caller, r.callee_count, r.repository) for r in fl.feature_path(refs, "pkg.Main#run").collect()}
    assert got == {"pkg.Main#run": (0, "pkg.Main#run.py", None, None, 2, None), "x": (1, "x.py", 0, "pkg.Main#run", 1, None), "y": (1, "y.py", 1, "pkg.Main#run", 1, None), "z": (2, "z.py", 2, "x", 1, None)}


def test_a_path_names_the_repository_where_it_crosses(spark):
    refs = edges(spark, [("main", "x", "call"), ("x", "y", "call")]).withColumn("repository_id", F.when(F.col("caller_symbol") == "x", "other").otherwise("r"))
    assert {r.symbol: r.repository for r in fl.feature_path(refs, "main").collect()} == {"main": None, "x": None, "y": "other"}


def test_impacted_features_go_backwards(spark):
    refs = edges(spark, [("a", "x", "call"), ("b", "y", "call"), ("x", "z", "call"), ("z", "x", "call"), ("c", "z", "import")])
    changed = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    assert {r[0] for r in fl.features_impacted(refs, changed("z")).collect()} == {"a"}
    assert {r[0] for r in fl.features_impacted(refs, changed("z", "b")).collect()} == {"a", "b"}
    assert fl.features_impacted(refs, changed("nowhere")).count() == 0


def test_explain_has_a_snippet_or_candidates(spark):
    refs = edges(spark, [(f"c{i:03d}", "A#go", "call") for i in range(60)] + [("A#go", "leaf", "call"), ("q", "B#go", "call")])
    chunks = spark.createDataFrame([("1", "b.py", "fn go() {}", 1, 9, "go"), ("2", "A.py", "def go(): pass", 1, 20, "go")], "id string, file_path string, content string, start_line int, end_line int, symbol_name string")
    found = cg.explain_prompts(refs, chunks, "go").collect()
    assert {(r.symbol, r.prompt) for r in found} == {("A#go", None), ("B#go", None)}
    prompt = cg.explain_prompts(refs, chunks, "A#go").first().prompt
    assert prompt.startswith("Symbol: A#go\nCalled by (60): c000, ") and "c049" in prompt and "c050" not in prompt
    assert "\nCalls (1): leaf\n" in prompt and prompt.endswith("Source:\ndef go(): pass")


def test_a_section_that_fails_leaves_a_note(spark):
    from lodestone.operators.stats import overview_report

    good, bad = spark.range(3), spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    got = {r.section: (r.n, r.note) for r in overview_report({"good": good, "bad": bad.where("x is null")}).collect()}
    assert got["good"] == (3, None) and got["bad"][0] == 0 and got["bad"][1].startswith("skipped: ")


def test_large_groups_are_cut_by_components(spark):
    import random

    dice = random.Random(3)
    rows = []
    for part in range(5):
        rows += [("g", f"{part}.{i}", f"{part}.{dice.randrange(i)}", float(dice.randint(1, 3))) for i in range(1, 40)]
        rows += [("g", f"{part}.{dice.randrange(40)}", f"{part}.{dice.randrange(40)}", 1.0) for _ in range(30)]
    rows += [("g", f"line{i:03d}", f"line{i + 1:03d}", 1.0) for i in range(60)] + [("h", "0.0", "0.1", 1.0), ("h", "self", "self", 2.0)]
    df = spark.createDataFrame(rows, "g string, a string, b string, weight double")
    got = {(r.g, r.member): r.component for r in cm.components(df, "g").collect()}
    want = {**{("g", f"{p}.{i}"): f"{p}.0" for p in range(5) for i in range(40)}, **{("g", f"line{i:03d}"): "line000" for i in range(61)}, ("h", "0.0"): "0.0", ("h", "0.1"): "0.0", ("h", "self"): "self"}
    assert got == want
    rows_of = lambda n: sorted(map(tuple, cm.detect(df, "g", task_edges=n).collect()))
    assert rows_of(10) == rows_of(10**6)
    assert cm.detect(df.where("false"), "g").count() == 0


def test_a_large_graph_is_partitioned_in_little_memory():
    import tracemalloc

    import numpy as np

    dice = np.random.default_rng(5)
    n, edges_ = 5_000, 300_000
    a, b = dice.integers(0, n, edges_, np.int32), dice.integers(0, n, edges_, np.int32)
    b[: edges_ // 2] = (a[: edges_ // 2] // 50 * 50 + b[: edges_ // 2] % 50).astype(np.int32)  # planted communities of fifty nodes
    tracemalloc.start()
    graph = cm.compact(a, b, np.ones(edges_), n)
    found = cm.parts(graph)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * edges_ and len(found) == n and (found <= np.arange(n)).all() and len(set(found)) < n // 10
    assert graph.weight.sum() + 2 * graph.loop.sum() == 2 * edges_ and cm.partition({}) == {}


def test_numbers_follow_the_order_of_names(spark):
    from lodestone.operators import numbering

    rows = [(f"n{i * 7919 % 1000}",) for i in range(3000)]
    names = numbering.numbered(spark.createDataFrame(rows, "name string").repartition(7))
    assert [(r.name, r.number) for r in names.orderBy("number").collect()] == [(n, i) for i, n in enumerate(sorted({r[0] for r in rows}))]


def test_a_minimum_cut_is_found():
    ring = lambda p: [(f"{p}{i}", f"{p}{j}", 1.0) for i in range(5) for j in range(i)]
    graph = cm.adjacency([*ring("a"), *ring("b"), ("a0", "b0", 0.5), ("a1", "b0", 0.25)])
    assert sorted(cm._cut(graph, "a4", "b4")) == [("a0", "b0", 0.5), ("a1", "b0", 0.25)]
    fine = {n: n[0] for n in graph}
    scores = cm._candidates(graph, fine)
    assert scores["b0"][0] == 1.0 and max(scores, key=lambda n: sum(scores[n])) == "b0" and scores["a3"] == (0.0, 0.0)


def test_couplings_are_the_same_on_a_rerun_and_skip_whole_communities(spark):
    clique = lambda p, n=6: [("r", f"{p}{i}", f"{p}{j}", 1.0) for i in range(n) for j in range(i)]
    df = spark.createDataFrame([*clique("x"), *clique("y"), *(("r", "glue", f"{p}{i}", 1.0) for p in "xy" for i in range(6)), *clique("solo")], "g string, a string, b string, weight double")
    one, two = (sorted(map(tuple, cm.couplings(df, "g").collect())) for _ in range(2))
    assert one == two and not [r for r in one if r[2].startswith("solo")]
    best = max(one, key=lambda r: r[5])
    assert best[2] == "glue" and best[5] >= 0.5 and best[8] is not None


def test_routes_and_topics_meet_as_by_brute_force(spark):
    import itertools
    import random

    dice = random.Random(11)
    route = lambda: "/" + "/".join(dice.choice(["a", "b", "{}"]) for _ in range(dice.randint(0, 4)))
    topic = lambda wild: "/".join(dice.choice(["a", "b", "+"] if wild else ["a", "b"]) for _ in range(dice.randint(1, 3)))
    rows = [(f"{i}", "f", "r", i, "s", "http", dice.choice(["producer", "consumer"]), route(), False, 0.9, True) for i in range(120)]
    for i in range(60):
        role = dice.choice(["producer", "consumer"])
        name = topic(role == "consumer")
        rows.append((f"m{i}", "f", "r", i, "s", "mqtt", role, name, "+" in name, 0.9, True))
    cols = "id string, file_path string, repository_id string, line int, enclosing_symbol string, protocol string, role string, channel_normalized string, is_pattern boolean, confidence double, resolved boolean"
    names = {(r[5], r[6], r[7]) for r in rows}
    same = lambda x, y: x == y or "{}" in (x, y) or y == "+"

    def meets(p, c):
        a, b = ([x for x in n.split("/") if x] for n in (p, c))
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))

    want = {(x[0], x[2], y[2]) for x, y in itertools.product(names, names) if x[0] == y[0] and x[1] == "producer" and y[1] == "consumer" and meets(x[2], y[2])}
    got = [tuple(r) for r in ch.distinct_channels(spark.createDataFrame(rows, cols)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_naming_prompts_hold_members_and_directories(spark):
    rows = [(g, m, f"{p}/x.py") for g in ("g", "h") for p in ("a/b", "c") for m in (f"{p}/x.py", f"{p}/y.py")]
    members = spark.createDataFrame(rows, "g string, member string, community string")
    dirs = fg.directory_counts(members, ["g", "community"], "member")
    got = [r.prompt for r in cm.naming_prompts(cm.clusters(members, "g", "cluster"), dirs, "g").collect()]
    assert len(got) == 4 and all(("Directories: a" in p and "a/b/x.py, a/b/y.py" in p) or ("Directories: c." in p and "c/x.py, c/y.py" in p) for p in got)
