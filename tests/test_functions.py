from pyspark.sql import functions as F

from lodestone.functions import channels, names, paths
from lodestone.sources import scip, walk


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, s string")
    return [r.v for r in df.select("i", make(F.col("s")).alias("v")).orderBy("i").collect()]


def test_split_qualified(spark):
    got = values(spark, ["A\\B#m().", "Ns\\Class", "crate::module::fn", "com.example.Foo", "bare()", "a/b", "#m"], names.split_qualified)
    assert [(g.name, g.hint) for g in got] == [("m", "B"), ("Class", None), ("fn", "module"), ("Foo", "example"), ("bare", None), ("b", "a"), ("m", None)]


def test_short_and_feature_names(spark):
    assert values(spark, ["a::b#c().", "x.", "()."], names.short_symbol) == ["c", "x", "()."]
    assert values(spark, ["scip x A/B#`m`", "p/Q#<constructor>", "Q#<get>size", "a::run()", "f"], names.feature_name) == ["B.`m`", "Q", "Q.size", "run", "f"]


def test_boundary_and_fuzzy(spark):
    assert values(spark, ["a#run", "a#rerun", "run().", "x::run()", "running"], lambda c: names.boundary_match(c, "run")) == [True, False, True, True, False]
    assert names.fuzzy_pattern("MyClass#do.it+") == r"My[/\\#.:]*Class[/\\#.:]*do[/\\#.:]*it\+"


def test_test_predicates_differ(spark):
    files = ["src/__tests__/a.js", "a.spec.ts", "test_a.py", "a_test.rs", "spec/a.yaml", "lib/a-test.ts", "contest.rs", "SRC/TESTS/a.go"]
    assert values(spark, files, paths.is_test_file) == [True, True, True, True, False, False, False, True]
    assert values(spark, files, paths.is_test_path) == [True, True, False, True, True, True, False, False]


def test_remotes(spark):
    got = values(spark, ["git@GitHub.com:a/B.git", "https://u:p@Host.com:8443/x/y/", "host/p", " ", "ssh://git@h:22/a.git"], paths.normalize_remote)
    assert got == ["github.com/a/B", "host.com/x/y", "host/p", None, "h/a"]


def test_routes_and_topics(spark):
    assert values(spark, ["/a//b/:id?x#y", "a/<int:id>/", "", "/{x}"], channels.normalize_route) == ["/a/b/{}", "/a/{}", "/", "/{}"]
    assert values(spark, ["a/b", "a", "a/b/c", "b"], lambda c: channels.topic_matches(F.lit("a/#"), c)) == [True, True, True, False]
    assert values(spark, ["a/b", "a", "a/b/c"], lambda c: channels.topic_matches(F.lit("a/+"), c)) == [True, False, False]
    assert values(spark, ["/a/{}", "/a/b", "/a", "/{}/x"], lambda c: channels.route_matches(c, F.lit("/a/x"))) == [True, False, False, True]


def test_symbols_of_an_index(spark):
    df = spark.createDataFrame([("scip-ts npm . . src/`a.ts`/C#m().", "typescript"), ("s c p 1 A/B#m().", "php"), ("local 3", "php"), ("odd", "php")], "s string, l string")
    assert [r[0] for r in df.select(scip.normalized_symbol(F.col("s"), F.col("l"))).collect()] == ["C#m", "A\\B#m", "", "odd"]


def test_ignore_rules(spark):
    rules = ["# no", "*.log", "/build/", "!keep.log", "docs/**/x.md"]
    assert values(spark, ["a.log", "keep.log", "build/a", "src/build/a", "docs/a/b/x.md", "docs/x.md"], lambda c: walk.is_ignored(c, rules)) == [True, False, True, False, True, True]


def test_community_ids(spark):
    import hashlib

    df = spark.createDataFrame([(["b", "a"],)], "m array<string>")
    assert df.select(names.stable_community_id("c", F.col("m"))).first()[0] == "c-" + hashlib.sha256(b"a\0b\0").hexdigest()[:12]
