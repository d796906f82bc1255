"""Scalar functions over the symbols, paths and channels of the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import channels, names, paths, weights
from lodestone.plans.registry import query
from lodestone.plans.views import sql, view


def _over(source: str, name: str, inputs: dict[str, str], outputs, twin: str):
    """A query over the distinct inputs of a view: the inputs and what a function makes of them."""
    listed = ", ".join(f"{e} AS {c}" for c, e in inputs.items())

    @query(name, sql(f"+ i AS (SELECT DISTINCT {listed} FROM {source}) SELECT {', '.join(inputs)}, {twin} FROM i", source))
    def run(spark, sf_dir):
        own = view(spark, sf_dir, source).selectExpr(*(f"{e} AS {c}" for c, e in inputs.items())).distinct()
        return own.select(*inputs, *outputs())

    return run


C = F.col
# names in five notations, with and without call marks
SYMBOL = {"s": "concat(CASE length(callee_symbol) % 5 WHEN 0 THEN replace(callee_symbol, '.', '::') WHEN 1 THEN replace(callee_symbol, '#', '.') WHEN 2 THEN replace(callee_symbol, '.', '/') WHEN 3 THEN replace(replace(callee_symbol, '#', '/'), '.', chr(92)) ELSE callee_symbol END, CASE reference_column % 3 WHEN 0 THEN '' WHEN 1 THEN '()' ELSE '().' END)"}
BARE = r"regexp_replace(s, '\(\)\.?$', '')"
_SEPS = ("#", chr(92), "::", ".", "/")


def _chain(of: str, default: str) -> str:
    """CASE over the separators in order; ``of`` takes the separator."""
    return "CASE " + " ".join(f"WHEN contains({BARE}, '{x}') THEN {of.replace('@', x)}" for x in _SEPS) + f" ELSE {default} END"


_BEFORE = f"left({BARE}, length({BARE}) - length(list_last(string_split({BARE}, '@'))) - length('@'))"
_HINT = "nullif(CASE " + " ".join(f"WHEN contains({_BEFORE}, '{y}') THEN list_last(string_split({_BEFORE}, '{y}'))" for y in (chr(92), "::", ".", "/")) + f" ELSE {_BEFORE} END, '')"
_over("refs", "fn_parse_fqn", SYMBOL, lambda: [names.split_qualified(C("s"))["name"].alias("name"), names.split_qualified(C("s"))["hint"].alias("hint")],
      f"{_chain(f'list_last(string_split({BARE}, {chr(39)}@{chr(39)}))', BARE)} AS name, CASE WHEN NOT contains({BARE}, '#') AND contains({BARE}, '{chr(92)}') THEN NULL ELSE {_chain(_HINT, 'NULL')} END AS hint")
_over("refs", "fn_short_fqn", SYMBOL, lambda: [names.split_qualified(C("s"))["name"].alias("name")], f"{_chain(f'list_last(string_split({BARE}, {chr(39)}@{chr(39)}))', BARE)} AS name")
_over("refs", "fn_class_hint", SYMBOL, lambda: [names.split_qualified(C("s"))["hint"].alias("hint")],
      f"CASE WHEN NOT contains({BARE}, '#') AND contains({BARE}, '{chr(92)}') THEN NULL ELSE {_chain(_HINT, 'NULL')} END AS hint")
_over("refs", "fn_short_symbol", SYMBOL, lambda: [names.short_symbol(C("s")).alias("short")], r"list_last(list_filter(regexp_split_to_array(regexp_replace(s, '[.()]+$', ''), '[:/#.\\]'), lambda x: x <> '')) AS short")
_over("refs", "fn_feature_name", {"s": "callee_symbol"}, lambda: [names.feature_name(C("s")).alias("label")], "concat(list_last(string_split(split_part(s, '#', 1), '.')), '.', split_part(s, '#', 2)) AS label")
_over("refs", "fn_class_path", {"s": "callee_symbol"}, lambda: [names.class_path(C("s"))["base"].alias("base"), F.size(names.class_path(C("s"))["segments"]).alias("n")], "split_part(s, '#', 1) AS base, CAST(0 AS INT) AS n")
_over("chunks", "fn_qualified", {"p": "parent_symbol", "n": "symbol_name", "l": "language"}, lambda: [names.qualified(C("p"), C("n")).alias("q"), names.graph_name(C("p"), C("n"), C("l")).alias("g")],
      "CASE WHEN p IS NULL THEN n ELSE p || '::' || n END AS q, CASE WHEN p IS NULL THEN n ELSE p || '::' || n END AS g")
_over("refs", "fn_boundary", {"s": "callee_symbol"}, lambda: [names.boundary_match(C("s"), "m20").alias("hit")], "(s = 'm20' OR ends_with(s, '#m20') OR ends_with(s, '.m20')) AS hit")
_over("refs", "fn_fuzzy", {"s": "callee_symbol"}, lambda: [C("s").rlike(names.fuzzy_pattern("pkg1.C1")).alias("hit")], r"regexp_matches(s, 'pkg1[/\\#.:]*C1') AS hit")
_over("refs", "fn_escape_like", {"s": "callee_symbol"}, lambda: [F.contains(C("s"), F.lit("m1")).alias("hit")], r"(s LIKE '%' || 'm1' || '%' ESCAPE '\') AS hit")
_over("chunks", "fn_test_file", {"p": "file_path"}, lambda: [paths.is_test_file(C("p")).alias("test")], "(contains(lower(p), '/tests/')) AS test")
_over("endpoints", "fn_test_path", {"p": "file_path"}, lambda: [paths.is_test_path(C("p")).alias("test")], "starts_with(p, 'tests/') AS test")
_over("refs", "fn_tests_for", {"s": "concat(CASE WHEN reference_line % 7 = 0 THEN 'test_' ELSE '' END, callee_symbol)", "p": "reference_file_path"}, lambda: [paths.tests_symbol(C("s"), C("p")).alias("test")], "starts_with(s, 'test_') AS test")
_over("endpoints", "fn_http_norm", {"r": "channel_raw"}, lambda: [channels.normalize_route(C("r")).alias("route")],
      "'/' || array_to_string(list_transform(list_filter(string_split(split_part(r, '?', 1), '/'), lambda x: x <> ''), lambda x: CASE WHEN starts_with(x, ':') THEN '{}' ELSE x END), '/') AS route")
_over("endpoints", "fn_http_split", {"r": "concat('https://h', line % 5, '.example', channel_raw)"}, lambda: [channels.split_url(C("r"))["host"].alias("host"), channels.split_url(C("r"))["path"].alias("path")],
      "regexp_extract(r, '^https?://([^/]*)', 1) AS host, CASE WHEN regexp_extract(r, '^https?://[^/]*(/.*)?$', 1) = '' THEN '/' ELSE regexp_extract(r, '^https?://[^/]*(/.*)?$', 1) END AS path")
_NORM = """CASE WHEN protocol = 'http' THEN '/' || array_to_string(list_transform(list_filter(string_split(split_part(channel_raw, '?', 1), '/'), lambda x: x <> ''), lambda x: CASE WHEN starts_with(x, ':') THEN '{}' ELSE x END), '/') ELSE trim(channel_raw) END"""
_PATTERN = "(protocol = 'mqtt' AND (contains(channel_raw, '+') OR contains(channel_raw, '#')))"
_over("endpoints", "fn_channel_norm", {"protocol": "protocol", "channel_raw": "channel_raw"},
      lambda: [channels.normalize_channel(C("protocol"), C("channel_raw"))["name"].alias("name"), channels.normalize_channel(C("protocol"), C("channel_raw"))["is_pattern"].alias("is_pattern")],
      f"{_NORM} AS name, {_PATTERN} AS is_pattern")
_over("endpoints", "fn_http_match", {"r": "channel_raw"}, lambda: [channels.route_matches(channels.normalize_route(C("r")), F.lit("/api/{}/3")).alias("hit")],
      "(regexp_matches(r, '^/api//[^/?]+/(3|:id)([?].*)?$')) AS hit")
_over("endpoints", "fn_mqtt_match", {"r": "trim(channel_raw)"}, lambda: [channels.topic_matches(F.lit("dev/+/t1"), C("r")).alias("hit"), channels.topic_matches(F.lit("dev/#"), C("r")).alias("any")],
      "regexp_matches(r, '^dev/[^/]*/t1$') AS hit, regexp_matches(r, '^dev(/.*)?$') AS any")
_over("endpoints", "fn_glob", {"r": "trim(channel_raw)"}, lambda: [channels.glob_matches(F.lit("topic.?"), C("r")).alias("one"), channels.glob_matches(F.lit("*1*"), C("r")).alias("some")], "(r GLOB 'topic.?') AS one, (r GLOB '*1*') AS some")
_over("refs", "fn_kind_weight", {"k": "reference_kind"}, lambda: [weights.kind_weight(C("k")).alias("weight")],
      "CAST(CASE k WHEN 'call' THEN 1.0 WHEN 'method_call' THEN 1.0 WHEN 'inheritance' THEN 0.8 WHEN 'implementation' THEN 0.7 WHEN 'type_reference' THEN 0.6 WHEN 'import' THEN 0.5 ELSE 0.3 END AS DOUBLE) AS weight")
_over("repositories", "fn_remote", {"u": "concat('git@GitHub.example:Org/', name, '.git')", "v": "concat('ssh://u@Host.example:22/a/', name, '.git/')"}, lambda: [paths.normalize_remote(C("u")).alias("a"), paths.normalize_remote(C("v")).alias("b")],
      "concat('github.example/Org/', replace(replace(u, 'git@GitHub.example:Org/', ''), '.git', '')) AS a, concat('host.example/a/', replace(replace(v, 'ssh://u@Host.example:22/a/', ''), '.git/', '')) AS b")
_over("chunks", "fn_file_hash", {"id": "id", "c": "content"}, lambda: [paths.file_hash(C("c")).alias("hash")], "sha256(c) AS hash")
_over("chunks", "fn_language", {"p": "concat(file_path, CASE end_line % 3 WHEN 0 THEN '.RS' WHEN 1 THEN '.tsx' ELSE '' END)"}, lambda: [paths.language_of(C("p")).alias("language")],
      "CASE WHEN ends_with(p, '.RS') THEN 'rust' WHEN ends_with(p, '.tsx') THEN 'typescript' ELSE 'unknown' END AS language")


@query("fn_edge_weight", sql("""
SELECT caller_file_path, reference_file_path, round(count(*) * list_avg(list_transform(list_distinct(list(reference_kind)), lambda k: CASE k WHEN 'call' THEN 1.0 WHEN 'method_call' THEN 1.0
WHEN 'inheritance' THEN 0.8 WHEN 'implementation' THEN 0.7 WHEN 'type_reference' THEN 0.6 WHEN 'import' THEN 0.5 ELSE 0.3 END)), 6) AS weight FROM refs GROUP BY ALL""", "refs"))
def fn_edge_weight(spark, sf_dir):
    out = view(spark, sf_dir, "refs").groupBy("caller_file_path", "reference_file_path").agg(F.count("*").alias("n"), F.collect_set("reference_kind").alias("k"))
    return out.select("caller_file_path", "reference_file_path", F.round(weights.edge_weight(C("n"), C("k")), 6).alias("weight"))


@query("fn_cosine", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings")
def fn_cosine(spark, sf_dir):
    vectors = view(spark, sf_dir, "vectors")
    target = F.array(*map(F.lit, map(float, vectors.where("vec_id = 7").first()["vector"])))
    return vectors.select("vec_id", F.round(weights.cosine(C("vector"), target), 6).alias("score"))


@query("fn_dirs", sql("""+ d AS (SELECT repository_id, string_split(file_path, '/') AS p FROM chunks), e AS (SELECT repository_id, array_to_string(p[1:k], '/') AS directory FROM (SELECT repository_id, p, unnest(range(1, len(p))) AS k FROM d)),
c AS (SELECT repository_id, directory, count(*) AS n FROM e GROUP BY ALL)
SELECT repository_id, directory, n, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY n DESC, length(directory) - length(replace(directory, '/', '')) DESC, directory) AS INT) AS rank FROM c QUALIFY rank <= 3""", "chunks"))
def fn_dirs(spark, sf_dir):
    from lodestone.operators.filegraph import directory_counts

    return directory_counts(view(spark, sf_dir, "chunks"), "repository_id", "file_path")
