"""Call-graph operators over ``references``: lookups, breadth-first traversal, paths and patterns.

A traversal is one join for each level of the whole frontier, never a query
for each symbol; levels are written, so lineage doesn't grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.names import boundary_match, fuzzy_pattern, split_qualified
from lodestone.functions.paths import tests_symbol
from lodestone.functions.weights import IMPACT_KINDS
from lodestone.storage import written

ANONYMOUS = "<anonymous>"
PLACE = ("reference_file_path", "reference_line", "id")


def where_graph(references: DataFrame, repository: str | None = None, language: str | None = None, kind: str | None = None) -> DataFrame:
    for column, value in (("repository_id", repository), ("language", language), ("reference_kind", kind)):
        if value is not None:
            references = references.where(F.col(column) == value)
    return references


def _ordered(df: DataFrame, limit: int | None) -> DataFrame:
    df = df.orderBy(*PLACE)
    return df if limit is None else df.limit(limit)


def callers(references: DataFrame, symbol: str, limit: int | None = None, **where) -> DataFrame:
    """References to the symbol, by its name or by an import's alias."""
    return _ordered(where_graph(references, **where).where((F.col("callee_symbol") == symbol) | (F.col("import_alias") == symbol)), limit)


def callees(references: DataFrame, symbol: str, limit: int | None = None, **where) -> DataFrame:
    return _ordered(where_graph(references, **where).where(F.col("caller_symbol") == symbol), limit)


def by_file(references: DataFrame, path: str) -> DataFrame:
    return references.where(F.col("reference_file_path") == path).orderBy("reference_line", "reference_column", "id")


def by_repositories(references: DataFrame, repositories: list[str]) -> DataFrame:
    return references.where(F.col("repository_id").isin(repositories)).orderBy(*PLACE)


def symbols(references: DataFrame) -> DataFrame:
    return references.select(F.col("callee_symbol").alias("symbol")).union(references.select("caller_symbol")).where("symbol is not null").distinct()


def resolve_symbols(references: DataFrame, name: str, regex: bool = False) -> DataFrame:
    """Distinct names that are ``name`` or end with it at a boundary, or that a regex finds."""
    found = F.col("symbol").rlike(name) if regex else boundary_match(F.col("symbol"), name)
    return symbols(references).where(found).orderBy("symbol")


def resolve_matches(references: DataFrame, name: str, regex: bool = False) -> DataFrame:
    """As above; where nothing is found, a fuzzy pattern is tried."""
    found = written(resolve_symbols(references, name, regex), "found")  # a scan of all references, asked for several times
    if regex or found.limit(1).count():
        return found
    return written(resolve_symbols(references, f".*{fuzzy_pattern(name)}.*", True), "found")


def resolve_roots(references: DataFrame, name: str, regex: bool = False) -> tuple[DataFrame, bool]:
    """(roots, resolved): the name itself where nothing matches."""
    found = resolve_matches(references, name, regex)
    if found.limit(1).count():
        return found, True
    return references.sparkSession.createDataFrame([(name,)], "symbol string"), False


def expansion(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(symbol, depth) of everything that can be reached over distinct (source, target) edges; roots have depth 0."""
    seen = frontier = written(roots.select("symbol").distinct().withColumn("depth", F.lit(0)), "level")
    level = 0
    while True:
        level += 1
        near = frontier.join(edges, frontier["symbol"] == edges["source"]).select(F.col("target").alias("symbol")).distinct()
        frontier = written(near.join(seen, "symbol", "left_anti").withColumn("depth", F.lit(level)), "level")
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier)


def traverse(references: DataFrame, roots: DataFrame, direction: str = "callers") -> DataFrame:
    """Multi-root breadth-first search: each symbol once, at its least depth, with the edge that reached it.

    Only impact edges are walked on; other edges report their symbol. A null
    caller is reported once for each repository and file.
    """
    here, there = ("callee_symbol", "caller_symbol") if direction == "callers" else ("caller_symbol", "callee_symbol")
    walked = references.where(F.col("reference_kind").isin(*IMPACT_KINDS)).where(f"{here} is not null and {there} is not null")
    pairs = written(walked.select(F.col(here).alias("source"), F.col(there).alias("target")).distinct(), "edges")
    reached = expansion(pairs, roots).select(F.col("symbol").alias("via_symbol"), F.col("depth").alias("_d"))
    out = references.join(reached, references[here] == reached["via_symbol"])
    out = out.withColumn("symbol", F.coalesce(there, F.lit(ANONYMOUS)))
    out = out.withColumn("_key", F.when(F.col(there).isNull(), F.concat_ws("\0", "repository_id", "caller_file_path")).otherwise(F.lit("")))
    first = F.struct("_d", "via_symbol", *PLACE)
    node = F.struct("via_symbol", "reference_kind", "repository_id", "caller_file_path", "reference_file_path", "reference_line", "id")
    out = out.groupBy("symbol", "_key").agg((F.min("_d") + 1).alias("depth"), F.min_by(node, first).alias("n"))
    out = out.join(roots.select("symbol").distinct(), "symbol", "left_anti")
    return out.select("symbol", "depth", "n.*").withColumnRenamed("id", "reference_id")


def depth_summary(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("total"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


def impact(references: DataFrame, name: str, repository: str | None = None, regex: bool = False) -> DataFrame:
    references = where_graph(references, repository)
    return traverse(references, resolve_roots(references, name, regex)[0], "callers")


def context(references: DataFrame, name: str, repository: str | None = None, regex: bool = False) -> DataFrame:
    references = where_graph(references, repository)
    roots = resolve_roots(references, name, regex)[0]
    up, down = (traverse(references, roots, d).withColumn("direction", F.lit(d)) for d in ("callers", "callees"))
    return up.unionByName(down)


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes through which no other was reached."""
    nodes = written(nodes, "nodes")  # a traversal's result, read twice
    return nodes.join(nodes.select(F.col("via_symbol").alias("symbol")).distinct(), "symbol", "left_anti")


def chains(nodes: DataFrame) -> DataFrame:
    """(leaf, path) with one leaf-first path to a root for each leaf; a level's finished paths stay where they were written."""
    nodes = written(nodes.select("symbol", "depth", "via_symbol", "reference_id"), "nodes")
    up = nodes.where(F.col("symbol") != ANONYMOUS).groupBy("symbol").agg(F.min_by("via_symbol", F.struct("depth", "via_symbol")).alias("up"))
    up = written(up, "up")
    out = nodes.join(nodes.select(F.col("via_symbol").alias("symbol")).distinct(), "symbol", "left_anti")
    out = out.select(F.col("symbol").alias("leaf"), "reference_id", F.array("symbol", "via_symbol").alias("path"), F.col("via_symbol").alias("symbol"))
    done = []
    while True:
        step = out.join(up, "symbol", "left")
        grown = F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("path", F.array("up")))
        step = written(step.select("leaf", "reference_id", grown.alias("path"), F.col("up").alias("symbol")), "chains")
        done.append(step.where("symbol is null").select("leaf", "reference_id", "path"))
        out = step.where("symbol is not null")
        if not out.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def all_routes(references: DataFrame, root: str, most: int | None = None) -> DataFrame:
    """Every distinct route of callers that ends at the root and repeats no symbol; of up to ``most`` callers, if given.

    A route repeats no symbol, so a level without routes comes; their number can grow exponentially until then.
    """
    pairs = references.where(F.col("reference_kind").isin(*IMPACT_KINDS)).where("caller_symbol is not null").select("caller_symbol", "callee_symbol").distinct()
    pairs = written(pairs, "edges")
    routes = pairs.where(F.col("callee_symbol") == root).select("caller_symbol", F.array("caller_symbol", "callee_symbol").alias("route")).where("caller_symbol <> callee_symbol")
    out = routes = written(routes, "routes")
    level = 1
    while (most is None or level < most) and routes.limit(1).count():
        step = routes.withColumnRenamed("caller_symbol", "at").join(pairs, F.col("at") == F.col("callee_symbol"))
        step = step.where(~F.array_contains("route", F.col("caller_symbol"))).select("caller_symbol", F.concat(F.array("caller_symbol"), "route").alias("route"))
        routes = written(step, "routes")
        out = out.unionByName(routes)
        level += 1
    return out.select("route")


def children(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("via_symbol").agg(F.sort_array(F.collect_set("symbol")).alias("children"))


def _neighbours(references: DataFrame, symbol: Column, limit: int | None) -> DataFrame:
    """The first reference of each neighbour, by place; null neighbours go."""
    order = W.partitionBy("symbol").orderBy(*PLACE)
    out = references.withColumn("symbol", symbol).where("symbol is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return _ordered(out, limit)


# Query patterns, the reference kinds they take, and the side of the neighbour.
PATTERNS = {
    "callers_of": (None, "caller_symbol"),
    "callees_of": (None, "callee_symbol"),
    "imports_of": (("import",), "callee_symbol"),
    "importers_of": (("import",), "caller_symbol"),
    "inheritors_of": (("inheritance", "implementation"), "caller_symbol"),
    "children_of": (("inheritance", "implementation"), "callee_symbol"),
}


def query_graph(references: DataFrame, pattern: str, target: str, limit: int | None = None) -> DataFrame:
    if pattern == "file_summary":
        return _neighbours(references.where(F.col("reference_file_path") == target), F.col("callee_symbol"), limit)
    if pattern == "tests_for":
        found = references.where((F.col("callee_symbol") == target) | (F.col("import_alias") == target))
        return _neighbours(found.where(tests_symbol(F.col("caller_symbol"), F.col("reference_file_path"))), F.col("caller_symbol"), limit)
    kinds, side = PATTERNS[pattern]
    if kinds:
        references = references.where(F.col("reference_kind").isin(*kinds))
    up = side == "caller_symbol"
    found = references.where((F.col("callee_symbol") == target) | (F.col("import_alias") == target)) if up else references.where(F.col("caller_symbol") == target)
    return _neighbours(found, F.col(side), limit)


def explain_prompts(references: DataFrame, chunks: DataFrame, name: str, regex: bool = False, shown: int = 50) -> DataFrame:
    """(symbol, prompt): the root's prompt for a chat port, with its neighbours and its snippet.

    Several roots are candidates to choose from: a row for each, without a
    prompt. A prompt is a page: it names ``shown`` neighbours on either side (the
    first by name) and how many there are. The snippet is the smallest chunk of
    the symbol's short name, one whose path holds its class first.
    """
    roots = written(resolve_roots(references, name, regex)[0].select("symbol").distinct(), "roots")
    few = roots.limit(2).count()
    if few != 1:
        return roots.select("symbol", F.lit(None).cast("string").alias("prompt"))

    def near(here: str, there: str) -> DataFrame:
        found = references.where(f"{there} is not null").join(F.broadcast(roots), F.col(here) == F.col("symbol")).select("symbol", F.col(there).alias("other")).distinct()
        page = found.orderBy("other").limit(shown).groupBy("symbol").agg(F.concat_ws(", ", F.sort_array(F.collect_list("other"))).alias(there))
        return page.join(found.groupBy("symbol").agg(F.count("*").alias(f"n_{there}")), "symbol")

    root = roots.first()["symbol"]
    parts = split_qualified(F.lit(root))
    hint = F.coalesce(F.contains("file_path", parts["hint"]), F.lit(False))
    snippet = chunks.where(F.col("symbol_name") == parts["name"]).orderBy(F.desc(hint), F.col("end_line") - F.col("start_line"), "id").limit(1)
    snippet = snippet.select(F.lit(root).alias("symbol"), "content")
    line = lambda label, c: F.concat(F.lit(f"{label} ("), F.col(f"n_{c}"), F.lit("): "), F.col(c))
    text = F.concat_ws("\n", F.concat(F.lit("Symbol: "), "symbol"), line("Called by", "caller_symbol"), line("Calls", "callee_symbol"), F.concat(F.lit("Source:\n"), "content"))
    out = roots.join(near("callee_symbol", "caller_symbol"), "symbol", "left").join(near("caller_symbol", "callee_symbol"), "symbol", "left").join(snippet, "symbol", "left")
    return out.select("symbol", text.alias("prompt"))
