"""File dependencies from references, and their undirected collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.names import class_path
from lodestone.functions.weights import edge_weight, kind_weight


def symbol_index(chunks: DataFrame) -> DataFrame:
    """(symbol, file_path, repository_id, ambiguous): the first definition, by repository, path and line."""
    order = F.struct("repository_id", "file_path", "start_line", "id")
    site = F.min_by(F.struct("file_path", "repository_id"), order)
    out = chunks.where("symbol_name is not null").groupBy(F.col("symbol_name").alias("symbol"))
    out = out.agg(site.alias("site"), (F.count_distinct("file_path", "repository_id") > 1).alias("ambiguous"))
    return out.select("symbol", F.col("site.file_path").alias("file_path"), F.col("site.repository_id").alias("repository_id"), "ambiguous")


def resolve_callee(references: DataFrame, index: DataFrame) -> DataFrame:
    """References with target_file and target_repository: an exact symbol, ambiguous or not, else the class's base
    name where it has one place and the path holds the part before it."""
    exact = index.select(F.col("symbol").alias("callee_symbol"), F.col("file_path").alias("_f"), F.col("repository_id").alias("_r"))
    base = index.where("not ambiguous").select(F.col("symbol").alias("_base"), F.col("file_path").alias("_bf"), F.col("repository_id").alias("_br"))
    out = references.withColumn("_c", class_path(F.col("callee_symbol"))).withColumn("_base", F.col("_c.base"))
    out = out.join(exact, "callee_symbol", "left").join(base, "_base", "left")
    parent = F.try_element_at("_c.segments", F.lit(-1))
    fits = F.col("_bf").isNotNull() & (parent.isNull() | F.contains("_bf", parent))
    out = out.withColumn("target_file", F.coalesce("_f", F.when(fits, F.col("_bf")))).withColumn("target_repository", F.coalesce("_r", F.when(fits, F.col("_br"))))
    return out.drop("_c", "_base", "_f", "_r", "_bf", "_br")


def file_graph(references: DataFrame, index: DataFrame | None = None, min_weight: int = 1, cross: bool = True, symbols: bool = True) -> DataFrame:
    """Directed edges between files with weight (references), distinct kinds and, unless ``symbols`` is off, distinct symbols."""
    own = references.withColumn("target_file", F.when(F.col("reference_file_path") != F.col("caller_file_path"), F.col("reference_file_path")))
    own = own.withColumn("target_repository", F.when(F.col("target_file").isNotNull(), F.col("repository_id")))
    if index is not None:
        elsewhere = resolve_callee(own.where("target_file is null").drop("target_file", "target_repository"), index)
        own = own.where("target_file is not null").unionByName(elsewhere)
    own = own.where("target_file is not null").where("not (target_file = caller_file_path and target_repository = repository_id)")
    if not cross:
        own = own.where("target_repository = repository_id")
    keys = [F.col("caller_file_path").alias("from_file"), F.col("repository_id").alias("from_repository"), F.col("target_file").alias("to_file"), F.col("target_repository").alias("to_repository")]
    named = [F.sort_array(F.collect_set("callee_symbol")).alias("symbols")] if symbols else []
    out = own.groupBy(*keys).agg(F.count("*").alias("weight"), F.sort_array(F.collect_set("reference_kind")).alias("kinds"), *named)
    return out.where(F.col("weight") >= min_weight)


def uses(graph: DataFrame, source: str, target: str) -> DataFrame:
    return graph.where((F.col("from_repository") == source) & (F.col("to_repository") == target)).orderBy("to_file", "from_file")


def repository_labels(repositories: DataFrame) -> DataFrame:
    """(id, label): the name, with the first characters of the id where names collide."""
    same = repositories.groupBy("name").agg(F.count("*").alias("_n"))
    label = F.when(F.col("_n") > 1, F.concat("name", F.lit("-"), F.substring("id", 1, 8))).otherwise(F.col("name"))
    return repositories.join(same, "name").select("id", label.alias("label"))


def qualified_graph(graph: DataFrame, repositories: DataFrame) -> DataFrame:
    """Edges between ``label:path`` nodes of a namespace."""
    labels = repository_labels(repositories)
    out = graph
    for side in ("from", "to"):
        named = labels.select(F.col("id").alias(f"{side}_repository"), F.col("label").alias("_label"))
        out = out.join(named, f"{side}_repository").withColumn(f"{side}_file", F.concat("_label", F.lit(":"), f"{side}_file")).drop("_label")
    return out


def undirected_files(graph: DataFrame) -> DataFrame:
    """(a, b, weight) over unordered pairs of files; composite weights add up."""
    weighed = graph.select(F.least("from_file", "to_file").alias("a"), F.greatest("from_file", "to_file").alias("b"), edge_weight(F.col("weight"), F.col("kinds")).alias("w"))
    return weighed.groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("weight"))


def undirected_symbols(references: DataFrame) -> DataFrame:
    """(a, b, weight, language, repository_id) over unordered pairs of symbols."""
    own = references.where("caller_symbol is not null and caller_symbol <> callee_symbol")
    pair = (F.least("caller_symbol", "callee_symbol").alias("a"), F.greatest("caller_symbol", "callee_symbol").alias("b"))
    return own.groupBy(*pair).agg(F.round(F.sum(kind_weight(F.col("reference_kind"))), 6).alias("weight"), F.min_by("language", "id").alias("language"), F.min_by("repository_id", "id").alias("repository_id"))


def directory_counts(members: DataFrame, group: str | list[str], path: str, most: int = 3) -> DataFrame:
    """The directories that hold most members of a group: by count, depth and name."""
    from pyspark.sql import Window as W

    from lodestone.functions.paths import ancestors

    keys = [group] if isinstance(group, str) else group
    counted = members.select(*keys, F.explode(ancestors(F.col(path))).alias("directory")).groupBy(*keys, "directory").agg(F.count("*").alias("n"))
    depth = F.length("directory") - F.length(F.replace(F.col("directory"), F.lit("/"), F.lit("")))
    order = W.partitionBy(*keys).orderBy(F.desc("n"), F.desc(depth), "directory")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
