"""Counts, overviews, and what changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_totals(references: DataFrame) -> DataFrame:
    return references.agg(F.count("*").alias("total"), F.count_distinct("caller_symbol").alias("callers"), F.count_distinct("callee_symbol").alias("callees"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def repository_stats(chunks: DataFrame, references: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Files, chunks, languages, references and endpoints by repository and over all (null repository)."""
    own = chunks.rollup("repository_id").agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("chunks"), F.count_distinct("language").alias("languages"))
    out = own.select(F.col("repository_id").alias("id"), "files", "chunks", "languages")
    for name, df in (("references", references), ("endpoints", endpoints)):
        counted = df.rollup("repository_id").agg(F.count("*").alias(name)).withColumnRenamed("repository_id", "other")
        out = out.join(counted, out["id"].eqNullSafe(counted["other"]), "full").select(F.coalesce("id", "other").alias("id"), *(c for c in (*out.columns[1:], name)))
    return out.withColumnRenamed("id", "repository_id").na.fill(0)


def language_totals(references: DataFrame) -> DataFrame:
    """References by language, the most first."""
    return counts_by(references, "language").orderBy(F.desc("n"), "language")


def language_shares(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repository_id", "language").agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("chunks"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repository_id, file_path, change): added, modified, deleted or unchanged.

    A null hash in ``after`` is a file that couldn't be read: it is retained, not deleted.
    """
    key = ["repository_id", "file_path"]
    old = before.select(*key, F.col("content_hash").alias("old"), F.lit(True).alias("_old"))
    new = after.select(*key, F.col("content_hash").alias("new"), F.lit(True).alias("_new"))
    change = (
        F.when(F.col("_new").isNull(), "deleted")
        .when(F.col("_old").isNull(), F.when(F.col("new").isNull(), "unreadable").otherwise("added"))
        .when(F.col("new").isNull(), "retained")
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("modified")
    )
    return old.join(new, key, "full").select(*key, change.alias("change"))


def apply_diff(chunks: DataFrame, diff: DataFrame, parsed: DataFrame) -> DataFrame:
    """Chunks of a snapshot after a diff: those of changed files go, newly parsed ones come."""
    gone = diff.where(F.col("change").isin("modified", "deleted", "added"))
    return chunks.join(gone, ["repository_id", "file_path"], "left_anti").unionByName(parsed)


def apply_references(references: DataFrame, diff: DataFrame, imported: DataFrame) -> DataFrame:
    """References of a snapshot after a diff, by the caller's file.

    Those of modified and deleted files go. ``imported`` replaces the references
    of every file in it, unchanged ones too, whose targets may have moved; what it
    holds of files that are gone is left out.
    """
    file = ["repository_id", F.col("file_path").alias("caller_file_path")]
    key = ["repository_id", "caller_file_path"]
    gone = diff.where(F.col("change").isin("modified", "deleted", "added")).select(*file)
    deleted = diff.where("change = 'deleted'").select(*file)
    renewed = imported.select(*key).distinct()
    stay = references.join(gone, key, "left_anti").join(renewed, key, "left_anti")
    return stay.select(references.columns).unionByName(imported.join(deleted, key, "left_anti").select(references.columns))


def chunk_counts(counts: DataFrame, before: DataFrame, diff: DataFrame, parsed: DataFrame) -> DataFrame:
    """(repository_id, n) after a diff: stored counts, less the chunks that went, at least 0, and the ones that came."""
    gone = before.join(diff.where(F.col("change").isin("modified", "deleted", "added")), ["repository_id", "file_path"], "left_semi")
    each = lambda df, name: df.groupBy("repository_id").agg(F.count("*").alias(name))
    out = counts.join(each(gone, "_gone"), "repository_id", "full").join(each(parsed, "_new"), "repository_id", "full").na.fill(0, ["n", "_gone", "_new"])
    return out.select("repository_id", (F.greatest(F.col("n") - F.col("_gone"), F.lit(0)) + F.col("_new")).alias("n"))


def stale_analyses(diff: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repository_id): owners of stored analyses that a diff makes stale, namespaces as ``__namespace__:name``.

    A diff of unchanged, retained and unreadable files makes none stale.
    """
    changed = diff.where(F.col("change").isin("modified", "deleted", "added")).select("repository_id").distinct()
    spaces = repositories.join(changed, F.col("id") == F.col("repository_id"), "left_semi").where("namespace is not null").select(F.concat(F.lit("__namespace__:"), "namespace").alias("repository_id")).distinct()
    return changed.unionByName(spaces)


def overview_report(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, n, note): the rows of each section; one that fails has the error's class as its note, and the others stay."""
    out = []
    for name, df in sections.items():
        try:
            out.append((name, df.count(), None))
        except Exception as error:  # a section's own, of whatever kind
            out.append((name, 0, f"skipped: {type(error).__name__}"))
    spark = next(iter(sections.values())).sparkSession
    return spark.createDataFrame(out, "section string, n long, note string")


def overview(chunks: DataFrame, references: DataFrame, endpoints: DataFrame) -> dict[str, DataFrame]:
    """The overview's sections; each is a plan of its own, so one that fails leaves the others."""
    from lodestone.operators.channels import link
    from lodestone.operators.flows import features
    from lodestone.operators.filegraph import file_graph

    return {
        "statistics": repository_stats(chunks, references, endpoints),
        "languages": language_shares(chunks),
        "call_graph": graph_totals(references),
        "features": features(references, limit=10),
        "dependencies": file_graph(references).orderBy(F.desc("weight"), "from_file", "to_file").limit(10),
        "channels": link(endpoints).orderBy(F.desc("weight"), "channel", "p_file_path", "c_file_path").limit(10),
    }
