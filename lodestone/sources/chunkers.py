"""Chunks of source files: definitions found line by line, as DataFrame expressions.

Without grammars, a definition starts where a language's pattern matches a
line and ends before the next line that isn't indented deeper (or, in
languages of braces, with the line that closes them at its indent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 10

# Definitions by language; the group is the name.
PATTERNS = {
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:]+(?:<[^>]*>)?\s+for\s+)?(\w+)")],
    "javascript": [("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\("), ("method", r"^\s+(?:static\s+)?(?:async\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)\s*\([^;]*\)\s*\{\s*$")],
    "typescript": [("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|async|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)\s*\([^;]*\)[^;=]*\{\s*$")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("struct", r"^type\s+(\w+)\s+struct")],
    "php": [("function", r"^\s*(?:(?:public|private|protected|static)\s+)*function\s+(\w+)"), ("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)")],
    "cpp": [("class", r"^\s*(?:class|struct)\s+(\w+)"), ("function", r"^[\w:<>&*~\s]+?\b(?!if\b|for\b|while\b|switch\b|catch\b|return\b)(\w+)\s*\([^;]*$")],
    "swift": [("function", r"^\s*(?:\w+\s+)*func\s+(\w+)"), ("class", r"^\s*(?:\w+\s+)*class\s+(\w+)"), ("struct", r"^\s*(?:\w+\s+)*struct\s+(\w+)")],
    "kotlin": [("function", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(\w+)"), ("class", r"^\s*(?:\w+\s+)*class\s+(\w+)")],
    "hcl": [("block", r"^(\w+)\s+\"")],
}

# Kinds of definitions that others can stand in.
CONTAINERS = ("class", "struct", "enum", "trait", "impl", "interface")
# Definitions that name their container themselves; the group is its name.
RECEIVERS = {"go": r"^func\s+\(\s*(?:\w+\s+)?\*?\s*(\w+)", "cpp": r"(\w+)(?:<[^>]*>)?::~?\w+\s*\("}


def _definition(language: Column, line: Column) -> Column:
    """(kind, name, receiver) of a line, or null where no pattern of the language matches."""
    out = F.lit(None)
    for own, patterns in PATTERNS.items():
        receiver = F.nullif(F.regexp_extract(line, RECEIVERS[own], 1), F.lit("")) if own in RECEIVERS else F.lit(None).cast("string")
        for node, regex in reversed(patterns):
            hit = F.struct(F.lit(node).alias("kind"), F.regexp_extract(line, regex, 1).alias("name"), receiver.alias("receiver"))
            out = F.when((language == own) & line.rlike(regex), hit).otherwise(out)
    return out


def parse(files: DataFrame, repository: str) -> DataFrame:
    """The rows of chunks: one for each definition, lines from 1; chunks of less than ten bytes go.

    A file is worked on within its row, so only finished chunks leave it.
    ``parent_symbol``: the innermost class, or its like, around the definition;
    a receiver (Go) or a qualified name (C++) says it itself. Null contents and
    languages without patterns give no rows.
    """
    depth = lambda c: F.length(F.regexp_extract(c, r"^\s*", 0))
    mark = lambda x, i: F.struct(i.alias("at"), depth(x).alias("indent"), (~x.rlike(r"\S")).alias("blank"), x.rlike(r"^\s*[}\])]").alias("closes"), _definition(F.col("language"), x).alias("d"))
    rows = files.where(F.col("language").isin(*PATTERNS)).select("file_path", "language", F.split("content", "\r?\n").alias("all"))
    rows = rows.withColumn("marks", F.transform("all", mark))

    # a definition reaches to the first line that is neither blank nor deeper, with it if it closes
    def reach(m: Column) -> Column:
        after = F.filter(F.slice("marks", m["at"] + 2, F.size("marks")), lambda x: ~x["blank"] & (x["indent"] <= m["indent"]))
        stop = F.get(after, F.lit(0))
        last = F.coalesce(stop["at"] - F.when(stop["closes"], 0).otherwise(1), F.size("marks") - 1)
        return F.struct(m["at"].alias("at"), last.alias("last"), m["d"]["kind"].alias("kind"), m["d"]["name"].alias("name"), m["d"]["receiver"].alias("receiver"))

    rows = rows.withColumn("found", F.transform(F.filter("marks", lambda m: m["d"].isNotNull()), reach)).drop("marks")

    def chunk(d: Column) -> Column:
        around = F.filter("found", lambda p: p["kind"].isin(*CONTAINERS) & (p["at"] < d["at"]) & (p["last"] >= d["at"]))
        text = F.regexp_replace(F.array_join(F.slice("all", d["at"] + 1, d["last"] - d["at"] + 1), "\n"), r"\s+$", "")
        return F.struct(d["at"].alias("at"), d["kind"].alias("kind"), d["name"].alias("name"), F.coalesce(d["receiver"], F.try_element_at(around, F.lit(-1))["name"]).alias("parent"), text.alias("content"))

    out = rows.select("file_path", "language", F.explode(F.transform("found", chunk)).alias("c")).where(F.octet_length(F.trim("c.content")) >= LEAST)
    start = (F.col("c.at") + 1).cast("int")
    return out.select(
        F.sha2(F.concat_ws("\0", F.lit(repository), "file_path", start, "c.name").cast("binary"), 256).alias("id"),
        "file_path",
        "c.content",
        start.alias("start_line"),
        (start + F.size(F.split("c.content", "\n")) - 1).cast("int").alias("end_line"),
        "language",
        F.col("c.kind").alias("node_type"),
        F.col("c.name").alias("symbol_name"),
        F.col("c.parent").alias("parent_symbol"),
        F.lit(repository).alias("repository_id"),
    )
