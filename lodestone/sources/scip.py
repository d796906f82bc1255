"""Import of symbol indexes: occurrences of symbols in documents become references.

``occurrences``: document, ordinal (of the document in its index), language,
symbol (raw), roles (bits), line and column (from 0), kind (of the symbol, or
null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.storage import written

# Bits of an occurrence's roles.
DEFINITION, IMPORT, READ, FORWARD = 1, 2, 8, 64
# Kinds of symbols by the kind of reference that they make.
KINDS = {
    "type_reference": ("Class", "Interface", "Struct", "Enum", "TypeAlias", "Type"),
    "instantiation": ("Constructor",),
    "method_call": ("Method", "AbstractMethod", "StaticMethod", "Getter", "Setter"),
    "call": ("Function",),
}
INDEXED = ("javascript", "typescript", "php")


def descriptor(symbol: Column) -> Column:
    """What follows the four fields of scheme and package; null if there are fewer."""
    return F.nullif(F.regexp_extract(symbol, r"(?s)^(?:[^ ]* ){4}(.*)$", 1), F.lit(""))


def normalized_symbol(symbol: Column, language: Column) -> Column:
    """The readable name: no suffix, no backticks; namespaces of PHP by \\, no source file before other names; empty for locals."""
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(descriptor(symbol), r"(?:\(\)\.)+$", ""), r"\.+$", ""), "#+$", ""), "/+$", "")
    plain = F.replace(cleaned, F.lit("`"), F.lit(""))
    short = F.regexp_replace(plain, r"(?s)^.*\.(?:js|ts|jsx|tsx|mjs|cjs|mts|cts)/", "")
    name = F.when(language == "php", F.replace(plain, F.lit("/"), F.lit("\\"))).otherwise(short)
    return F.when(F.startswith(symbol, F.lit("local ")), "").otherwise(F.coalesce(name, symbol))


def package_of(symbol: Column) -> Column:
    name = F.nullif(F.nullif(F.split_part(symbol, F.lit(" "), F.lit(3)), F.lit("")), F.lit("."))
    return F.when(~F.startswith(symbol, F.lit("local ")), name)


def reference_kind(roles: Column, kind: Column, symbol: Column) -> Column:
    called = F.endswith(symbol, F.lit("()."))
    guess = F.when(called & F.contains(descriptor(symbol), F.lit("#")), "method_call").when(called, "call")
    out = guess.when(roles.bitwiseAND(READ) != 0, "variable_reference").otherwise("unknown")
    for name, kinds in KINDS.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return F.when(roles.bitwiseAND(IMPORT) != 0, "import").otherwise(out)


def _named(occurrences: DataFrame) -> DataFrame:
    """Occurrences of indexed languages with their names, written: each distinct symbol's name is made once."""
    own = occurrences.where(F.col("language").isin(*INDEXED) & ~F.startswith("symbol", F.lit("local ")))
    names = own.select("symbol", "language").distinct().withColumn("name", normalized_symbol(F.col("symbol"), F.col("language")))
    return written(own.join(written(names, "names").where("name <> ''"), ["symbol", "language"]), "occurrences")


def definition_files(occurrences: DataFrame) -> DataFrame:
    """(symbol, file): the first document that defines a raw symbol; forward definitions only fill gaps."""
    return _definitions(_named(occurrences.where(F.col("roles").bitwiseAND(DEFINITION | FORWARD) != 0)))


def _definitions(named: DataFrame) -> DataFrame:
    defines, forward = (F.col("roles").bitwiseAND(b) != 0 for b in (DEFINITION, FORWARD))
    own = named.where(defines | forward)
    return own.groupBy("symbol").agg(F.min_by("document", F.struct((~defines).alias("weak"), "ordinal")).alias("file"))


def with_scopes(occurrences: DataFrame) -> DataFrame:
    """Occurrences with the name of the last callable defined at or above their line in the document (an as-of join).

    A scope is its line's, so it is found for the distinct lines, which are
    dealt into blocks within documents: a long document isn't one task's, and each
    block starts from the last definition of the blocks before it.
    """
    callable_ = (F.col("roles").bitwiseAND(DEFINITION) != 0) & F.endswith("symbol", F.lit("()."))
    name = F.col("name") if "name" in occurrences.columns else normalized_symbol(F.col("symbol"), F.col("language"))
    defined = occurrences.where(callable_).groupBy("document", "line").agg(F.max(name).alias("_name"))
    lines = occurrences.select("document", "line").distinct().join(defined, ["document", "line"], "left").withColumn("_block", F.floor(F.col("line") / 4096))
    lines = written(lines.withColumn("_scope", F.when(F.col("_name").isNotNull(), F.struct("line", F.col("_name").alias("name")))), "lines")
    last = lines.groupBy("document", "_block").agg(F.max("_scope").alias("_last"))
    before = W.partitionBy("document").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("document", "_block", F.last("_last", True).over(before).alias("_carried"))
    here = W.partitionBy("document", "_block").orderBy("line").rangeBetween(W.unboundedPreceding, W.currentRow)
    known = lines.withColumn("_here", F.max("_scope").over(here)).join(carried, ["document", "_block"])
    known = known.select("document", "line", F.coalesce("_here", "_carried")["name"].alias("enclosing_scope"))
    return occurrences.join(known, ["document", "line"])


def references(occurrences: DataFrame, repository: str) -> DataFrame:
    """The rows of symbol_references: occurrences that aren't definitions, with the callee's file and the scope they are in."""
    named = _named(occurrences)
    own = with_scopes(named).where(F.col("roles").bitwiseAND(DEFINITION | FORWARD) == 0)
    own = own.select("document", "line", "column", "name", reference_kind(F.col("roles"), F.col("kind"), F.col("symbol")).alias("reference_kind"), "symbol", "language", "enclosing_scope")
    # the id is made of these columns and the repository: rows that occur again go before it is, and before the files come
    own = own.dropDuplicates(["document", "line", "column", "name", "reference_kind"]).join(_definitions(named), "symbol", "left")
    out = own.select(
        F.col("enclosing_scope").alias("caller_symbol"),
        F.col("name").alias("callee_symbol"),
        F.col("document").alias("caller_file_path"),
        F.coalesce("file", "document").alias("reference_file_path"),
        (F.col("line") + 1).cast("int").alias("reference_line"),
        (F.col("column") + 1).cast("int").alias("reference_column"),
        "reference_kind",
        "language",
        F.lit(repository).alias("repository_id"),
        "enclosing_scope",
        F.lit(None).cast("string").alias("import_alias"),
        package_of(F.col("symbol")).alias("callee_package"),
    )
    key = ("repository_id", "caller_file_path", "reference_line", "reference_column", "callee_symbol", "reference_kind")
    return out.withColumn("id", F.sha2(F.concat_ws("\0", *key).cast("binary"), 256))


def without_ignored(refs: DataFrame, ignored: DataFrame) -> DataFrame:
    """References whose files are both not among the ignored paths (file_path)."""
    for side in ("caller_file_path", "reference_file_path"):
        refs = refs.join(ignored.select(F.col("file_path").alias(side)).distinct(), side, "left_anti")
    return refs
