"""The driver's tables as the tables of the code model.

Each view is a list of expressions in the SQL that Spark and DuckDB share, so
the queries and their twins start from the same rows. All rows of the base
tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import table

CHUNKS = {
    "id": "concat('c', doc_id)",
    "file_path": "concat(source, CASE WHEN doc_id % 10 = 0 THEN '/tests/' ELSE '/' END, lang, '/', doc_id, '.txt')",
    "content": "text",
    "start_line": "CAST(1 AS INT)",
    "end_line": "CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT)",
    "language": "lang",
    "node_type": "CASE doc_id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'block' END",
    "symbol_name": "nullif(regexp_extract(text, '[A-Za-z]+', 0), '')",
    "parent_symbol": "CASE WHEN doc_id % 4 = 0 THEN concat('P', doc_id % 9) END",
    "repository_id": "source",
}
_CALLER, _CALLEE = "l_partkey", "(l_suppkey * 13 + l_linenumber)"


def _symbol(k: str) -> str:
    return f"concat('pkg', {k} % 7, '.C', {k} % 23, '#m', {k})"


def _file(k: str) -> str:
    return f"concat('src/pkg', {k} % 7, '/c', {k} % 23, '.py')"


REFS = {
    "id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT))",
    "caller_symbol": f"CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN NULL ELSE {_symbol(_CALLER)} END",
    "callee_symbol": _symbol(_CALLEE),
    "caller_file_path": _file(_CALLER),
    "reference_file_path": _file(_CALLEE),
    "reference_line": "CAST(l_quantity AS INT)",
    "reference_column": "CAST(l_linenumber AS INT)",
    "reference_kind": "CASE l_linenumber WHEN 1 THEN 'call' WHEN 2 THEN 'method_call' WHEN 3 THEN 'import' WHEN 4 THEN 'type_reference' "
    "WHEN 5 THEN 'instantiation' WHEN 6 THEN 'implementation' ELSE 'inheritance' END",
    "language": f"CASE {_CALLER} % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' ELSE 'typescript' END",
    "repository_id": f"concat('r', {_CALLER} % 5)",
    "import_alias": f"CASE WHEN l_linenumber = 3 THEN concat('m', {_CALLEE}) END",
}
REPOSITORIES = {
    "id": "concat('r', r_regionkey)",
    "name": "lower(CASE WHEN r_regionkey = 4 THEN 'asia' ELSE r_name END)",
    "namespace": "CASE WHEN r_regionkey < 3 THEN 'core' ELSE 'edge' END",
}
_PROTOCOL = "CASE event_type WHEN 'click' THEN 'http' WHEN 'error' THEN 'kafka' WHEN 'purchase' THEN 'mqtt' WHEN 'signup' THEN 'kafka' ELSE 'http' END"
ENDPOINTS = {
    "id": "concat('e', event_id)",
    "repository_id": "concat('r', user_id % 5)",
    "file_path": "concat(CASE WHEN user_id % 11 = 0 THEN 'tests/' ELSE 'src/' END, 's', user_id % 37, '.js')",
    "enclosing_symbol": "concat('h', user_id % 101)",
    "line": "CAST(event_id % 400 AS INT)",
    "protocol": _PROTOCOL,
    "role": "CASE WHEN event_id % 2 = 0 THEN 'producer' ELSE 'consumer' END",
    "channel_raw": f"CASE WHEN ({_PROTOCOL}) = 'http' THEN concat('/api//', user_id % 29, '/', CASE WHEN event_id % 3 = 0 THEN ':id' ELSE concat(event_id % 7) END, '?q=1') "
    f"WHEN ({_PROTOCOL}) = 'mqtt' THEN concat('dev/', user_id % 17, '/', CASE WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN '+' ELSE concat('t', event_id % 4) END) "
    "ELSE concat(' topic.', user_id % 41, ' ') END",
    "confidence": "CAST(0.5 + (event_id % 5) / 10.0 AS DOUBLE)",
    "resolved": "event_id % 13 <> 0",
}
PAIR = {"vec_id": "vec_id", "chunk_id": "concat('c', vec_id)", "vector": "embedding"}
SOURCES = {
    "chunks": ("documents", CHUNKS),
    "refs": ("lineitem", REFS),
    "repositories": ("region", REPOSITORIES),
    "endpoints": ("events", ENDPOINTS),
    "vectors": ("embeddings", PAIR),
}


# What the columns of ``refs`` are made of, in names of the base table: rows are the same if these are. A row without a line number
# shows its keys in its id only, which passes over the missing ones.
_QUANTITY = "CAST(l_quantity AS INT)"
_NO_LINE = f"CASE WHEN l_linenumber IS NULL THEN concat_ws('-', l_orderkey, l_partkey, l_suppkey, {_QUANTITY}) END"
REFS_KEYS = {
    "l_orderkey": "CASE WHEN l_linenumber IS NOT NULL THEN l_orderkey END",
    "l_linenumber": "l_linenumber",
    "l_partkey": "l_partkey",
    "l_suppkey": "CASE WHEN l_linenumber IS NOT NULL THEN l_suppkey END",
    "l_quantity": _QUANTITY,
    "anonymous": "coalesce(l_linenumber = 1 AND l_returnflag = 'R' AND l_partkey IS NOT NULL, FALSE)",
    "whole_id": _NO_LINE,
}


def _references(spark: SparkSession, sf_dir: str, distinct: bool) -> DataFrame:
    """The references, distinct by numbers before any name is made of them."""
    base = table(spark, sf_dir, SOURCES["refs"][0])
    if not distinct:
        return base.selectExpr(*(f"{e} AS {c}" for c, e in REFS.items()))
    own = base.selectExpr(*(f"{e} AS {c}" for c, e in REFS_KEYS.items())).distinct()
    made = REFS | {"id": f"coalesce(whole_id, {REFS['id']})"}
    own = own.selectExpr("*", "CASE WHEN anonymous THEN 'R' END AS l_returnflag")
    return own.selectExpr(*(f"{e} AS {c}" for c, e in made.items()))


def view(spark: SparkSession, sf_dir: str, name: str, distinct: bool = True) -> DataFrame:
    """``distinct``: off for references of which only distinct values are asked, so rows that occur again may stay."""
    if name == "refs":
        return _references(spark, sf_dir, distinct)
    base, columns = SOURCES[name]
    return table(spark, sf_dir, base).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """The twin's text: the named views, then the body (which may go on with WITH's list)."""
    parts = []
    for name in names:
        base, columns = SOURCES[name]
        listed = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {'DISTINCT ' * (name == 'refs')}{listed} FROM {base})")
    joint = "" if not parts else ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts)
    return f"{joint}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().lstrip('+')}"
