"""Source and import queries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.plans.views import SOURCES, sql, view
from lodestone.sources import chunkers, detectors, scip, walk
from lodestone.storage import shared_dir

_FILE = "concat('src/c', l_suppkey % 23, '.ts')"
SOURCES["occurrences"] = (
    "lineitem",
    {
        "document": _FILE,
        "ordinal": "CAST(l_suppkey % 23 AS INT)",
        "language": "CASE WHEN l_suppkey % 23 < 15 THEN 'typescript' WHEN l_suppkey % 23 < 20 THEN 'php' ELSE 'go' END",
        "symbol": "concat('scip-x npm ', CASE WHEN l_partkey % 3 = 0 THEN '.' ELSE concat('lib', l_partkey % 9) END, ' 1.0 src/', CASE WHEN l_partkey % 2 = 0 THEN '`a.ts`/' ELSE '' END, 'C', l_partkey % 11, CASE WHEN l_partkey % 5 = 0 THEN '#' ELSE '/' END, 'm', l_partkey, CASE WHEN l_partkey % 7 = 0 THEN '.' ELSE '().' END)",
        "roles": "CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 8 WHEN 4 THEN 64 ELSE 0 END",
        "line": "CAST(l_orderkey % 9973 AS INT)",
        "column": "CAST(l_quantity AS INT)",
        "kind": "CASE WHEN l_linenumber = 5 THEN 'Class' WHEN l_linenumber = 6 THEN 'Function' END",
    },
)
_DESC = "regexp_extract(symbol, '^([^ ]* ){4}(.*)$', 2)"
_CLEAN = f"replace(regexp_replace(regexp_replace({_DESC}, '\\(\\)\\.$', ''), '\\.$', ''), '`', '')"
_NAME = f"CASE WHEN language = 'php' THEN replace({_CLEAN}, '/', chr(92)) ELSE regexp_replace({_CLEAN}, '^.*\\.ts/', '') END"


def occurrences(spark, sf_dir):
    base, columns = SOURCES["occurrences"]
    return spark.read.parquet(f"{sf_dir}/{base}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


@query("scip_norm", sql(f"SELECT DISTINCT symbol, language, {_NAME} AS name FROM occurrences", "occurrences"))
def scip_norm(spark, sf_dir):
    return occurrences(spark, sf_dir).select("symbol", "language", scip.normalized_symbol(F.col("symbol"), F.col("language")).alias("name")).distinct()


@query("scip_pkg", sql("SELECT DISTINCT symbol, nullif(split_part(symbol, ' ', 3), '.') AS package FROM occurrences", "occurrences"))
def scip_pkg(spark, sf_dir):
    return occurrences(spark, sf_dir).select("symbol", scip.package_of(F.col("symbol")).alias("package")).distinct()


_KIND = "CASE WHEN roles = 2 THEN 'import' WHEN kind = 'Class' THEN 'type_reference' WHEN kind = 'Function' THEN 'call' WHEN ends_with(symbol, '().') THEN CASE WHEN contains(symbol, '#') THEN 'method_call' ELSE 'call' END WHEN roles = 8 THEN 'variable_reference' ELSE 'unknown' END"


@query("scip_kind", sql(f"SELECT DISTINCT roles, kind, symbol, {_KIND} AS reference_kind FROM occurrences", "occurrences"))
def scip_kind(spark, sf_dir):
    return occurrences(spark, sf_dir).select("roles", "kind", "symbol", scip.reference_kind(F.col("roles"), F.col("kind"), F.col("symbol")).alias("reference_kind")).distinct()


_DEFS = "dm AS (SELECT symbol, arg_min(document, (roles <> 1, ordinal)) AS file FROM occurrences WHERE roles IN (1, 64) AND language <> 'go' GROUP BY symbol)"


@query("scip_defmap", sql(f"+ {_DEFS} SELECT symbol, file FROM dm", "occurrences"))
def scip_defmap(spark, sf_dir):
    return scip.definition_files(occurrences(spark, sf_dir))


_SCOPED = f"sc AS (SELECT o.*, (SELECT max((d.line, d.name)) FROM (SELECT document, line, {_NAME} AS name FROM occurrences WHERE roles = 1 AND ends_with(symbol, '().') AND language <> 'go') d WHERE d.document = o.document AND d.line <= o.line)[2] AS scope FROM occurrences o WHERE language <> 'go')"


@query("scip_scope", sql(f"+ {_SCOPED} SELECT document, line, max(scope) AS scope FROM sc GROUP BY ALL", "occurrences"))
def scip_scope(spark, sf_dir):
    own = occurrences(spark, sf_dir).where("language <> 'go'")
    return scip.with_scopes(own).groupBy("document", "line").agg(F.max("enclosing_scope").alias("scope"))


@query("scip_refs", sql(f"+ {_DEFS} SELECT DISTINCT document AS caller_file_path, coalesce(file, document) AS reference_file_path, {_NAME} AS callee_symbol, CAST(line + 1 AS INT) AS reference_line, CAST(\"column\" + 1 AS INT) AS reference_column, {_KIND} AS reference_kind FROM occurrences LEFT JOIN dm USING (symbol) WHERE language <> 'go' AND roles NOT IN (1, 64)", "occurrences"))
def scip_refs(spark, sf_dir):
    return scip.references(occurrences(spark, sf_dir), "r").select("caller_file_path", "reference_file_path", "callee_symbol", "reference_line", "reference_column", "reference_kind").distinct()


@query("src_scip")
def src_scip(spark, sf_dir):
    return scip.references(occurrences(spark, sf_dir), "r")


@query("scip_ignore", sql("SELECT id FROM refs WHERE caller_file_path NOT LIKE 'src/pkg1/%' AND reference_file_path NOT LIKE 'src/pkg1/%'", "refs"))
def scip_ignore(spark, sf_dir):
    refs = view(spark, sf_dir, "refs")
    every = view(spark, sf_dir, "refs", distinct=False)
    paths = every.select(F.col("caller_file_path").alias("file_path")).union(every.select("reference_file_path")).distinct()
    return scip.without_ignored(refs, paths.where(walk.is_ignored(F.col("file_path"), ["/src/pkg1/"]))).select("id")


def _sources(spark, sf_dir):
    """Every document as a source file: its first words name functions and channels."""
    own = view(spark, sf_dir, "chunks")
    body = F.concat(
        F.lit("import x\n\n@app.get('/"), "id", F.lit("')\ndef f_"), "id", F.lit("(a):\n    requests.get('http://h/"), "id", F.lit("/1')\n    producer.send('t."), "language", F.lit("', a)\n\nclass K_"), "id", F.lit(":\n    y = 1234567\n"),
    )
    return own.select(F.concat("file_path", F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), body.alias("content"))


@query("src_parse", sql("SELECT 'f_' || id AS symbol_name, 'function' AS node_type, CAST(4 AS INT) AS start_line, CAST(6 AS INT) AS end_line FROM chunks UNION ALL SELECT 'K_' || id, 'class', 8, 9 FROM chunks", "chunks"))
def src_parse(spark, sf_dir):
    return chunkers.parse(_sources(spark, sf_dir), "r").select("symbol_name", "node_type", "start_line", "end_line")


@query("ch_extract", sql("SELECT file_path || '.py' AS file_path, CAST(3 AS INT) AS line, 'http' AS protocol, 'consumer' AS role, '/' || id AS channel_raw FROM chunks UNION ALL SELECT file_path || '.py', 5, 'http', 'producer', 'http://h/' || id || '/1' FROM chunks UNION ALL SELECT file_path || '.py', 6, 'kafka', 'producer', 't.' || language FROM chunks", "chunks"))
def ch_extract(spark, sf_dir):
    return detectors.extract(_sources(spark, sf_dir), "r").select("file_path", "line", "protocol", "role", "channel_raw")


def _named(spark, sf_dir):
    """Every document as two files: a module of settings, and one that calls by their names over several lines."""
    own = view(spark, sf_dir, "chunks")
    settings = F.concat(F.lit("const config = {\n  topic: process.env.TOPIC || 't."), "id", F.lit("',\n};\nconst U_"), "id", F.lit(" = '/u/"), "id", F.lit("';\n"))
    calls = F.concat(F.lit("axios.get(\n  U_"), "id", F.lit(",\n);\nbus.send({\n  acks: 1,\n  topic: config.topic,\n});\nfetch(nowhere.at)\naxios.post('/p/"), "id", F.lit("')\n"))
    both = F.array(F.struct(F.lit("s").alias("k"), settings.alias("content")), F.struct(F.lit("c").alias("k"), calls.alias("content")))
    files = own.select("id", F.explode(both).alias("f"))
    return files.select(F.concat("id", F.lit("."), "f.k", F.lit(".js")).alias("file_path"), F.lit("javascript").alias("language"), "f.content")


_CALLS_MADE = "SELECT id || '.c.js' AS file_path, CAST(1 AS INT) AS line, 'http' AS protocol, {0} AS channel_raw, {1} AS resolved FROM chunks UNION ALL SELECT id || '.c.js', 4, 'kafka', 'config.topic', {2} FROM chunks UNION ALL SELECT id || '.c.js', 8, 'http', 'nowhere.at', FALSE FROM chunks UNION ALL SELECT id || '.c.js', 9, 'http', '/p/' || id, TRUE FROM chunks"


@query("ch_unresolved", sql(_CALLS_MADE.format("'U_' || id", "FALSE", "FALSE"), "chunks"))
def ch_unresolved(spark, sf_dir):
    """Calls over several lines; channels given by names stay, unresolved."""
    return detectors.extract(_named(spark, sf_dir), "r").select("file_path", "line", "protocol", "channel_raw", "resolved")


@query("ch_resolved", sql(_CALLS_MADE.format("'/u/' || id", "TRUE", "FALSE"), "chunks"))
def ch_resolved(spark, sf_dir):
    """The same, with settings found in the sources; on a name with several defaults (config.topic) nothing is guessed."""
    own = _named(spark, sf_dir)
    return detectors.resolve_names(detectors.extract(own, "r"), own).select("file_path", "line", "protocol", "channel_raw", "resolved")


@query("ch_detectors")
def ch_detectors(spark, sf_dir):
    return spark.createDataFrame([(a, ",".join(b), c, d, e, f) for a, b, c, d, e, f in detectors.DETECTORS], "library string, languages string, protocol string, role string, pattern string, confidence double")


@query("ch_config", sql("SELECT id, CASE WHEN protocol = 'kafka' AND NOT resolved THEN 'orders' ELSE CASE WHEN protocol = 'kafka' THEN 'config.topic' ELSE channel_raw END END AS channel_raw, resolved OR protocol = 'kafka' AS resolved FROM endpoints", "endpoints"))
def ch_config(spark, sf_dir):
    own = view(spark, sf_dir, "endpoints").withColumn("channel_raw", F.when(F.col("protocol") == "kafka", "config.topic").otherwise(F.col("channel_raw")))
    settings = spark.createDataFrame([("config.topic", "orders", "ORDERS_TOPIC")], "name string, default string, env_var string")
    return detectors.resolve_config(own, settings).select("id", "channel_raw", "resolved")


@query("src_walk", "SELECT * FROM (VALUES ('a/m.py', 'python'), ('b.rs', 'rust')) t(file_path, language)")
def src_walk(spark, sf_dir):
    """Four files written and read again: one is hidden, one ignored."""
    root = f"{shared_dir(spark)}/walk-{uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in ("a/m.py", "b.rs", ".git/x.py", "out/gen.py"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        stream = path.getFileSystem(conf).create(path)
        stream.writeBytes(f"text of {name}\n")
        stream.close()
    return walk.source_files(spark, root, ["out/"]).select("file_path", "language")
