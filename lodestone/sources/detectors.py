"""Channel endpoints in source text: a table of detectors, and the settings that name channels.

Detectors read a whole file, so a call may go over several lines. A channel
given as a name or a property is kept, unresolved, until a setting resolves it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_QUOTED = r"[\"'`]([^\"'`\n]+)[\"'`]"
_Q = rf"(?:{_QUOTED}|([A-Za-z_$][\w$]*(?:\.[\w$]+)*)(?=\s*[,)\]}}]))"  # a text, or a name to be resolved
_JS, _PY, _RS = ("javascript", "typescript"), ("python",), ("rust",)
_CLIENT, _SERVER = "get|post|put|delete|patch|head", "get|post|put|delete|patch|all"

# Library, languages, protocol, role, pattern (its groups: the channel as a text, or as a name) and confidence.
DETECTORS = [
    ("axios", _JS, "http", "producer", rf"\baxios\.(?:{_CLIENT})\(\s*{_Q}", 0.9),
    ("fetch", _JS, "http", "producer", rf"\bfetch\(\s*{_Q}", 0.9),
    ("express", _JS, "http", "consumer", rf"\b(?:app|router)\.(?:{_SERVER})\(\s*{_Q}", 0.8),
    ("node_http", _JS, "http", "producer", rf"\bhttps?\.(?:get|request)\(\s*{_Q}", 0.7),
    ("kafkajs", _JS, "kafka", "producer", rf"\.send\(\s*\{{[^}}]*topic:\s*{_Q}", 0.8),
    ("kafkajs", _JS, "kafka", "consumer", rf"\.subscribe\(\s*\{{[^}}]*topics?:\s*\[?\s*{_Q}", 0.8),
    ("kafka_positional", _JS, "kafka", "producer", rf"\.produce\(\s*{_Q}", 0.5),
    ("mqtt", _JS, "mqtt", "producer", rf"\bclient\.publish\(\s*{_Q}", 0.6),
    ("mqtt", _JS, "mqtt", "consumer", rf"\bclient\.subscribe\(\s*{_Q}", 0.5),
    ("flask_fastapi", _PY, "http", "consumer", rf"@\w+\.(?:route|{_SERVER})\(\s*{_Q}", 0.9),
    ("requests", _PY, "http", "producer", rf"\b(?:requests|httpx|client)\.(?:{_CLIENT})\(\s*f?{_Q}", 0.9),
    ("kafka_python", _PY, "kafka", "producer", rf"\bproducer\.send\(\s*{_Q}", 0.6),
    ("kafka_python", _PY, "kafka", "consumer", rf"\bKafkaConsumer\(\s*{_Q}", 0.9),
    ("kafka_python", _PY, "kafka", "consumer", rf"\bconsumer\.subscribe\(\s*\[\s*{_Q}", 0.7),
    ("paho", _PY, "mqtt", "producer", rf"\bmqtt\w*\.publish\(\s*{_Q}", 0.6),
    ("paho", _PY, "mqtt", "consumer", rf"\bmqtt\w*\.subscribe\(\s*{_Q}", 0.5),
    ("axum", _RS, "http", "consumer", rf"\.route\(\s*{_Q}", 0.9),
    ("reqwest", _RS, "http", "producer", rf"\b(?:reqwest::|client\.)(?:{_CLIENT})\(\s*{_Q}", 0.9),
]


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _calls(content: Column, pattern: str) -> Column:
    """(line, text, name) of every match: its line is told by what stands before it."""
    every = lambda group: F.regexp_extract_all(content, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(content, pattern, -1).alias("before"), every(0).alias("whole"), every(1).alias("text"), every(2).alias("name"))
    parts = F.filter(parts, lambda p: p["whole"].isNotNull())  # what follows the last match
    none = F.array().cast("array<struct<line:int,text:string,name:string>>")

    def add(s: Column, p: Column) -> Column:
        line = s["line"] + _newlines(p["before"])
        hit = F.struct(line.alias("line"), F.nullif(p["text"], F.lit("")).alias("text"), F.nullif(p["name"], F.lit("")).alias("name"))
        return F.struct((line + _newlines(p["whole"])).alias("line"), F.concat(s["out"], F.array(hit)).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(1).alias("line"), none.alias("out")), add, lambda s: s["out"])


def _found(language: Column, content: Column) -> Column:
    each = []
    for library, languages, protocol, role, pattern, confidence in DETECTORS:
        row = lambda c: F.struct(F.lit(library).alias("library"), F.lit(protocol).alias("protocol"), F.lit(role).alias("role"), c["line"].alias("line"), F.coalesce(c["text"], c["name"]).alias("channel_raw"), F.lit(confidence).alias("confidence"), c["text"].isNotNull().alias("resolved"))  # noqa: B023, E731
        each.append(F.when(language.isin(*languages) & content.rlike(pattern), F.transform(_calls(content, pattern), row)))
    return F.flatten(F.filter(F.array(*each), lambda x: x.isNotNull()))


def extract(files: DataFrame, repository: str) -> DataFrame:
    """The rows of channel_endpoints: of each line, protocol, role and channel the detector of the most confidence.

    ``line``: where the call begins. ``resolved``: false where the channel is a
    name or a property. Null and empty contents give no rows.
    """
    hits = files.select("file_path", "language", F.explode(_found(F.col("language"), F.col("content"))).alias("hit")).select("file_path", "language", "hit.*")
    best = W.partitionBy("file_path", "line", "protocol", "role", "channel_raw").orderBy(F.desc("confidence"), F.desc("resolved"), "library")
    out = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    key = F.concat_ws("\0", F.lit(repository), "file_path", "line", "protocol", "role", "channel_raw")
    return out.withColumn("id", F.sha2(key.cast("binary"), 256)).withColumn("repository_id", F.lit(repository)).withColumn("source", F.lit("text"))


_TEXT = r"[\"'`]([^\"'`\n]*)[\"'`]"
_JS_VALUE = rf"(?:process\.env\.(\w+)\s*(?:\|\||\?\?)\s*)?{_TEXT}"
_PY_VALUE = rf"(?:os\.(?:getenv|environ\.get)\(\s*[\"'](\w+)[\"']\s*,\s*)?{_TEXT}"
_CONSTANT = {
    _JS: rf"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::\s*\w+\s*)?=\s*{_JS_VALUE}",
    _PY: rf"(?m)^\s*(\w+)\s*(?::\s*\w+\s*)?=\s*{_PY_VALUE}",
}
_OBJECT, _EXPORTED = r"(?:const|let|var)\s+(\w+)\s*(?::\s*\w+\s*)?=\s*\{([^{}]*)\}", r"(?:module\.exports\s*=|export\s+default)\s*\{([^{}]*)\}"
_FIELD = rf"(\w+)\s*:\s*{_JS_VALUE}"
_ASSIGNED = r"\b(?:this|self)\.(\w+)\s*=\s*([A-Za-z_$][\w$.]*)\s*(?:;|\n|\}|$)"


def _all(text: Column, pattern: str, *names: str) -> Column:
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def extract_settings(files: DataFrame) -> DataFrame:
    """(file_path, name, default, env_var) of constants and of the fields of configuration objects.

    A constant goes by its own name and by ``file.name``, a field by
    ``object.field``; an exported object without a name goes by its file's. A
    value is a text, or a text behind a variable of the environment.
    """
    stem = F.regexp_extract("file_path", r"([^/]+?)(?:\.\w+)?$", 1)
    own = files.where("content is not null").select("file_path", "language", "content", stem.alias("stem"))
    out = []
    for languages, pattern in _CONSTANT.items():
        found = own.where(F.col("language").isin(*languages)).select("file_path", "stem", F.explode(_all(F.col("content"), pattern, "name", "env_var", "default")).alias("x"))
        out.append(found.select("file_path", F.explode(F.array(F.col("x.name"), F.concat_ws(".", "stem", "x.name"))).alias("name"), "x.default", "x.env_var"))
    js = own.where(F.col("language").isin(*_JS))
    named = js.select("file_path", F.explode(_all(F.col("content"), _OBJECT, "name", "body")).alias("o")).select("file_path", "o.*")
    bare = js.select("file_path", F.col("stem").alias("name"), F.explode(F.regexp_extract_all("content", F.lit(_EXPORTED), F.lit(1))).alias("body"))
    fields = named.unionByName(bare).select("file_path", "name", F.explode(_all(F.col("body"), _FIELD, "field", "env_var", "default")).alias("x"))
    out.append(fields.select("file_path", F.concat_ws(".", "name", "x.field").alias("name"), "x.default", "x.env_var"))
    return reduce(DataFrame.unionByName, out).withColumn("env_var", F.nullif("env_var", F.lit("")))


def extract_aliases(files: DataFrame) -> DataFrame:
    """(file_path, alias, target): fields that are assigned a name or a property, once in their file."""
    own = files.select("file_path", F.explode(_all(F.col("content"), _ASSIGNED, "name", "target")).alias("x"))
    out = own.groupBy("file_path", F.col("x.name").alias("alias")).agg(F.min("x.target").alias("target"), F.max("x.target").alias("other"))
    return out.where("target = other").drop("other")


def resolve_names(endpoints: DataFrame, files: DataFrame) -> DataFrame:
    """Unresolved channels by the settings in the sources: those of the same file first, else one default that all others agree on.

    A field of the object itself (``this.topic``, ``self.topic``) is followed to what it was assigned.
    """
    tail = lambda c: F.regexp_extract(c, r"((?:\w+\.)?\w+)$", 1)
    settings = extract_settings(files)
    here = settings.groupBy("file_path", F.col("name").alias("_name")).agg(F.min(F.struct("default", "env_var")).alias("_here"))
    agreed = settings.groupBy(F.col("name").alias("_name")).agg(F.min(F.struct("default", "env_var")).alias("_there"), F.count_distinct("default").alias("_n")).where("_n = 1").drop("_n")
    alias = extract_aliases(files).withColumnRenamed("alias", "_alias")
    field = F.when(~F.col("resolved"), F.regexp_extract("channel_raw", r"^(?:this|self)\.(\w+)$", 1))
    out = endpoints.withColumn("_alias", field).join(alias, ["file_path", "_alias"], "left")
    out = out.withColumn("_name", F.when(~F.col("resolved"), tail(F.coalesce("target", "channel_raw"))))
    out = out.join(here, ["file_path", "_name"], "left").join(agreed, "_name", "left").withColumn("_s", F.coalesce("_here", "_there"))
    use = F.col("_s").isNotNull()
    return out.select(*(c for c in endpoints.columns if c not in ("channel_raw", "resolved", "env_var")), F.when(use, F.col("_s.default")).otherwise(F.col("channel_raw")).alias("channel_raw"), (F.col("resolved") | use).alias("resolved"), F.col("_s.env_var").alias("env_var"))


def resolve_config(endpoints: DataFrame, settings: DataFrame) -> DataFrame:
    """Channels written as a setting's name (``config.topic``) by the setting's default; ``settings``: name, default, env_var."""
    own = endpoints.withColumn("_name", F.regexp_extract("channel_raw", r"^(?:\w+\.)*(\w+\.\w+)$", 1))
    out = own.join(settings.withColumnsRenamed({"name": "_name", "default": "_default", "env_var": "_env"}), "_name", "left")
    use = F.col("_default").isNotNull() & ~F.col("resolved")
    out = out.withColumn("channel_raw", F.when(use, F.col("_default")).otherwise(F.col("channel_raw"))).withColumn("env_var", F.when(use, F.col("_env")))
    return out.withColumn("resolved", F.col("resolved") | use).drop("_name", "_default", "_env")
