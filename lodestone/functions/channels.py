"""Channel names: routes, topics and their matching, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_url(raw: Column) -> Column:
    """struct(host, path) of an http or https URL; null for anything else, which is a path of its own."""
    host = F.regexp_extract(raw, r"^https?://([^/]*)", 1)
    path = F.regexp_extract(raw, r"^https?://[^/]*(/.*)?$", 1)
    return F.when(raw.rlike("^https?://"), F.struct(host.alias("host"), F.when(path == "", "/").otherwise(path).alias("path")))


def normalize_route(path: Column) -> Column:
    """No query or fragment, single slashes, parameters as {}; nothing is /."""
    segments = F.filter(F.split(F.regexp_extract(path, r"^([^?#]*)", 1), "/"), lambda s: s != "")
    named = F.transform(segments, lambda s: F.when(s.rlike(r"^:|^\{.*\}$|^<.*>$"), F.lit("{}")).otherwise(s))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def normalize_channel(protocol: Column, raw: Column) -> Column:
    """struct(host, name, is_pattern) by protocol."""
    url = split_url(raw)
    http = protocol == "http"
    name = F.when(http, normalize_route(F.coalesce(url["path"], raw))).otherwise(F.trim(raw))
    pattern = (protocol == "mqtt") & raw.rlike("[+#]")
    return F.struct(F.when(http, url["host"]).alias("host"), name.alias("name"), pattern.alias("is_pattern"))


def segments(route: Column) -> Column:
    return F.filter(F.split(route, "/"), lambda s: s != "")


def route_matches(client: Column, server: Column) -> Column:
    """As many segments, each equal or a parameter on either side."""
    a, b = segments(client), segments(server)
    pairs = F.zip_with(a, b, lambda x, y: (x == y) | (x == "{}") | (y == "{}"))
    return (F.size(a) == F.size(b)) & F.forall(pairs, lambda p: F.coalesce(p, F.lit(False)))


def topic_matches(pattern: Column, topic: Column) -> Column:
    """MQTT patterns: + is one segment, # any rest."""
    wanted, there = F.split(pattern, "/"), F.split(topic, "/")
    rest = F.array_position(wanted, "#")
    checked = F.when(rest > 0, F.slice(wanted, F.lit(1), rest - 1)).otherwise(wanted)
    each = F.transform(checked, lambda p, i: F.when(p == "+", i < F.size(there)).otherwise(F.coalesce(F.get(there, i) == p, F.lit(False))))
    return F.forall(each, lambda ok: ok) & ((rest > 0) | (F.size(wanted) == F.size(there)))


def glob_matches(pattern: Column, text: Column) -> Column:
    quoted = F.regexp_replace(pattern, r"([.\\^$|+()\[\]{}])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$")))
