"""Producers and consumers of channels: linking, reports, confirmation and synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.channels import glob_matches, normalize_channel, route_matches, segments, topic_matches
from lodestone.functions.paths import is_test_path
from lodestone.storage import written

NOISY = 20
WINDOW = 2
CONFIRMED, PACKAGE_DRIVEN = 0.9, 0.6

# Packages and the protocols that they speak.
PACKAGES = {
    "kafkajs": "kafka",
    "kafka-node": "kafka",
    "node-rdkafka": "kafka",
    "kafka-python": "kafka",
    "mqtt": "mqtt",
    "paho-mqtt": "mqtt",
    "axios": "http",
    "node-fetch": "http",
    "express": "http",
    "requests": "http",
    "httpx": "http",
    "flask": "http",
    "fastapi": "http",
    "axum": "http",
    "reqwest": "http",
    "amqplib": "amqp",
}


def normalized(endpoints: DataFrame) -> DataFrame:
    """Endpoints with host, channel_normalized and is_pattern."""
    out = endpoints.withColumn("_n", normalize_channel(F.col("protocol"), F.col("channel_raw")))
    return out.select(*endpoints.columns, F.col("_n.host").alias("host"), F.col("_n.name").alias("channel_normalized"), F.col("_n.is_pattern").alias("is_pattern"))


def filtered(endpoints: DataFrame, protocol: str | None = None, tests: bool = True, excluded: list[str] | None = None) -> DataFrame:
    if protocol is not None:
        endpoints = endpoints.where(F.col("protocol") == protocol)
    if not tests:
        endpoints = endpoints.where(~is_test_path(F.col("file_path")))
    for glob in excluded or []:
        endpoints = endpoints.where(~glob_matches(F.lit(glob), F.col("channel_normalized")))
    return endpoints


_SITE = ("id", "repository_id", "file_path", "line", "enclosing_symbol", "protocol", "channel_normalized", "is_pattern", "confidence")


def _sides(endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = endpoints.where("resolved").select(*_SITE, "role")
    side = lambda role, p: own.where(F.col("role") == role).select(*(F.col(c).alias(f"{p}_{c}") for c in _SITE))
    return side("producer", "p"), side("consumer", "c")


def distinct_channels(endpoints: DataFrame) -> DataFrame:
    """(producer_channel, consumer_channel, protocol) that match, over distinct channel names.

    HTTP names of as many segments meet on their first two segments, whether
    fixed or parameters; patterns of other protocols meet topics by the first
    one. So names meet names, never sites sites.
    """
    own = endpoints.where("resolved").select("protocol", "role", F.col("channel_normalized").alias("name"), "is_pattern").distinct()
    own = written(own, "channels")  # read by each of the joins below
    p, c = own.where("role = 'producer'"), own.where("role = 'consumer'")
    left = lambda df: df.select("protocol", F.col("name").alias("p_name"), F.col("is_pattern").alias("p_pattern"))
    right = lambda df: df.select("protocol", F.col("name").alias("c_name"), F.col("is_pattern").alias("c_pattern"))

    same = left(p.where("protocol <> 'http'")).withColumn("name", F.col("p_name")).join(right(c.where("protocol <> 'http' and not is_pattern")).withColumn("name", F.col("c_name")), ["protocol", "name"])

    # Routes: as many segments, and first and second ones that agree or of which one is a parameter. A producer goes by
    # its own segment and by ANY; a consumer by its own and by the parameter, or by ANY alone where it is one itself: each
    # pair meets once.
    at = lambda c, i: F.coalesce(F.get(segments(F.col(c)), F.lit(i)), F.lit(""))
    any_, wild_ = F.lit("\0any"), F.lit("{}")
    of_p = lambda i: F.explode(F.array(at("p_name", i), any_)).alias(f"k{i}")
    of_c = lambda i: F.explode(F.when(at("c_name", i) == wild_, F.array(any_)).otherwise(F.array(at("c_name", i), wild_))).alias(f"k{i}")
    routes_p, routes_c = left(p.where("protocol = 'http'")), right(c.where("protocol = 'http'"))
    routes_p = routes_p.select("*", F.size(segments(F.col("p_name"))).alias("n"), of_p(0)).select("*", of_p(1))
    routes_c = routes_c.select("*", F.size(segments(F.col("c_name"))).alias("n"), of_c(0)).select("*", of_c(1))
    names = ["protocol", "p_name", "c_name"]
    routes = routes_p.join(routes_c, ["protocol", "n", "k0", "k1"]).select(names).where(route_matches(F.col("p_name"), F.col("c_name")))

    # patterns against topics, by the first segment where the pattern fixes it
    first = lambda c: F.get(F.split(F.col(c), "/"), F.lit(0))
    wild = right(c.where("protocol <> 'http' and is_pattern"))
    topics = left(p.where("protocol <> 'http' and not is_pattern"))
    by_head = topics.withColumn("k", first("p_name")).join(wild.withColumn("k", first("c_name")), ["protocol", "k"])
    by_none = topics.join(wild.where(first("c_name").isin("+", "#")), "protocol")
    patterns = by_head.select(names).unionByName(by_none.select(names)).distinct().where(topic_matches(F.col("c_name"), F.col("p_name")))
    return same.select(names).unionByName(routes).unionByName(patterns).distinct()


def pairs(endpoints: DataFrame) -> DataFrame:
    """(file pair, consumer's channel, protocol): collapsed from matching sites, which are never enumerated.

    Sites are gathered by file and channel name first, and a producer's file's
    channels by the consumer's channel that they match, so each row is made once
    and needs no grouping; ``only``: no other protocol has a channel of this name.
    """
    endpoints = written(endpoints.where("resolved").select(*_SITE, "role", "resolved"), "endpoints")  # names are normalised once
    p, c = _sides(endpoints)
    best = lambda x: F.max_by(F.struct(F.col(f"{x}_line").alias("line"), F.col(f"{x}_enclosing_symbol").alias("symbol"), F.col(f"{x}_confidence").alias("confidence")), F.struct(f"{x}_confidence", -F.col(f"{x}_line"), f"{x}_id"))
    at = lambda x: (f"{x}_repository_id", f"{x}_file_path", f"{x}_protocol", f"{x}_channel_normalized")
    sites = lambda df, x: df.groupBy(*at(x)).agg(F.count_distinct(f"{x}_id").alias(f"{x}_n"), best(x).alias(f"{x}_best"))
    names = distinct_channels(endpoints)
    only = names.groupBy("c_name").agg((F.count_distinct("protocol") == 1).alias("only"))
    out = sites(p, "p").withColumnsRenamed({"p_protocol": "protocol", "p_channel_normalized": "p_name"}).join(names, ["protocol", "p_name"])
    out = out.groupBy("p_repository_id", "p_file_path", "protocol", "c_name").agg(F.sum("p_n").alias("p_n"), _best("p"))
    out = written(out.join(only, "c_name"), "producers")
    consumers = sites(c, "c").withColumnsRenamed({"c_protocol": "protocol", "c_channel_normalized": "c_name"})
    return out.join(written(consumers, "consumers"), ["protocol", "c_name"])


def _best(x: str):
    return F.max_by(f"{x}_best", F.struct(f"{x}_best.confidence", -F.col(f"{x}_best.line"))).alias(f"{x}_best")


def link(endpoints: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Edges from producer files to consumer files by the consumer's channel: weight, confidence and best sites.

    The key has no protocol: equal names of two protocols between two files are
    one edge. Only such names are grouped.
    """
    keys = ["p_repository_id", "p_file_path", "c_repository_id", "c_file_path", "channel"]
    each = pairs(endpoints).withColumnRenamed("c_name", "channel")
    single = each.where("only").select(*keys, "protocol", (F.col("p_n") * F.col("c_n")).alias("weight"), "p_best", "c_best")
    several = each.where("not only").groupBy(*keys).agg(F.min("protocol").alias("protocol"), (F.sum("p_n") * F.sum("c_n")).alias("weight"), _best("p"), _best("c"))
    out = single.unionByName(several).withColumn("confidence", F.round(F.least("p_best.confidence", "c_best.confidence"), 6))
    return out.where(F.col("confidence") >= min_confidence)


def noisy(edges: DataFrame, most: int = NOISY) -> DataFrame:
    return edges.groupBy("protocol", "channel").agg(F.count("*").alias("edges")).where(F.col("edges") > most)


def unmatched(endpoints: DataFrame) -> DataFrame:
    """Endpoints in no pair, whatever their confidence; unresolved ones are never in one."""
    names = distinct_channels(endpoints)
    met = names.select("protocol", F.lit("producer").alias("role"), F.col("p_name").alias("channel_normalized")).union(names.select("protocol", F.lit("consumer"), "c_name")).distinct()
    resolved = endpoints.where("resolved").join(met, ["protocol", "role", "channel_normalized"], "left_anti")
    return resolved.select("id", "role").unionByName(endpoints.where("not resolved").select("id", "role"))


def packaged(references: DataFrame) -> DataFrame:
    """References whose package speaks a protocol."""
    pairs_ = [x for kv in PACKAGES.items() for x in map(F.lit, kv)]
    return references.withColumn("protocol", F.try_element_at(F.create_map(*pairs_), F.col("callee_package"))).where("protocol is not null")


def _near(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Interval join of ``line`` and ``reference_line`` within WINDOW lines, by buckets of lines."""
    step = 2 * WINDOW + 1
    a = left.withColumn("_b", F.floor(F.col("line") / step))
    b = right.withColumn("_b", F.explode(F.array(F.floor((F.col("reference_line") - WINDOW) / step), F.floor((F.col("reference_line") + WINDOW) / step)))).distinct()
    return a.join(b, [*keys, "_b"]).where(F.abs(F.col("line") - F.col("reference_line")) <= WINDOW).drop("_b")


def confirm(endpoints: DataFrame, references: DataFrame) -> DataFrame:
    """Endpoints with confirmed and library: a reference of the same protocol's package within two lines; the nearest wins."""
    sites = packaged(references).select("repository_id", F.col("caller_file_path").alias("file_path"), "protocol", "reference_line", "callee_package")
    near = _near(endpoints.select("id", "repository_id", "file_path", "protocol", "line"), sites, ["repository_id", "file_path", "protocol"])
    library = F.min_by("callee_package", F.struct(F.abs(F.col("line") - F.col("reference_line")), "reference_line", "callee_package"))
    found = near.groupBy("id").agg(library.alias("library"))
    out = endpoints.drop("library", "confirmed").join(found, "id", "left").withColumn("confirmed", F.col("library").isNotNull())
    return out.withColumn("confidence", F.when(F.col("confirmed"), F.lit(CONFIRMED)).otherwise(F.col("confidence")))


def synthesize(endpoints: DataFrame, references: DataFrame) -> DataFrame:
    """Endpoints that only a package's call shows: one for each file, line and role without an endpoint of that role within two lines.

    Whether a site is taken depends on its file, line and role alone, so calls
    are collapsed to sites, and endpoints to the lines around them, before they meet.
    """
    name = F.lower("callee_symbol")
    role = F.when(name.rlike("subscribe|consume|listen|onmessage|route|app\\.(?:get|post|put|delete)"), "consumer").when(name.rlike("publish|send|produce|emit|get|post|put|delete|patch|fetch|request"), "producer")
    found = packaged(references).withColumn("role", role).where("role is not null")
    site = ["repository_id", "file_path", "line", "role"]
    found = found.groupBy("repository_id", F.col("caller_file_path").alias("file_path"), F.col("reference_line").alias("line"), "role")
    found = found.agg(F.min_by(F.struct("protocol", F.col("callee_package").alias("library"), "id"), F.struct("id", "protocol", "callee_package")).alias("_first"))
    lines = endpoints.select("repository_id", "file_path", "role", "line").distinct()
    taken = lines.withColumn("line", F.explode(F.sequence(F.col("line") - WINDOW, F.col("line") + WINDOW))).distinct()
    out = found.join(taken, site, "left_anti").select("repository_id", "file_path", "line", "role", "_first.*")
    return out.withColumn("confidence", F.lit(PACKAGE_DRIVEN)).withColumn("resolved", F.lit(False))


def template_pattern(raw):
    """A template literal as a topic pattern: each ${...} is one segment."""
    return F.regexp_replace(raw, r"\$\{[^}]*\}", "+")


def prefixed(endpoints: DataFrame, mounts: DataFrame) -> DataFrame:
    """Routes with their router's mount prefix, once: ``mounts`` has repository_id, file_path and prefix."""
    out = endpoints.join(mounts, ["repository_id", "file_path"], "left")
    has = F.col("prefix").isNull() | (F.col("protocol") != "http") | F.startswith("channel_raw", F.col("prefix"))
    return out.withColumn("channel_raw", F.when(has, F.col("channel_raw")).otherwise(F.concat(F.regexp_replace("prefix", "/+$", ""), "channel_raw"))).drop("prefix")


def looped(endpoints: DataFrame, loops: DataFrame) -> DataFrame:
    """Routes that a loop registers: one endpoint for each item of its list (``loops``: id, items)."""
    own = endpoints.join(loops, "id", "left").withColumn("item", F.explode_outer("items"))
    new = F.when(F.col("item").isNotNull(), F.regexp_replace("channel_raw", r"\$\{[^}]*\}|\{\}", F.col("item"))).otherwise(F.col("channel_raw"))
    named = F.when(F.col("item").isNotNull(), F.concat("id", F.lit("#"), "item")).otherwise(F.col("id"))
    return own.withColumn("channel_raw", new).withColumn("id", named).drop("items", "item")
