"""Channel, statistics and maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import channels as ch
from lodestone.operators import maintenance as mt
from lodestone.operators import stats as st
from lodestone.plans.registry import query
from lodestone.plans.scalar_queries import _NORM, _PATTERN
from lodestone.plans.views import sql, view
from lodestone.session import table
from lodestone.storage import written

_EP = f"""+ ep AS (SELECT *, {_NORM} AS name, {_PATTERN} AS is_pattern FROM endpoints), p AS (SELECT * FROM ep WHERE resolved AND role = 'producer'), c AS (SELECT * FROM ep WHERE resolved AND role = 'consumer'),
pn AS (SELECT DISTINCT protocol, name, is_pattern FROM p), cn AS (SELECT DISTINCT protocol, name, is_pattern FROM c),
m AS (SELECT protocol, pn.name AS p_name, cn.name AS c_name FROM pn JOIN cn USING (protocol) WHERE CASE WHEN protocol = 'http' THEN len(string_split(pn.name, '/')) = len(string_split(cn.name, '/'))
AND list_bool_and(list_transform(list_zip(string_split(pn.name, '/'), string_split(cn.name, '/')), lambda z: z[1] = z[2] OR z[1] = '{{}}' OR z[2] = '{{}}'))
WHEN cn.is_pattern THEN NOT pn.is_pattern AND regexp_matches(pn.name, '^' || replace(cn.name, '+', '[^/]*') || '$') ELSE pn.name = cn.name END),
l AS (SELECT p.repository_id AS p_repository_id, p.file_path AS p_file_path, c.repository_id AS c_repository_id, c.file_path AS c_file_path, c_name AS channel, min(m.protocol) AS protocol,
count(DISTINCT p.id) * count(DISTINCT c.id) AS weight, round(least(max(p.confidence), max(c.confidence)), 6) AS confidence FROM m JOIN p ON p.protocol = m.protocol AND p.name = m.p_name JOIN c ON c.protocol = m.protocol AND c.name = m.c_name GROUP BY ALL)"""
EDGE = ("p_repository_id", "p_file_path", "c_repository_id", "c_file_path", "channel", "protocol", "weight", "confidence")


def endpoints(spark, sf_dir):
    return ch.normalized(view(spark, sf_dir, "endpoints"))


@query("ch_link", sql(f"{_EP} SELECT {', '.join(EDGE)} FROM l WHERE confidence >= 0.7", "endpoints"))
def ch_link(spark, sf_dir):
    return ch.link(endpoints(spark, sf_dir), 0.7).select(*EDGE)


@query("ch_noisy", sql(f"{_EP} SELECT protocol, channel, count(*) AS edges FROM l GROUP BY ALL HAVING count(*) > 20", "endpoints"))
def ch_noisy(spark, sf_dir):
    return ch.noisy(ch.link(endpoints(spark, sf_dir)))


@query("ch_unmatched", sql(f"{_EP} SELECT id, role FROM ep WHERE NOT resolved OR (role = 'producer' AND (protocol, name) NOT IN (SELECT protocol, p_name FROM m)) OR (role = 'consumer' AND (protocol, name) NOT IN (SELECT protocol, c_name FROM m))", "endpoints"))
def ch_unmatched(spark, sf_dir):
    return ch.unmatched(endpoints(spark, sf_dir))


@query("ch_read", sql(f"{_EP} SELECT id, protocol, name AS channel_normalized FROM ep WHERE protocol = 'kafka' AND NOT starts_with(file_path, 'tests/') AND NOT (name GLOB 'topic.1*')", "endpoints"))
def ch_read(spark, sf_dir):
    return ch.filtered(endpoints(spark, sf_dir), "kafka", False, ["topic.1*"]).select("id", "protocol", "channel_normalized")


_PACKAGED = "+ pk AS (SELECT id, repository_id, 'src/s' || (CAST(reference_line AS INT) % 37) || '.js' AS caller_file_path, reference_line * 7 + reference_column AS reference_line, callee_symbol, CASE reference_column % 3 WHEN 0 THEN 'axios' WHEN 1 THEN 'kafkajs' ELSE 'mqtt' END AS callee_package FROM refs)"


def _packaged(spark, sf_dir):
    """The references as if packages' functions were called in the endpoints' files."""
    return view(spark, sf_dir, "refs", distinct=False).selectExpr(
        "id", "repository_id", "concat('src/s', reference_line % 37, '.js') AS caller_file_path", "CAST(reference_line * 7 + reference_column AS INT) AS reference_line",
        "concat(CASE WHEN reference_line % 2 = 0 THEN 'send' ELSE 'subscribe' END, callee_symbol) AS callee_symbol", "CASE reference_column % 3 WHEN 0 THEN 'axios' WHEN 1 THEN 'kafkajs' ELSE 'mqtt' END AS callee_package",
    )


_PROTO = "CASE callee_package WHEN 'axios' THEN 'http' WHEN 'kafkajs' THEN 'kafka' ELSE 'mqtt' END"


@query("ch_confirm", sql(f"{_PACKAGED}, f AS (SELECT e.id, arg_min(callee_package, (abs(line - reference_line), reference_line, callee_package)) AS library FROM endpoints e JOIN pk ON pk.repository_id = e.repository_id AND caller_file_path = file_path AND {_PROTO} = protocol AND abs(line - reference_line) <= 2 GROUP BY e.id) SELECT e.id, library, library IS NOT NULL AS confirmed, CASE WHEN library IS NULL THEN confidence ELSE 0.9::DOUBLE END AS confidence FROM endpoints e LEFT JOIN f USING (id)", "refs", "endpoints"))
def ch_confirm(spark, sf_dir):
    return ch.confirm(view(spark, sf_dir, "endpoints"), _packaged(spark, sf_dir)).select("id", "library", "confirmed", "confidence")


@query("ch_synth", sql(f"{_PACKAGED}, r AS (SELECT *, CASE WHEN id IN (SELECT id FROM refs WHERE reference_line % 2 = 0) THEN 'producer' ELSE 'consumer' END AS role FROM pk), t AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM endpoints e WHERE e.repository_id = r.repository_id AND e.file_path = r.caller_file_path AND e.role = r.role AND abs(e.line - r.reference_line) <= 2)) SELECT repository_id, caller_file_path AS file_path, CAST(reference_line AS INT) AS line, role, min(id) AS id FROM t GROUP BY ALL", "refs", "endpoints"))
def ch_synth(spark, sf_dir):
    return ch.synthesize(view(spark, sf_dir, "endpoints"), _packaged(spark, sf_dir)).select("repository_id", "file_path", "line", "role", "id")


@query("ch_prefix", sql("SELECT id, CASE WHEN protocol = 'http' AND repository_id = 'r1' THEN '/v1' || channel_raw ELSE channel_raw END AS channel_raw FROM endpoints", "endpoints"))
def ch_prefix(spark, sf_dir):
    own = view(spark, sf_dir, "endpoints")
    mounts = own.where("repository_id = 'r1'").select("repository_id", "file_path", F.lit("/v1/").alias("prefix")).distinct()
    return ch.prefixed(own, mounts).select("id", "channel_raw")


@query("ch_loop", sql("SELECT id || '#' || i AS id, replace(channel_raw || '/{}', '{}', i) AS channel_raw FROM endpoints, (SELECT unnest(['a', 'b']) AS i) WHERE protocol = 'http' UNION ALL SELECT id, channel_raw || '/{}' FROM endpoints WHERE protocol <> 'http'", "endpoints"))
def ch_loop(spark, sf_dir):
    own = view(spark, sf_dir, "endpoints").withColumn("channel_raw", F.concat("channel_raw", F.lit("/{}")))
    loops = own.where("protocol = 'http'").select("id", F.array(F.lit("a"), F.lit("b")).alias("items"))
    return ch.looped(own, loops).select("id", "channel_raw")


@query("ch_pattern", sql("SELECT id, channel_raw || '/+' AS pattern FROM endpoints", "endpoints"))
def ch_pattern(spark, sf_dir):
    return view(spark, sf_dir, "endpoints").select("id", ch.template_pattern(F.concat("channel_raw", F.lit("/${user.id}"))).alias("pattern"))


# statistics


@query("cg_stats", sql("SELECT count(*) AS total, count(DISTINCT caller_symbol) AS callers, count(DISTINCT callee_symbol) AS callees FROM refs", "refs"))
def cg_stats(spark, sf_dir):
    return st.graph_totals(view(spark, sf_dir, "refs"))


@query("cg_stats_languages", sql("SELECT language, count(*) AS n FROM refs GROUP BY ALL", "refs"))
def cg_stats_languages(spark, sf_dir):
    return st.language_totals(view(spark, sf_dir, "refs"))


@query("cg_stats_kinds", sql("SELECT reference_kind, count(*) AS n FROM refs GROUP BY ALL", "refs"))
def cg_stats_kinds(spark, sf_dir):
    return st.counts_by(view(spark, sf_dir, "refs"), "reference_kind")


@query("proto_counts", sql("SELECT protocol, count(*) AS n FROM endpoints GROUP BY ALL", "endpoints"))
def proto_counts(spark, sf_dir):
    return st.counts_by(view(spark, sf_dir, "endpoints"), "protocol")


_STATS = """SELECT coalesce(c.k, r.k, e.k) AS repository_id, coalesce(files, 0) AS files, coalesce(chunks, 0) AS chunks, coalesce(languages, 0) AS languages, coalesce(refs_n, 0) AS "references", coalesce(endpoints_n, 0) AS endpoints
FROM (SELECT repository_id AS k, count(DISTINCT file_path) AS files, count(*) AS chunks, count(DISTINCT language) AS languages FROM chunks GROUP BY ROLLUP (repository_id)) c
FULL JOIN (SELECT repository_id AS k, count(*) AS refs_n FROM refs GROUP BY ROLLUP (repository_id)) r ON c.k IS NOT DISTINCT FROM r.k
FULL JOIN (SELECT repository_id AS k, count(*) AS endpoints_n FROM endpoints GROUP BY ROLLUP (repository_id)) e ON coalesce(c.k, r.k) IS NOT DISTINCT FROM e.k"""


@query("stats", sql(_STATS, "chunks", "refs", "endpoints"))
def stats(spark, sf_dir):
    return st.repository_stats(view(spark, sf_dir, "chunks"), view(spark, sf_dir, "refs"), endpoints(spark, sf_dir))


@query("language_shares", sql("SELECT repository_id, language, count(DISTINCT file_path) AS files, count(*) AS chunks FROM chunks GROUP BY ALL", "chunks"))
def language_shares(spark, sf_dir):
    return st.language_shares(view(spark, sf_dir, "chunks"))


_SECTIONS = """SELECT * FROM (SELECT 'statistics' AS section, (SELECT count(*) FROM (SELECT repository_id FROM chunks UNION SELECT repository_id FROM refs UNION SELECT repository_id FROM endpoints)) + 1 AS n
UNION ALL SELECT 'languages', (SELECT count(*) FROM (SELECT DISTINCT repository_id, language FROM chunks)) UNION ALL SELECT 'call_graph', 1
UNION ALL SELECT 'features', (SELECT least(count(DISTINCT caller_symbol), 10) FROM refs WHERE reference_kind IN ('call', 'method_call', 'instantiation', 'macro_invocation') AND caller_symbol NOT IN (SELECT callee_symbol FROM refs WHERE reference_kind IN ('call', 'method_call', 'instantiation', 'macro_invocation') AND caller_symbol IS NOT NULL))
UNION ALL SELECT 'dependencies', (SELECT least(count(*), 10) FROM (SELECT DISTINCT caller_file_path, repository_id, reference_file_path FROM refs WHERE reference_file_path <> caller_file_path)) UNION ALL SELECT 'channels', 10), (SELECT CAST(NULL AS VARCHAR) AS note)"""


@query("overview", sql(_SECTIONS, "chunks", "refs", "endpoints"))
def overview(spark, sf_dir):
    return st.overview_report(st.overview(view(spark, sf_dir, "chunks"), written(view(spark, sf_dir, "refs"), "refs"), endpoints(spark, sf_dir)))


@query("repo_list", sql("SELECT id, name, namespace FROM repositories", "repositories"))
def repo_list(spark, sf_dir):
    return view(spark, sf_dir, "repositories")


@query("repo_get", sql("SELECT id, name FROM repositories WHERE name = 'europe'", "repositories"))
def repo_get(spark, sf_dir):
    """By id, else by name whatever its case."""
    own = view(spark, sf_dir, "repositories").where((F.col("id") == "Europe") | (F.lower("name") == "europe"))
    return own.orderBy(F.desc(F.col("id") == "Europe"), "id").limit(1).select("id", "name")


@query("ns_repos", sql("SELECT namespace, array_to_string(list_sort(list(id)), ',') AS ids FROM repositories GROUP BY ALL", "repositories"))
def ns_repos(spark, sf_dir):
    return view(spark, sf_dir, "repositories").groupBy("namespace").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


# changes between snapshots

_SNAP = "+ b AS (SELECT repository_id, file_path, sha256(content) AS h FROM chunks WHERE substr(id, 2)::INT % 10 <> 0), a AS (SELECT repository_id, file_path, CASE WHEN substr(id, 2)::INT % 11 = 0 THEN NULL ELSE sha256(content || CASE WHEN substr(id, 2)::INT % 7 = 0 THEN '!' ELSE '' END) END AS h FROM chunks WHERE substr(id, 2)::INT % 9 <> 0)"
_CHANGE = "CASE WHEN a.file_path IS NULL THEN 'deleted' WHEN b.file_path IS NULL THEN CASE WHEN a.h IS NULL THEN 'unreadable' ELSE 'added' END WHEN a.h IS NULL THEN 'retained' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END"


def _snapshots(spark, sf_dir):
    """Two snapshots of the documents: some files come, some go, some change, some can't be read."""
    n = F.substring("id", 2, 20).cast("long")
    own = view(spark, sf_dir, "chunks").withColumn("n", n)
    key = ["repository_id", "file_path"]
    before = own.where("n % 10 <> 0").select(*key, F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    text = F.concat("content", F.when(F.col("n") % 7 == 0, "!").otherwise(""))
    after = own.where("n % 9 <> 0").select(*key, F.when(F.col("n") % 11 != 0, F.sha2(text.cast("binary"), 256)).alias("content_hash"))
    return own, before, after


@query("inc_diff", sql(f"{_SNAP} SELECT repository_id, file_path, {_CHANGE} AS change FROM b FULL JOIN a USING (repository_id, file_path)", "chunks"))
def inc_diff(spark, sf_dir):
    _, before, after = _snapshots(spark, sf_dir)
    return st.snapshot_diff(before, after)


@query("inc_apply", sql(f"{_SNAP}, d AS (SELECT repository_id, file_path, {_CHANGE} AS change FROM b FULL JOIN a USING (repository_id, file_path)) SELECT id, content FROM chunks JOIN d USING (repository_id, file_path) WHERE change IN ('unchanged', 'retained') UNION ALL SELECT id, content || '!' FROM chunks JOIN d USING (repository_id, file_path) WHERE change IN ('added', 'modified')", "chunks"))
def inc_apply(spark, sf_dir):
    own, before, after = _snapshots(spark, sf_dir)
    diff = st.snapshot_diff(before, after)
    parsed = own.withColumn("content", F.concat("content", F.lit("!"))).join(diff.where("change in ('added', 'modified')"), ["repository_id", "file_path"], "left_semi")
    known = own.join(before, ["repository_id", "file_path"], "left_semi")
    return st.apply_diff(known, diff, parsed).select("id", "content")


# maintenance


def _upsert(name: str, source: str, key: str, column: str, new: str):
    """Rows whose key has an even length come again with another value."""

    @query(name, sql(f"SELECT {key}, CASE WHEN length({key}) % 2 = 0 THEN {new} ELSE {column} END AS {column} FROM {source}", source))
    def run(spark, sf_dir):
        old = view(spark, sf_dir, source).select(key, column)
        return mt.upsert(old, old.where(f"length({key}) % 2 = 0").withColumn(column, F.expr(new)), [key])


_upsert("upsert_chunks", "chunks", "id", "content", "concat(content, '!')")
_upsert("upsert_refs", "refs", "id", "language", "concat(language, '2')")
_upsert("upsert_endpoints", "endpoints", "id", "channel_raw", "concat(channel_raw, '!')")
_upsert("upsert_hashes", "chunks", "file_path", "symbol_name", "'x'")
_upsert("repos", "repositories", "id", "name", "upper(name)")


_DIFF = f"{_SNAP}, d AS (SELECT repository_id, file_path, {_CHANGE} AS change FROM b FULL JOIN a USING (repository_id, file_path))"


@query("inc_counts", sql(f"{_DIFF}, g AS (SELECT repository_id, count(*) AS n FROM chunks JOIN d USING (repository_id, file_path) WHERE change IN ('modified', 'deleted', 'added') GROUP BY ALL), w AS (SELECT repository_id, count(*) AS n FROM chunks JOIN d USING (repository_id, file_path) WHERE change IN ('added', 'modified') GROUP BY ALL) SELECT repository_id, greatest(5 - coalesce(g.n, 0), 0) + coalesce(w.n, 0) AS n FROM (SELECT DISTINCT repository_id FROM chunks) LEFT JOIN g USING (repository_id) LEFT JOIN w USING (repository_id)", "chunks"))
def inc_counts(spark, sf_dir):
    own, before, after = _snapshots(spark, sf_dir)
    diff = st.snapshot_diff(before, after)
    new = own.join(diff.where("change in ('added', 'modified')"), ["repository_id", "file_path"], "left_semi")
    return st.chunk_counts(own.select("repository_id", F.lit(5).cast("long").alias("n")).distinct(), own, diff, new)


_RDIFF = "+ d AS (SELECT DISTINCT repository_id, caller_file_path, CASE ascii(substr(caller_file_path, 11, 1)) % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' ELSE 'retained' END AS change FROM refs)"


@query("inc_references", sql(f"{_RDIFF} SELECT id, reference_line FROM refs JOIN d USING (repository_id, caller_file_path) WHERE change IN ('unchanged', 'retained') AND NOT contains(caller_file_path, 'pkg3') UNION ALL SELECT id, reference_line + 100 FROM refs JOIN d USING (repository_id, caller_file_path) WHERE change <> 'deleted' AND contains(caller_file_path, 'pkg3')", "refs"))
def inc_references(spark, sf_dir):
    """Files of one package are imported anew, whether they changed or not."""
    own = view(spark, sf_dir, "refs")
    kind = F.element_at(F.array(F.lit("unchanged"), F.lit("modified"), F.lit("deleted"), F.lit("retained")), F.ascii(F.substring("caller_file_path", 11, 1)) % 4 + 1)
    diff = own.select("repository_id", F.col("caller_file_path").alias("file_path"), kind.alias("change")).distinct()
    again = own.where(F.contains("caller_file_path", F.lit("pkg3"))).withColumn("reference_line", F.col("reference_line") + 100)
    return st.apply_references(own, diff, again).select("id", "reference_line")


@query("inc_stale", sql(f"{_RDIFF}, c AS (SELECT DISTINCT repository_id FROM d WHERE change IN ('modified', 'deleted') AND repository_id <> 'r4') SELECT repository_id FROM c UNION SELECT '__namespace__:' || namespace FROM repositories WHERE id IN (SELECT repository_id FROM c)", "refs", "repositories"))
def inc_stale(spark, sf_dir):
    own = view(spark, sf_dir, "refs").where("repository_id <> 'r4'")
    kind = F.element_at(F.array(F.lit("unchanged"), F.lit("modified"), F.lit("deleted"), F.lit("retained")), F.ascii(F.substring("caller_file_path", 11, 1)) % 4 + 1)
    diff = own.select("repository_id", F.col("caller_file_path").alias("file_path"), kind.alias("change")).distinct()
    return st.stale_analyses(diff, view(spark, sf_dir, "repositories"))


@query("del_cascade", sql("SELECT v.chunk_id FROM vectors v WHERE v.chunk_id NOT IN (SELECT id FROM chunks WHERE repository_id = 'src1' OR file_path LIKE 'src2/tests/%')", "chunks", "vectors"))
def del_cascade(spark, sf_dir):
    chunks, vectors = view(spark, sf_dir, "chunks"), view(spark, sf_dir, "vectors")
    files = chunks.where("file_path like 'src2/tests/%'").select("repository_id", "file_path").union(spark.sql("SELECT 'src1', CAST(NULL AS STRING)"))
    return mt.delete_files(chunks, vectors, files)[1].select("chunk_id")


@query("del_repo", sql("SELECT id FROM refs WHERE repository_id <> 'r1'", "refs"))
def del_repo(spark, sf_dir):
    return mt.delete_repository({"symbol_references": view(spark, sf_dir, "refs")}, "r1", "core")["symbol_references"].select("id")


@query("del_synth", sql("SELECT id FROM endpoints WHERE line % 3 <> 0", "endpoints"))
def del_synth(spark, sf_dir):
    own = view(spark, sf_dir, "endpoints").withColumn("source", F.when(F.col("line") % 3 == 0, "package"))
    return mt.delete_synthesized(own).select("id")


@query("ns_admin", "SELECT * FROM (VALUES ('a', 'none'), ('b', 'm')) t(name, model)")
def ns_admin(spark, sf_dir):
    from uuid import uuid4

    from lodestone.storage import shared_dir

    names = mt.Namespaces(spark, f"{shared_dir(spark)}/namespaces-{uuid4().hex}")
    for name, model in (("a", "none"), ("b", "m"), ("c", "m")):
        names.create(name, model, 64)
    names.drop("c")
    return spark.createDataFrame([(n, {"a": "none", "b": "m"}[n]) for n in names.names()], "name string, model string")


@query("analysis_store", sql("SELECT repository_id, count(*) AS n FROM refs GROUP BY ALL", "refs"))
def analysis_store(spark, sf_dir):
    from uuid import uuid4

    from lodestone.storage import shared_dir

    store = mt.AnalysisStore(spark, f"{shared_dir(spark)}/analyses-{uuid4().hex}")
    store.save("all", "counts", view(spark, sf_dir, "refs").groupBy("repository_id").agg(F.count("*").alias("n")))
    return store.load("all", "counts")


@query("out_formats", sql("SELECT file_path || ':' || start_line || ':1:' || split_part(content, chr(10), 1) AS line FROM chunks", "chunks"))
def out_formats(spark, sf_dir):
    return mt.vimgrep(view(spark, sf_dir, "chunks"))


@query("out_json")
def out_json(spark, sf_dir):
    return mt.as_json(view(spark, sf_dir, "repositories"))


@query("file_hashes", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def file_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
