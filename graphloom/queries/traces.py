"""Queries on spans, sessions and sources: what a stream would do, over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import store as ops
from graphloom.plans.store import load, sql
from graphloom.queries.store import _hex
from graphloom.registry import query
from graphloom.sources import ownership, traces
from graphloom.streaming import spans

# a span for each event: HTTP with a route of the user, rpc, messaging in and out, or bare
SPANS = """sp AS (SELECT 't' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS trace_id, 'svc' || (user_id % 9) AS service, CASE WHEN user_id % 4 = 0 THEN 'svc' || (user_id % 5) ELSE '' END AS peer, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id % 5 AS m, user_id,
 CASE event_id % 5 WHEN 0 THEN '/api/' || user_id WHEN 1 THEN 'Rpc' || (user_id % 3) || '.call' ELSE event_type END AS route, CASE event_id % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'rpc' ELSE 'unknown' END AS mapping,
 CASE event_id % 5 WHEN 0 THEN 'runtime_calls' WHEN 1 THEN 'runtime_rpc' WHEN 2 THEN 'runtime_produces' WHEN 3 THEN 'runtime_consumes' ELSE 'runtime_calls' END AS edge_type FROM events),
ro AS (SELECT service_name, route_pattern, mapping_type, min(node_hash) AS node_hash FROM routes GROUP BY ALL),
rs AS (SELECT sp.*, sha256(concat_ws(chr(0), 'node', service, '', service, 'service')) AS source_hash, CASE WHEN peer = '' THEN service ELSE peer END AS dest FROM sp),
rr AS (SELECT rs.*, coalesce(node_hash, sha256(concat_ws(chr(0), 'node', dest, 'UNRESOLVED', route, 'runtime_endpoint'))) AS target_hash, CASE WHEN node_hash IS NULL THEN 0.3e0 ELSE 1e0 END AS sure FROM rs LEFT JOIN ro ON service_name = dest AND route_pattern = route AND mapping_type = mapping)"""
EDGE = "sha256(concat_ws(chr(0), 'edge', source_hash, target_hash, edge_type, 'otel_trace'))"
COUNT = "CASE WHEN n > 1000 THEN 0.95e0 WHEN n >= 100 THEN 0.85e0 WHEN n >= 10 THEN 0.7e0 ELSE 0.5e0 END"
OBS = f"ob AS (SELECT {EDGE} AS edge_hash, source_hash, target_hash, edge_type, count(*) AS n, max(sec) AS last_observed, min(sure) AS sure, min(ROW(sec, trace_id))[2] AS trace FROM rr GROUP BY ALL), oe AS (SELECT edge_hash, CASE WHEN n = 1 THEN least({COUNT}, sure) ELSE {COUNT} END AS confidence, 'otel_trace:{{\"trace_ids\":[\"' || trace || '\"]}}' AS provenance, n AS observation_count, last_observed FROM ob)"


def _spans(spark, d, where: str = "true"):
    e = spark.read.parquet(f"{d}/events.parquet").filter(where)
    m = F.col("event_id") % 5
    attrs = (
        F.when(m == 0, F.create_map(F.lit("http.method"), F.lit("GET"), F.lit("http.route"), F.concat(F.lit("/api/"), F.col("user_id").cast("string"))))
        .when(m == 1, F.create_map(F.lit("rpc.service"), F.concat(F.lit("Rpc"), (F.col("user_id") % 3).cast("string")), F.lit("rpc.method"), F.lit("call")))
        .when(m == 2, F.create_map(F.lit("messaging.system"), F.lit("kafka"), F.lit("messaging.destination"), F.lit("q")))
        .when(m == 3, F.create_map(F.lit("messaging.system"), F.lit("kafka")))
        .otherwise(F.create_map(F.lit("x"), F.lit("y")))
    )
    service = lambda n: F.concat(F.lit("svc"), (F.col("user_id") % n).cast("string"))
    return e.select(F.concat(F.lit("t"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("trace_id"), service(9).alias("service_name"), F.when(F.col("user_id") % 4 == 0, service(5)).otherwise("").alias("peer_service"), F.col("event_type").alias("operation_name"), attrs.alias("attributes"), F.col("ts").cast("timestamp").alias("start_time"), "event_id")


def _routes(spark, d):
    """Routes as spans name them: `GET /api/N` for HTTP ones."""
    r = load(spark, d, "routes").groupBy("service_name", "route_pattern", "mapping_type").agg(F.min("node_hash").alias("node_hash"))
    http = F.col("mapping_type") == "http"
    return r.select("service_name", F.when(http, F.concat(F.lit("GET "), "route_pattern")).otherwise(F.col("route_pattern")).alias("route_pattern"), F.when(http, "http_route").otherwise("grpc_method").alias("mapping_type"), "node_hash")


SPANS_GET = SPANS.replace("THEN '/api/' || user_id WHEN", "THEN 'GET /api/' || user_id WHEN").replace("SELECT service_name, route_pattern, mapping_type, min", "SELECT service_name, CASE WHEN mapping_type = 'http' THEN 'GET ' || route_pattern ELSE route_pattern END AS route_pattern, mapping_type, min").replace("GROUP BY ALL),\nrs", "GROUP BY service_name, route_pattern, mapping_type),\nrs")
SPANS_GET = SPANS_GET.replace("ro AS (SELECT service_name, CASE WHEN mapping_type = 'http' THEN 'GET ' || route_pattern ELSE route_pattern END AS route_pattern, mapping_type, min(node_hash) AS node_hash FROM routes GROUP BY service_name, route_pattern, mapping_type)", "ro AS (SELECT service_name, CASE WHEN mapping_type = 'http' THEN 'GET ' || route_pattern ELSE route_pattern END AS route_pattern, mapping_type, node_hash FROM (SELECT service_name, route_pattern, mapping_type, min(node_hash) AS node_hash FROM routes GROUP BY ALL))")


@query(f"WITH {sql('routes')}, {SPANS_GET} SELECT trace_id, source_hash, target_hash, edge_type, sure, {EDGE} AS edge_hash FROM rr")
def span_resolve(spark, d):
    return spans.resolve(_spans(spark, d), _routes(spark, d)).select("trace_id", "source_hash", "target_hash", "edge_type", "sure", "edge_hash")


@query(f"WITH {sql('routes')}, {SPANS_GET}, {OBS} SELECT * FROM oe")
def span_observe(spark, d):
    return spans.observe(spans.resolve(_spans(spark, d), _routes(spark, d))).select("edge_hash", "confidence", "provenance", "observation_count", "last_observed")


def _merged_sql(out: str) -> str:
    first, second = (OBS.replace("ob AS", f"ob{k} AS").replace("oe AS", f"oe{k} AS").replace("FROM ob)", f"FROM ob{k})").replace("FROM rr GROUP", f"FROM rr WHERE CAST(substr(trace_id, 2) AS BIGINT) % 3 {c} 0 GROUP") for k, c in ((1, ">"), (2, "=")))
    return f"WITH {sql('routes')}, {SPANS_GET}, {first}, {second}, {out}"


@query(_merged_sql(f"j AS (SELECT coalesce(a.edge_hash, b.edge_hash) AS edge_hash, coalesce(a.observation_count, 0) + coalesce(b.observation_count, 0) AS n, a.edge_hash IS NOT NULL AND b.edge_hash IS NOT NULL AS again, coalesce(a.confidence, b.confidence) AS c, coalesce(a.provenance, b.provenance) AS provenance, greatest(coalesce(a.last_observed, 0), coalesce(b.last_observed, 0)) AS last_observed FROM oe1 a FULL JOIN oe2 b ON a.edge_hash = b.edge_hash) SELECT edge_hash, CASE WHEN again THEN {COUNT} ELSE c END AS confidence, provenance, CAST(n AS BIGINT) AS observation_count, last_observed FROM j"))
def span_merge(spark, d):
    """Two batches: what the second adds to the edges of the first."""
    old, new = (spans.observe(spans.resolve(_spans(spark, d, w), _routes(spark, d))) for w in ("event_id % 3 > 0", "event_id % 3 = 0"))
    return spans.merge(old, new)[0].select("edge_hash", "confidence", "provenance", "observation_count", "last_observed")


@query(_merged_sql("z AS (SELECT 1) SELECT edge_hash, 'added' AS event_type, last_observed AS timestamp FROM oe2 WHERE edge_hash NOT IN (SELECT edge_hash FROM oe1)"))
def span_new_events(spark, d):
    old, new = (spans.observe(spans.resolve(_spans(spark, d, w), _routes(spark, d))) for w in ("event_id % 3 > 0", "event_id % 3 = 0"))
    return spans.merge(old, new)[1].select("edge_hash", "event_type", "timestamp")


@query("SELECT '' AS trace_id, 'svc' || (user_id % 9) AS service_name, 'GET /u/' || event_type AS operation_name, 'GET' AS method, '/u/' || event_type AS route, CAST(200 + event_id % 3 AS VARCHAR) AS status, CAST(value * 1000 AS BIGINT) AS duration_ns FROM events")
def http_log_spans(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    logs = e.select(F.col("ts").cast("timestamp").alias("timestamp"), F.lit("GET").alias("method"), F.concat(F.lit("/u/"), "event_type").alias("path"), (200 + F.col("event_id") % 3).cast("int").alias("status_code"), F.concat(F.lit("svc"), (F.col("user_id") % 9).cast("string")).alias("service_name"), F.lit("ip").alias("client_ip"), F.round(F.col("value") * 1000).cast("long").alias("duration_ns"))
    a = lambda k: F.element_at("attributes", k)
    return traces.spans_of_logs(logs).select("trace_id", "service_name", "operation_name", a("http.method").alias("method"), a("http.route").alias("route"), a("http.status_code").alias("status"), "duration_ns")


@query("SELECT lower(printf('%032X', event_id)) AS trace_id, 'svc' || (user_id % 9) AS service_name, event_type AS operation_name, CASE WHEN user_id % 4 = 0 THEN 'svc1' ELSE '' END AS peer_service, CAST(event_id AS VARCHAR) AS number, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, CAST(1000000 * (event_id % 7) AS BIGINT) AS duration_ns FROM events")
def otlp_flatten(spark, d):
    """Events as exported requests in JSON text, read back as a file of them would be."""
    e = spark.read.parquet(f"{d}/events.parquet")
    pair = lambda k, **v: F.struct(F.lit(k).alias("key"), F.struct(*(x.alias(n) for n, x in v.items())).alias("value"))
    begin = 1_700_000_000_000_000_000 + F.col("event_id") * 1000
    own = F.array(
        F.to_json(pair("number", intValue=F.col("event_id").cast("string"))), F.to_json(pair("flag", boolValue=F.col("event_id") % 2 == 0)),
        F.when(F.col("user_id") % 4 == 0, F.to_json(pair("peer.service", stringValue=F.lit("svc1")))),
    )
    service = F.to_json(pair("service.name", stringValue=F.concat(F.lit("svc"), (F.col("user_id") % 9).cast("string"))))
    text = F.concat(
        F.lit('{"resourceSpans":[{"resource":{"attributes":['), service, F.lit(']},"scopeSpans":[{"spans":[{"traceId":"'), F.lpad(F.hex("event_id"), 32, "0"), F.lit('","spanId":"AB","name":"'), F.col("event_type"),
        F.lit('","startTimeUnixNano":"'), begin.cast("string"), F.lit('","endTimeUnixNano":"'), (begin + 1_000_000 * (F.col("event_id") % 7)).cast("string"), F.lit('","attributes":['), F.concat_ws(",", own), F.lit("]}]}]}]}"),
    )
    requests = e.select(F.from_json(text, traces.OTLP).alias("r")).select("r.resourceSpans")
    a = lambda k: F.element_at("attributes", k)
    return traces.spans_of(requests).select("trace_id", "service_name", "operation_name", "peer_service", a("number").alias("number"), a("flag").alias("flag"), "duration_ns")


# ---------------------------------------------------------------- sessions


ACCESS = "ac AS (SELECT 's' || (user_id % 7) AS session_id, event_type || (user_id % 40) AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id AS id, (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) FROM events) AS now FROM events)"


def _accesses(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("session_id"), F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("symbol"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), "event_type")


@query(f"WITH {ACCESS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, symbol ORDER BY sec DESC, id DESC) AS k FROM ac) SELECT session_id, symbol, round(least(sum(exp(-0.6931471805599453e0 / 180 * (now - sec))), 2e0), 6) AS boost FROM r WHERE k <= 20 GROUP BY 1, 2 HAVING round(least(sum(exp(-0.6931471805599453e0 / 180 * (now - sec))), 2e0), 6) > 0.01")
def session_boost(spark, d):
    a = _accesses(spark, d)
    return spans.session_boosts(a, a.agg(F.max("at")).first()[0])


@query(f"WITH {ACCESS}, e AS (SELECT *, string_split(symbol, '0')[1] AS x FROM ac), a AS (SELECT DISTINCT session_id, symbol, sec FROM ac WHERE id % 3 = 0), b AS (SELECT DISTINCT session_id, symbol, sec FROM ac WHERE id % 3 > 0) SELECT session_id, symbol, sec AS at, CAST(EXISTS (SELECT 1 FROM b WHERE b.session_id = a.session_id AND b.symbol = a.symbol AND b.sec >= a.sec AND b.sec <= a.sec + 7200) AS INT) AS useful FROM a")
def implicit_feedback(spark, d):
    a = _accesses(spark, d)
    return spans.implicit_feedback(a.filter("id % 3 = 0"), a.filter("id % 3 > 0"), minutes=120)


@query("SELECT DISTINCT session_id, \"at\", symbol FROM (SELECT conv_id AS session_id, turn AS \"at\", lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS symbol FROM conversations WHERE text IS NOT NULL) WHERE length(symbol) >= 3")
def identifiers_named(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet").filter("text is not null")
    return spans.named(t.select(F.col("conv_id").alias("session_id"), "text", F.col("turn").alias("at"))).distinct()


# ---------------------------------------------------------------- files and blame


LISTS = "o AS (SELECT path, content_hash FROM files WHERE repo_hash = sha256('acme0')), n AS (SELECT path, content_hash FROM files WHERE repo_hash = sha256('acme1'))"


@query(f"WITH {sql('files')}, {LISTS} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.content_hash IS DISTINCT FROM n.content_hash")
def changed_files(spark, d):
    f = load(spark, d, "files")
    return ownership.changed_files(f.filter(F.col("repo_hash") == _hex("acme0")), f.filter(F.col("repo_hash") == _hex("acme1")))


@query("""WITH s AS (SELECT 'f' || (p_partkey % 50) AS path, p_partkey AS name, p_size * 4 AS line FROM part), b AS (SELECT 'f' || (p_partkey % 50) AS path, line, min('dev' || (p_partkey * line % 5)) AS author FROM part, (SELECT unnest(range(1, 260)) AS line) WHERE p_partkey < 50 GROUP BY 1, 2),
o AS (SELECT b.path, b.line, author, (SELECT max(ROW(s.line, s.name)) FROM s WHERE s.path = b.path AND s.line <= b.line) AS own FROM b), v AS (SELECT path, own[2] AS name, author, count(*) AS n FROM o WHERE own IS NOT NULL GROUP BY ALL) SELECT path, name, min_by(author, ROW(-n, author)) AS author FROM v GROUP BY 1, 2""")
def authors_by_lines(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    path = F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string"))
    s = p.select(path.alias("path"), F.col("p_partkey").alias("name"), (F.col("p_size") * 4).alias("line"))
    lines = p.filter("p_partkey < 50").select("p_partkey", path.alias("path"), F.explode(F.sequence(F.lit(1), F.lit(259))).alias("line"))
    b = lines.groupBy("path", "line").agg(F.min(F.concat(F.lit("dev"), (F.col("p_partkey") * F.col("line") % 5).cast("string"))).alias("author"))
    return ownership.symbol_authors(s, b)


@query(f"WITH {sql('links')} SELECT source_hash, edge_hash, round(confidence, 6) AS confidence FROM links WHERE edge_type = 'runtime_calls' AND observation_count > 1")
def runtime_repeat_edges(spark, d):
    return ops.by_provenance(load(spark, d, "links"), "otel_").filter("observation_count > 1").select("source_hash", "edge_hash", F.round("confidence", 6).alias("confidence"))
