"""Queries on the store's tables: lookups, predicates, counts, changes, snapshots' diffs and derived edges."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from graphloom.functions import identity
from graphloom.functions import predicates as pred
from graphloom.operators import store as ops
from graphloom.plans.store import load, sql
from graphloom.registry import NOW, query

DAY = 86_400


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- scans and lookups


@query(f"WITH {sql('links')} SELECT count(*) AS n FROM links")
def edge_count(spark, d):
    return load(spark, d, "links").agg(F.count("*").alias("n"))


@query(f"WITH {sql('repos')} SELECT repo_url, repo_hash, last_indexed FROM repos ORDER BY repo_url")
def repos_by_url(spark, d):
    return load(spark, d, "repos").orderBy("repo_url").select("repo_url", "repo_hash", "last_indexed")


@query(f"WITH {sql('files')} SELECT path, file_hash, content_hash FROM files WHERE repo_hash = sha256('acme1') ORDER BY path")
def files_of_repo(spark, d):
    return load(spark, d, "files").filter(F.col("repo_hash") == _hex("acme1")).orderBy("path").select("path", "file_hash", "content_hash")


@query("SELECT vec_id, len(embedding) AS size FROM embeddings WHERE label = 3")
def embeddings_of_model(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").filter("label = 3").select("vec_id", F.size("embedding").cast("long").alias("size"))


@query(f"WITH {sql('notes')} SELECT object_hash, value, updated_at FROM notes WHERE note_key = 'owner' ORDER BY object_hash")
def notes_by_key(spark, d):
    return load(spark, d, "notes").filter("note_key = 'owner'").orderBy("object_hash").select("object_hash", "value", "updated_at")


@query(f"WITH {sql('notes')} SELECT note_key, value FROM notes WHERE object_hash = sha256('n7') ORDER BY note_key, updated_at")
def notes_of_object(spark, d):
    return load(spark, d, "notes").filter(F.col("object_hash") == _hex("n7")).orderBy("note_key", "updated_at").select("note_key", "value")


@query(f"WITH {sql('symbols')} SELECT node_hash, qualified_name, kind, line FROM symbols WHERE node_hash IN (SELECT node_hash FROM symbols WHERE id IN (7, 8, 9))")
def get_nodes(spark, d):
    s = load(spark, d, "symbols")
    return ops.by_keys(s, s.filter("id in (7, 8, 9)"), "node_hash").select("node_hash", "qualified_name", "kind", "line")


@query(f"WITH {sql('links')} SELECT edge_hash, edge_type, provenance FROM links WHERE edge_hash IN (SELECT min(edge_hash) FROM links UNION ALL SELECT max(edge_hash) FROM links)")
def get_edges(spark, d):
    e = load(spark, d, "links")
    ends = e.agg(F.min("edge_hash").alias("edge_hash")).union(e.agg(F.max("edge_hash")))
    return ops.by_keys(e, ends, "edge_hash").select("edge_hash", "edge_type", "provenance")


@query(f"WITH {sql('snapshots')} SELECT snapshot_hash, parent_hash, generation FROM snapshots WHERE snapshot_hash = sha256('snap41')")
def get_snapshot(spark, d):
    return load(spark, d, "snapshots").filter(F.col("snapshot_hash") == _hex("snap41")).select("snapshot_hash", "parent_hash", "generation")


@query(f"WITH {sql('repos')} SELECT repo_url, last_commit FROM repos WHERE repo_hash = sha256('acme2')")
def get_repo(spark, d):
    return load(spark, d, "repos").filter(F.col("repo_hash") == _hex("acme2")).select("repo_url", "last_commit")


@query(f"WITH {sql('files')} SELECT file_hash, content_hash FROM files WHERE repo_hash = sha256('acme0') AND path = 'internal/hot/gear.ts'")
def file_by_path(spark, d):
    return load(spark, d, "files").filter((F.col("repo_hash") == _hex("acme0")) & (F.col("path") == "internal/hot/gear.ts")).select("file_hash", "content_hash")


@query(f"WITH {sql('symbols')} SELECT node_hash, symbol FROM symbols WHERE file_hash = sha256('acme0:internal/hot/gear.ts')")
def nodes_by_file_hash(spark, d):
    return load(spark, d, "symbols").filter(F.col("file_hash") == _hex("acme0:internal/hot/gear.ts")).select("node_hash", "symbol")


@query(f"WITH {sql('routes')} SELECT node_hash, created_at FROM routes WHERE service_name = 'svc4' AND route_pattern = '/api/4' AND mapping_type = 'http'")
def route_symbol(spark, d):
    return load(spark, d, "routes").filter("service_name = 'svc4' and route_pattern = '/api/4' and mapping_type = 'http'").select("node_hash", "created_at")


@query(f"WITH {sql('links')} SELECT edge_hash, confidence, observation_count FROM links WHERE provenance LIKE 'otel_%'")
def runtime_edges_by_provenance(spark, d):
    return ops.by_provenance(load(spark, d, "links"), "otel_").select("edge_hash", "confidence", "observation_count")


@query(f"WITH {sql('notes')} SELECT object_hash, try_cast(value AS INT) AS number FROM notes WHERE note_key = 'community' AND try_cast(value AS INT) IS NOT NULL AND object_hash IN (SELECT object_hash FROM notes WHERE updated_at < 300)")
def communities_of_nodes(spark, d):
    n = load(spark, d, "notes")
    return ops.integers_of(n, n.filter("updated_at < 300"), "community")


@query("SELECT e.vec_id, e.label FROM embeddings e WHERE e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def embeddings_of_nodes(spark, d):
    e, ids = spark.read.parquet(f"{d}/embeddings.parquet"), spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return ops.by_keys(e, ids, "vec_id").select("vec_id", "label")


def _runtime_sql(where: str, service: bool) -> str:
    join = "JOIN routes r ON r.node_hash = target_hash" if service else ""
    return f"WITH {sql('links', 'routes')} SELECT edge_hash, observation_count FROM links {join} WHERE provenance LIKE 'otel_%' AND {where}"


@query(_runtime_sql("service_name = 'svc3' AND route_pattern LIKE '/api/%'", True) + " ORDER BY edge_hash LIMIT 25")
def runtime_edges_of_service(spark, d):
    return ops.runtime_of(load(spark, d, "links"), load(spark, d, "routes"), "svc3", "/api/%", 25).select("edge_hash", "observation_count")


@query(_runtime_sql("EXISTS (SELECT 1 FROM routes r WHERE r.node_hash = target_hash AND route_pattern LIKE '/api/1%')", False))
def runtime_edges_of_route(spark, d):
    return ops.runtime_of(load(spark, d, "links"), load(spark, d, "routes"), "", "/api/1%").select("edge_hash", "observation_count")


REFS = {"@latest": "DESC, id DESC LIMIT 1", "@first": "LIMIT 1", "@prev": "DESC, id DESC LIMIT 1 OFFSET 1", "@5": "DESC, id DESC LIMIT 1 OFFSET 5"}


@query(f"WITH {sql('snapshots')} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS ref, snapshot_hash FROM snapshots ORDER BY made_at {v if k != '@first' else ', id LIMIT 1'})" for k, v in REFS.items()).replace("made_at , id", "made_at, id"))
def snapshot_refs(spark, d):
    s, out = load(spark, d, "snapshots"), None
    for ref in REFS:
        part = ops.snapshot_ref(s, ref).select(F.lit(ref).alias("ref"), "snapshot_hash")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- predicates


#: Names that reach each branch of the predicates, after those of all symbols.
ODD_NAMES = "external://os.Open stdlib://fmt.Println acme://web/dist/app.js.run acme://web/app.min.js.go acme://py/conftest.py.setup acme://go/testutil/x.go.Run acme://a/b.go.MockStore.Put acme://a/b.go.fakeStub acme://a/b.go.nR acme://a/b.go.ID acme://a/tests/x.rs.check acme://a/test_io.py.run acme://a/x.spec.ts.it acme://lib/test/a.rb.go acme://q/UnitTests/Z.cs.Run acme://b/examples/x.go.main acme://org/BENCHMARKS/y.py.Go".split()
NAMES_SQL = f"names AS (SELECT qualified_name AS q, kind FROM symbols UNION ALL SELECT unnest([{', '.join(repr(x) for x in ODD_NAMES)}]), 'function')"


def _names(spark, d):
    odd = spark.createDataFrame([(x, "function") for x in ODD_NAMES], "q string, kind string")
    return load(spark, d, "symbols").select(F.col("qualified_name").alias("q"), "kind").unionByName(odd)


def _any(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


NOISE_SQL = f"""(starts_with(q, 'external://') OR starts_with(q, 'stdlib://') OR {_any('lower(q)', pred.NOISE_PARTS)} OR {_any("lower(regexp_extract(q, '[.]([^.]*)[.][^.]*$', 1))", pred.DOUBLES)}
  OR (contains(q, '.') AND strlen(string_split(q, '.')[-1]) <= 2 AND string_split(q, '.')[-1] NOT IN {tuple(pred.SHORT_NAMES)}))"""


@query(f"WITH {sql('symbols')}, {NAMES_SQL} SELECT q FROM names WHERE NOT {NOISE_SQL}")
def noise_filter(spark, d):
    return _names(spark, d).filter(~pred.noise(F.col("q"), F.col("kind"))).select("q")


@query(f"""WITH {sql('symbols')}, {NAMES_SQL}, n AS (SELECT q, kind, lower(q) AS l FROM names) SELECT q,
  {_any('l', ("_test.go", "/tests/", ".test.", ".spec.", "/__tests__/", "/test/", "/src/test/"))} OR (contains(l, '/test_') AND contains(l, '.py')) OR (contains(l, 'tests/') AND {_any('l', ("unittests/", "acceptancetests/", "integrationtests/", ".tests/"))}) AS ranking,
  {_any('l', pred.CO_TEST_PARTS)} OR ends_with(l, 'tests.py') OR ends_with(l, 'test.java') OR ends_with(l, 'tests.java') AS co_test, {_any('l', pred.SUPPLY_PARTS)} AS supply,
  kind = 'function' AND (starts_with(string_split(q, '.')[-1], 'Test') OR starts_with(string_split(q, '.')[-1], 'Benchmark')) AS test_function FROM n""")
def test_predicates(spark, d):
    q = F.col("q")
    return _names(spark, d).select("q", pred.ranking_test(q).alias("ranking"), pred.co_test(q).alias("co_test"), pred.supply_test(q).alias("supply"), pred.test_function(F.col("kind"), q).alias("test_function"))


WORDS_SQL = "w AS (SELECT DISTINCT unnest(string_split(doc || ' use query when thing data cache', ' ')) AS word FROM symbols)"


@query(f"WITH {sql('symbols')}, {WORDS_SQL} SELECT word FROM w WHERE strlen(word) >= 4 AND word NOT IN {tuple(pred.VOCAB_NOISE)} AND word NOT IN {tuple(pred.STOP_WORDS)}")
def vocab_worthy(spark, d):
    w = load(spark, d, "symbols").select(F.explode(F.split(F.concat("doc", F.lit(" use query when thing data cache")), " ")).alias("word")).distinct()
    return w.filter(pred.vocab_worthy(F.col("word")))


PROCS = ["/usr/bin/Node", "curl", "bin/python3", "nc", "worker_threads", "GIT", "/opt/evil/bash"]


@query(f"SELECT p, lower(string_split(p, '/')[-1]) IN {tuple(pred.BENIGN)} AS benign FROM (SELECT unnest({PROCS!r}) AS p)")
def benign_processes(spark, d):
    return spark.createDataFrame([(p,) for p in PROCS], "p string").select("p", pred.benign_process(F.col("p")).alias("benign"))


@query(f"WITH {sql('links')} SELECT edge_type, count(*) AS n FROM links WHERE edge_type IN ('calls', 'imports') GROUP BY 1")
def edge_type_allowed(spark, d):
    return load(spark, d, "links").filter(pred.edge_allowed(F.col("edge_type"), ["calls", "imports"])).groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"""WITH {sql('symbols')}, r AS (SELECT qualified_name AS q, row_number() OVER (ORDER BY qualified_name) - 1 AS k, greatest(count(*) OVER () // 500, 1) AS step FROM symbols)
SELECT language, count(*) AS n FROM (SELECT CASE WHEN contains(q, '.go.') THEN 'go' WHEN contains(q, '.py.') THEN 'python' WHEN contains(q, '.ts.') OR contains(q, '.tsx.') THEN 'typescript' END AS language FROM r WHERE k % step = 0) WHERE language IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def dominant_language(spark, d):
    return ops.dominant_language(load(spark, d, "symbols"))


# ---------------------------------------------------------------- counts


TABLES = {"nodes": "symbols", "edges": "links", "snapshots": "snapshots", "files": "files", "repos": "repos", "notes": "notes"}


@query(f"WITH {sql(*TABLES.values(), 'feedback')} " + " UNION ALL ".join(f"SELECT '{k}' AS what, count(*) AS n FROM {v}" for k, v in TABLES.items()) + " UNION ALL SELECT 'feedback', count(*) FROM feedback UNION ALL SELECT 'useful', count(*) FROM feedback WHERE useful = 1 UNION ALL SELECT 'not_useful', count(*) FROM feedback WHERE useful = 0 UNION ALL SELECT 'feedback_symbols', count(DISTINCT symbol_hash) FROM feedback UNION ALL SELECT 'merkleized', count(neighborhood_root) FROM feedback")
def table_counts(spark, d):
    return ops.table_counts({k: load(spark, d, v) for k, v in TABLES.items()}, load(spark, d, "feedback"))


@query(f"WITH {sql('snapshots')} SELECT CAST({NOW} - coalesce(max(made_at), 0) AS BIGINT) AS age FROM snapshots")
def latest_snapshot_age(spark, d):
    return ops.latest_age(load(spark, d, "snapshots"), NOW)


@query(f"WITH {sql('feedback')} SELECT symbol_hash, CAST(sum(useful) AS BIGINT) AS useful, CAST(count(*) - sum(useful) AS BIGINT) AS not_useful, count(*) AS total, round(sum(useful) / count(*), 6) AS score FROM feedback GROUP BY 1")
def feedback_stats(spark, d):
    return ops.feedback_stats(load(spark, d, "feedback"))


@query(f"WITH {sql('feedback')} SELECT keyword_cluster, CAST(sum(useful) AS BIGINT) AS useful, CAST(count(*) - sum(useful) AS BIGINT) AS not_useful, count(*) AS total, round(sum(useful) / count(*), 6) AS score FROM feedback GROUP BY 1")
def feedback_by_cluster(spark, d):
    return ops.feedback_stats(load(spark, d, "feedback"), "keyword_cluster")


BOOST_SQL = {"none": "raw", "linear": "0.5e0 + (raw - 0.5e0) * (1 - 1 / (1e0 + n))", "sqrt": "0.5e0 + (raw - 0.5e0) * (1 - 1 / (1e0 + sqrt(n)))", "asym": "CASE WHEN raw >= 0.5 THEN raw ELSE 0.5e0 + (raw - 0.5e0) * (1 - 1 / (1e0 + sqrt(n))) END"}


@query(f"WITH {sql('feedback')}, g AS (SELECT symbol_hash, CAST(sum(useful) AS DOUBLE) / count(*) AS raw, CAST(count(*) AS DOUBLE) AS n FROM feedback GROUP BY 1) " + " UNION ALL ".join(f"SELECT symbol_hash, '{m}' AS mode, round({x}, 6) AS boost FROM g" for m, x in BOOST_SQL.items()))
def feedback_boosts_modes(spark, d):
    out = None
    for mode in BOOST_SQL:
        part = ops.feedback_boosts(load(spark, d, "feedback"), mode).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {sql('feedback', 'symbols')}, r AS (SELECT node_hash AS symbol_hash, sha256('root' || (id % 2)) AS root FROM symbols WHERE id % 3 > 0) SELECT symbol_hash, round(CAST(sum(useful) AS DOUBLE) / count(*), 6) AS boost FROM feedback LEFT JOIN r USING (symbol_hash) WHERE keyword_cluster = sha256('c1') AND (neighborhood_root IS NULL OR neighborhood_root = root) GROUP BY 1")
def feedback_boosts_of_roots(spark, d):
    roots = load(spark, d, "symbols").filter("id % 3 > 0").select(F.col("node_hash").alias("symbol_hash"), F.sha2(F.concat(F.lit("root"), (F.col("id") % 2).cast("string")), 256).alias("root"))
    return ops.feedback_boosts(load(spark, d, "feedback"), "none", roots, _hex("c1"))


#: Some time among the runtime edges' last sights, so that every age class holds some.
LATE = "(SELECT max(last_observed) + 86400 * 5 FROM links)"
RT = "rt AS (SELECT edge_type, last_observed AS t, {} AS now FROM links WHERE provenance LIKE 'otel_%')"


def _late(spark, d):
    return load(spark, d, "links").agg(F.max("last_observed")).first()[0] + DAY * 5


@query(f"WITH {sql('links')}, {RT.format(LATE)} SELECT 'total' AS what, count(*) AS n FROM rt UNION ALL SELECT 'active', count(*) FILTER (t >= now - 7 * 86400) FROM rt UNION ALL SELECT 'stale', count(*) FILTER (t > 0 AND t < now - 30 * 86400) FROM rt UNION ALL SELECT 'collectable', count(*) FILTER (t > 0 AND t < now - 90 * 86400) FROM rt UNION ALL SELECT 'type:' || edge_type, count(*) FROM rt GROUP BY edge_type")
def runtime_stats_buckets(spark, d):
    return ops.runtime_stats(load(spark, d, "links"), _late(spark, d))


@query(f"WITH {sql('links')}, {RT.format(LATE)} SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN (now - t) // 86400 <= 7 THEN 'active' WHEN (now - t) // 86400 > 90 THEN 'collectable' WHEN (now - t) // 86400 > 30 THEN 'stale' END AS bucket FROM rt) WHERE bucket IS NOT NULL GROUP BY 1")
def trace_stats_exclusive(spark, d):
    return ops.trace_stats(load(spark, d, "links"), _late(spark, d))


@query(f"WITH {sql('symbols', 'files')} SELECT count(*) AS n FROM symbols WHERE file_hash IN (SELECT file_hash FROM files WHERE NOT ends_with(path, '.ts'))")
def real_node_count(spark, d):
    return ops.real_nodes(load(spark, d, "symbols"), load(spark, d, "files").filter(~F.col("path").endswith(".ts")))


@query(f"WITH {sql('links')} SELECT target_hash, greatest(max(confidence), 0.5e0) AS confidence, max(last_observed) AS last_observed FROM links GROUP BY 1")
def incoming_confidence(spark, d):
    return ops.incoming_confidence(load(spark, d, "links"))


@query(f"WITH {sql('vocab')} SELECT keyword, symbol_name, symbol_hash, seen, round(0.3e0 + 0.5e0 * least(greatest((seen - 2) / 8e0, 0), 1), 6) AS weight FROM vocab LEFT JOIN (SELECT symbol_hash, sha256('root0') AS root FROM vocab WHERE seen % 5 > 0) r USING (symbol_hash) WHERE keyword IN ('red', 'blue') AND seen >= 2 AND (root IS NULL OR root = subgraph_root)")
def learned_vocab(spark, d):
    v = load(spark, d, "vocab")
    roots = v.filter("seen % 5 > 0").select("symbol_hash", F.lit(_hex("root0")).alias("root"))
    return ops.learned(v, ["red", "blue"], 2, roots)


# ---------------------------------------------------------------- snapshots' diffs


SNAP = _hex("snap15")
ADDED = f"added AS (SELECT event_id, e.edge_hash, e.source_hash, e.target_hash, e.edge_type, confidence, provenance FROM edge_events v JOIN links e USING (edge_hash) WHERE snapshot_hash = '{SNAP}' AND event_type = 'added')"
REMOVED = f"removed AS (SELECT event_id, v.edge_hash, coalesce(v.source_hash, e.source_hash) AS source_hash, coalesce(v.target_hash, e.target_hash) AS target_hash, coalesce(v.edge_type, e.edge_type, '') AS edge_type, coalesce(confidence, 1e0) AS confidence, coalesce(provenance, 'unknown') AS provenance FROM edge_events v LEFT JOIN (SELECT * FROM links WHERE source_id % 5 > 0) e USING (edge_hash) WHERE snapshot_hash = '{SNAP}' AND event_type = 'removed')"


def _changes(spark, d):
    e, events = load(spark, d, "links"), load(spark, d, "edge_events")
    return ops.diff_added(events, e, SNAP), ops.diff_removed(events, e.filter("source_id % 5 > 0"), SNAP)


@query(f"WITH {sql('edge_events')}, {ADDED} SELECT * FROM added")
def event_diff_added(spark, d):
    return _changes(spark, d)[0]


@query(f"WITH {sql('edge_events')}, {REMOVED} SELECT * FROM removed")
def event_diff_removed(spark, d):
    return _changes(spark, d)[1]


@query(f"WITH {sql('edge_events')}, {ADDED} SELECT event_id, s.qualified_name AS source_name, t.qualified_name AS target_name, edge_type FROM added LEFT JOIN symbols s ON s.node_hash = source_hash LEFT JOIN symbols t ON t.node_hash = target_hash")
def semantic_diff_edges(spark, d):
    return ops.named_edges(_changes(spark, d)[0], load(spark, d, "symbols")).select("event_id", "source_name", "target_name", "edge_type")


MODIFIED = "modified AS (SELECT source_hash AS node_hash, coalesce(any_value(qualified_name), '') AS qualified_name, CAST(sum(a) AS BIGINT) AS edges_added, CAST(sum(r) AS BIGINT) AS edges_removed FROM (SELECT source_hash, 1 AS a, 0 AS r FROM added UNION ALL SELECT source_hash, 0, 1 FROM removed) LEFT JOIN symbols ON node_hash = source_hash GROUP BY 1)"


@query(f"WITH {sql('edge_events')}, {ADDED}, {REMOVED}, {MODIFIED} SELECT * FROM modified")
def semantic_diff_nodes(spark, d):
    return ops.modified_nodes(*_changes(spark, d), load(spark, d, "symbols"))


@query(f"WITH RECURSIVE {sql('edge_events')}, {ADDED}, {REMOVED}, {MODIFIED}, calls AS (SELECT DISTINCT source_hash AS s, target_hash AS t FROM links WHERE edge_type = 'calls'), up AS (SELECT node_hash AS start, s AS node, 1 AS depth FROM modified JOIN calls ON t = node_hash WHERE qualified_name <> '' UNION SELECT start, s, depth + 1 FROM up JOIN calls ON t = node WHERE depth < 5), dn AS (SELECT node_hash AS start, t AS node, 1 AS depth FROM modified JOIN calls ON s = node_hash WHERE qualified_name <> '' UNION SELECT start, t, depth + 1 FROM dn JOIN calls ON s = node WHERE depth < 3), real AS (SELECT node_hash AS node FROM symbols), n AS (SELECT (SELECT count(*) FROM modified WHERE qualified_name <> '') AS symbols, (SELECT count(DISTINCT node) FROM up JOIN real USING (node)) AS callers, (SELECT count(DISTINCT node) FROM dn JOIN real USING (node)) AS callees, (SELECT count(*) FROM added) + (SELECT count(*) FROM removed) AS edges) SELECT *, CASE WHEN callers > 20 THEN 'high' WHEN callers > 5 THEN 'medium' ELSE 'low' END AS risk FROM n")
def pr_impact(spark, d):
    from graphloom.operators import iterative
    from graphloom.plans.lineage import cut

    added, removed = _changes(spark, d)
    nodes = load(spark, d, "symbols")
    changed = cut(ops.modified_nodes(added, removed, nodes).filter("qualified_name <> ''").select(F.col("node_hash").alias("start")), "changed")
    calls = load(spark, d, "links").filter("edge_type = 'calls'")
    real = nodes.select(F.col("node_hash").alias("node"))
    count = lambda up, depth, name: iterative.reached(calls, changed, depth, reverse=up).join(real, "node", "left_semi").agg(F.count("*").alias(name))
    out = changed.agg(F.count("*").alias("symbols")).join(count(True, 5, "callers")).join(count(False, 3, "callees"))
    out = out.join(added.select("edge_hash").unionByName(removed.select("edge_hash")).agg(F.count("*").alias("edges")))
    return out.withColumn("risk", identity.confidence_bucket(F.col("callers")))


# ---------------------------------------------------------------- changes


@query(f"WITH {sql('notes')}, base AS (SELECT object_hash, note_key, max(updated_at) AS updated_at, max(value) AS value FROM notes WHERE updated_at % 3 > 0 GROUP BY 1, 2), new AS (SELECT object_hash, note_key, max(ROW(updated_at, value)) AS r FROM notes WHERE updated_at % 3 = 0 GROUP BY 1, 2) SELECT * FROM base WHERE (object_hash, note_key) NOT IN (SELECT (object_hash, note_key) FROM new) UNION ALL SELECT object_hash, note_key, struct_extract(r, 1), struct_extract(r, 2) FROM new")
def upsert_notes(spark, d):
    n = load(spark, d, "notes")
    base = n.filter("updated_at % 3 > 0").groupBy("object_hash", "note_key").agg(F.max("updated_at").alias("updated_at"), F.max("value").alias("value"))
    return ops.upsert(base, n.filter("updated_at % 3 = 0").select("object_hash", "note_key", "updated_at", "value"), ["object_hash", "note_key"])


@query(f"WITH {sql('vocab')}, both_ AS (SELECT keyword, symbol_hash, seen, seen AS last_seen FROM vocab UNION ALL SELECT keyword, symbol_hash, 1, 99 FROM vocab WHERE seen > 6 UNION ALL SELECT 'new', symbol_hash, 1, 7 FROM vocab WHERE seen = 3) SELECT keyword, symbol_hash, CAST(sum(seen) AS BIGINT) AS seen, max(last_seen) AS last_seen FROM both_ GROUP BY 1, 2")
def vocab_counter_upsert(spark, d):
    v = load(spark, d, "vocab").select("keyword", "symbol_hash", F.col("seen").cast("long").alias("seen"), F.col("seen").cast("long").alias("last_seen"))
    more = v.filter("seen > 6").select("keyword", "symbol_hash", F.lit(99).cast("long").alias("last_seen")).unionByName(v.filter("seen = 3").select(F.lit("new").alias("keyword"), "symbol_hash", F.lit(7).cast("long").alias("last_seen")))
    return ops.count_up(v, more, ["keyword", "symbol_hash"], "seen", "last_seen")


@query(f"WITH {sql('symbols')} SELECT node_hash, CASE WHEN id % 4 = 1 THEN 'new' || id ELSE last_author END AS last_author, CASE WHEN id % 4 = 1 THEN id ELSE last_commit_at END AS last_commit_at FROM symbols")
def update_blame(spark, d):
    s = load(spark, d, "symbols")
    rows = s.filter("id % 4 = 1").select("node_hash", F.concat(F.lit("new"), F.col("id").cast("string")).alias("last_author"), F.col("id").alias("last_commit_at"))
    return ops.update(s.select("node_hash", "last_author", "last_commit_at"), rows, "node_hash", ["last_author", "last_commit_at"])


@query(f"WITH {sql('symbols')} SELECT node_hash, CASE WHEN id % 5 = 0 THEN id / 1000e0 ELSE coverage_pct END AS coverage_pct FROM symbols")
def update_coverage(spark, d):
    s = load(spark, d, "symbols")
    return ops.update(s.select("node_hash", "coverage_pct"), s.filter("id % 5 = 0").select("node_hash", (F.col("id") / 1000).alias("coverage_pct")), "node_hash", ["coverage_pct"])


@query(f"WITH {sql('links')}, {RT.format(LATE).replace('edge_type,', 'edge_hash,')} SELECT l.edge_hash, CASE WHEN t > 0 AND t < now - 30 * 86400 AND confidence > 0.2 THEN 0.2e0 ELSE confidence END AS confidence FROM links l LEFT JOIN rt USING (edge_hash)")
def decay_update(spark, d):
    return ops.decay(load(spark, d, "links"), _late(spark, d)).select("edge_hash", "confidence")


@query(f"WITH {sql('feedback')} SELECT id, symbol_hash, useful FROM feedback UNION ALL SELECT id + 1000000, symbol_hash, 1 - useful FROM feedback WHERE id % 10 = 0")
def record_feedback(spark, d):
    f = load(spark, d, "feedback").select("id", "symbol_hash", "useful")
    return ops.append_events(f, f.filter("id % 10 = 0").select((F.col("id") + 1_000_000).alias("id"), "symbol_hash", (1 - F.col("useful")).alias("useful")))


@query(f"WITH {sql('links', 'symbols')} SELECT edge_hash FROM links WHERE source_hash NOT IN (SELECT node_hash FROM symbols WHERE file_hash IN (sha256('acme0:internal/hot/gear.ts'), sha256('acme1:internal/red/widget_test.go')))")
def delete_edges_by_source_file(spark, d):
    files = spark.createDataFrame([(_hex("acme0:internal/hot/gear.ts"),), (_hex("acme1:internal/red/widget_test.go"),)], "file_hash string")
    return ops.delete_by_source_file(load(spark, d, "links"), load(spark, d, "symbols"), files).select("edge_hash")


@query(f"WITH {sql('symbols')} SELECT node_hash FROM symbols WHERE file_hash <> sha256('acme0:internal/hot/gear.ts')")
def delete_nodes_by_file(spark, d):
    return ops.delete_keys(load(spark, d, "symbols"), spark.createDataFrame([(_hex("acme0:internal/hot/gear.ts"),)], "file_hash string"), "file_hash").select("node_hash")


@query(f"""WITH {sql('links', 'files', 'edge_events', 'feedback', 'snapshots')}, gone AS (SELECT node_hash AS h FROM symbols WHERE repo_hash = sha256('acme1'))
SELECT 'nodes' AS what, count(*) AS n FROM symbols WHERE repo_hash <> sha256('acme1') UNION ALL SELECT 'files', count(*) FROM files WHERE repo_hash <> sha256('acme1') UNION ALL SELECT 'edges', count(*) FROM links WHERE source_hash NOT IN (FROM gone) AND target_hash NOT IN (FROM gone)
UNION ALL SELECT 'edge_events', count(*) FROM edge_events WHERE coalesce(source_hash NOT IN (FROM gone) AND target_hash NOT IN (FROM gone), true) UNION ALL SELECT 'feedback', count(*) FROM feedback WHERE symbol_hash NOT IN (FROM gone) UNION ALL SELECT 'snapshots', count(*) FROM snapshots WHERE repo_url <> 'acme1'""")
def evict_repo(spark, d):
    snaps = load(spark, d, "snapshots").withColumn("repo_hash", F.sha2("repo_url", 256))
    t = {"nodes": load(spark, d, "symbols"), "files": load(spark, d, "files"), "edges": load(spark, d, "links"), "edge_events": load(spark, d, "edge_events"), "feedback": load(spark, d, "feedback"), "snapshots": snaps}
    out = None
    for name, rows in ops.evict(t, _hex("acme1")).items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {sql('links', 'symbols')}, own AS (SELECT node_hash AS h FROM symbols WHERE starts_with(qualified_name, 'acme2')), kept AS (SELECT * FROM links WHERE source_hash IN (FROM own)), ends AS (SELECT h FROM own UNION SELECT target_hash FROM kept) SELECT (SELECT count(*) FROM symbols WHERE node_hash IN (FROM ends)) AS nodes, (SELECT count(*) FROM kept) AS edges")
def reachability_sweep(spark, d):
    nodes, edges = load(spark, d, "symbols"), load(spark, d, "links")
    keep_n, keep_e = ops.reachable(edges, nodes, "acme2")
    return ops.keep_keys(nodes, keep_n, "node_hash").agg(F.count("*").alias("nodes")).join(ops.keep_keys(edges, keep_e, "edge_hash").agg(F.count("*").alias("edges")))


# ---------------------------------------------------------------- derived edges


@query(f"WITH {sql('links')}, ty AS (SELECT type_name || (id % 37) AS owner, max(node_hash) AS h FROM symbols WHERE kind = 'type' GROUP BY 1), me AS (SELECT type_name || (id % 37) AS owner, node_hash AS m FROM symbols WHERE kind = 'method'), e AS (SELECT DISTINCT source_hash, m AS target_hash FROM links JOIN ty ON h = target_hash JOIN me USING (owner) WHERE edge_type = 'references') SELECT sha256(concat_ws(chr(0), 'edge', source_hash, target_hash, 'inherits', 'ast_resolved')) AS edge_hash, source_hash, target_hash, 'inherits' AS edge_type, 0.9e0 AS confidence, 'ast_resolved' AS provenance FROM e")
def inherits_edges(spark, d):
    """Types under shared names, so that several methods are of each; references stand for extends."""
    s = load(spark, d, "symbols")
    owner = F.concat(F.lit("r://p."), "type_name", (F.col("id") % 37).cast("string"))
    q = F.when(F.col("kind") == "type", owner).otherwise(F.concat(owner, F.lit(".m"), F.col("id").cast("string")))
    edges = load(spark, d, "links").filter("edge_type = 'references'").withColumn("edge_type", F.lit("extends"))
    return ops.inherits(s.withColumn("qualified_name", q), edges)


@query(f"WITH {sql('links')}, i AS (SELECT DISTINCT source_hash AS impl, target_hash AS iface FROM links WHERE edge_type = 'implements' AND source_hash <> target_hash), m AS (SELECT node_hash AS owner, word_a AS name, sha256(node_hash || word_a) AS h FROM symbols), e AS (SELECT DISTINCT a.h AS source_hash, b.h AS target_hash FROM i JOIN m a ON a.owner = impl JOIN m b ON b.owner = iface AND a.name = b.name) SELECT sha256(concat_ws(chr(0), 'edge', source_hash, target_hash, 'overrides', 'structural')) AS edge_hash, source_hash, target_hash, 'overrides' AS edge_type, 0.9e0 AS confidence, 'structural' AS provenance FROM e")
def overrides_made(spark, d):
    s = load(spark, d, "symbols")
    m = s.select(F.col("node_hash").alias("owner"), F.col("word_a").alias("name"), F.sha2(F.concat("node_hash", "word_a"), 256).alias("node_hash"))
    i = load(spark, d, "links").filter("edge_type = 'implements'").select(F.col("source_hash").alias("impl"), F.col("target_hash").alias("iface"))
    return ops.overrides(i, m)


@query(f"""WITH {sql('links')}, n AS (SELECT *, sha256(concat_ws(chr(0), 'node', repo_url, path, symbol, k)) AS nh FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'interface' ELSE kind END AS k FROM symbols)),
e AS (SELECT edge_hash AS old_hash, source_hash, sha256(concat_ws(chr(0), 'node', repo_url, path, symbol, 'type')) AS t FROM links JOIN symbols ON id = target_id WHERE edge_type = 'type_hint_of'),
f AS (SELECT old_hash, source_hash, nh AS target_hash FROM e JOIN n ON sha256(concat_ws(chr(0), 'node', repo_url, path, symbol, 'type')) = t AND k = 'interface' WHERE t NOT IN (SELECT nh FROM n))
SELECT old_hash, sha256(concat_ws(chr(0), 'edge', source_hash, target_hash, 'type_hint_of', 'type_hint_resolved')) AS edge_hash, source_hash, target_hash, 'type_hint_of' AS edge_type, 0.8e0 AS confidence, 'type_hint_resolved' AS provenance FROM f""")
def type_hint_retarget(spark, d):
    """Every other symbol is an interface now, while hints onto it were hashed as onto a type."""
    s = load(spark, d, "symbols")
    kind = F.when(F.col("id") % 2 == 0, "interface").otherwise(F.col("kind"))
    part = lambda k: identity.node_hash(F.col("repo_url"), F.col("path"), F.col("symbol"), k)
    nodes = s.select(part(kind).alias("node_hash"), "repo_url", F.col("path").alias("package_path"), F.col("symbol").alias("name"), kind.alias("kind"))
    typed = s.select(F.col("id").alias("target_id"), part(F.lit("type")).alias("target_hash"))
    edges = load(spark, d, "links").filter("edge_type = 'type_hint_of'").drop("target_hash").join(typed, "target_id")
    return ops.hints_retargeted(edges.select("edge_hash", "source_hash", "target_hash", "edge_type"), nodes)


OWNER_RULES = [("*", ["@all"]), ("*.go", ["@go", "@core"]), ("internal/red/", ["@red"]), ("/internal/hot/*", ["@hot"]), ("internal/**/gear*", ["@gear"]), ("blue/bolt.py", ["@bolt"]), ("*_test.go", ["@qa"])]


@query(f"""WITH {sql('files')}, o AS (SELECT DISTINCT path, CASE WHEN ends_with(path, '_test.go') THEN ['@qa'] WHEN ends_with(path, 'blue/bolt.py') THEN ['@bolt'] WHEN starts_with(path, 'internal/') AND starts_with(string_split(path, '/')[-1], 'gear') THEN ['@gear']
WHEN regexp_matches(path, '^internal/hot/[^/]*$') THEN ['@hot'] WHEN starts_with(path, 'internal/red/') THEN ['@red'] WHEN ends_with(path, '.go') THEN ['@go', '@core'] ELSE ['@all'] END AS o FROM files) SELECT path, unnest(o) AS owner FROM o""")
def codeowners(spark, d):
    from graphloom.sources.ownership import rules_frame

    return ops.owned(load(spark, d, "files"), rules_frame(spark, OWNER_RULES))


@query(f"WITH {sql('files', 'symbols')}, o AS (SELECT file_hash, CASE WHEN ends_with(path, '.go') THEN 'go-team' ELSE 'others' END AS owner FROM files) SELECT qualified_name, owner, last_author AS author FROM symbols JOIN o USING (file_hash) WHERE id IN (4, 7, 9)")
def ownership_query(spark, d):
    owners = load(spark, d, "files").select("file_hash", F.when(F.col("path").endswith(".go"), "go-team").otherwise("others").alias("owner"))
    return load(spark, d, "symbols").filter("id in (4, 7, 9)").join(owners, "file_hash").select("qualified_name", "owner", F.col("last_author").alias("author"))


@query(f"WITH {sql('files', 'symbols')} SELECT f.path, CAST(count(node_hash) AS BIGINT) AS n, coalesce(string_agg(symbol, ',' ORDER BY symbol), '') AS names FROM files f LEFT JOIN symbols s ON s.file_hash = f.file_hash AND kind <> 'type' WHERE f.repo_hash = sha256('acme0') GROUP BY f.path")
def file_listing(spark, d):
    s = load(spark, d, "symbols").filter("kind <> 'type'").select("file_hash", "node_hash", "symbol")
    j = load(spark, d, "files").filter(F.col("repo_hash") == _hex("acme0")).select("file_hash", "path").join(s, "file_hash", "left")
    return j.groupBy("path").agg(F.count("node_hash").alias("n"), F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("names"))


@query(f"WITH {sql('links')} SELECT edge_hash, edge_type, provenance FROM links JOIN symbols s ON s.node_hash = source_hash JOIN symbols t ON t.node_hash = target_hash WHERE starts_with(s.symbol, 'Economy.') AND t.kind = 'type' AND edge_type = 'calls'")
def prove_lookup(spark, d):
    s = load(spark, d, "symbols").select("node_hash", "symbol", "kind")
    e = load(spark, d, "links").filter("edge_type = 'calls'").select("edge_hash", "edge_type", "provenance", "source_hash", "target_hash")
    e = ops.by_keys(e, s.filter(F.col("symbol").startswith("Economy.")).withColumnRenamed("node_hash", "source_hash"), "source_hash")
    return ops.by_keys(e, s.filter("kind = 'type'").withColumnRenamed("node_hash", "target_hash"), "target_hash").select("edge_hash", "edge_type", "provenance")


@query(f"WITH {sql('links')}, sel AS (SELECT node_hash AS h FROM symbols WHERE word_a = 'red') SELECT edge_hash FROM links WHERE source_hash IN (FROM sel) AND target_hash IN (FROM sel)")
def induced_subgraph(spark, d):
    sel = load(spark, d, "symbols").filter("word_a = 'red'").select("node_hash")
    e = ops.by_keys(load(spark, d, "links"), sel.withColumnRenamed("node_hash", "source_hash"), "source_hash")
    return ops.by_keys(e, sel.withColumnRenamed("node_hash", "target_hash"), "target_hash").select("edge_hash")


# environment reads and processes: references and imports onto symbols whose words are their names
DANGER = "dg AS (SELECT source_hash, target_hash, CASE WHEN edge_type = 'references' THEN 'reads_env' WHEN edge_type = 'imports' THEN 'executes_process' ELSE edge_type END AS edge_type FROM links WHERE target_id % 3 = 0 OR edge_type = 'calls'), nn AS (SELECT node_hash, file_hash, CASE WHEN id % 4 = 0 THEN '/usr/bin/node' ELSE qualified_name END AS q FROM symbols), ch AS (SELECT * FROM nn WHERE file_hash IN (SELECT file_hash FROM files WHERE substr(path, 10, 1) IN ('r', 'h')))"


@query(f"""WITH {sql('links', 'files')}, {DANGER}, pa AS (SELECT file_hash, min(q) AS file FROM ch GROUP BY 1), inb AS (SELECT file_hash, count(*) AS inbound FROM dg JOIN ch ON target_hash = node_hash WHERE source_hash NOT IN (SELECT node_hash FROM ch) GROUP BY 1),
o AS (SELECT c.file_hash, d.edge_type = 'reads_env' AS env, d.edge_type = 'executes_process' AND coalesce(lower(string_split(t.q, '/')[-1]) NOT IN {tuple(pred.BENIGN)}, true) AS proc, t.q IS NOT NULL AS known FROM dg d JOIN ch c ON d.source_hash = c.node_hash LEFT JOIN nn t ON t.node_hash = d.target_hash WHERE d.edge_type IN ('reads_env', 'executes_process')),
g AS (SELECT file_hash, count(*) FILTER (env OR proc) AS outbound, count(*) FILTER (env AND known) AS env, count(*) FILTER (proc AND known) AS named, count(*) FILTER (proc) AS procs FROM o GROUP BY 1)
SELECT file, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound, coalesce(procs, 0) > 0 AS hooked, round(least((1 - least(coalesce(inbound, 0), 10) / 10e0 * 0.7e0) * (least(coalesce(outbound, 0), 5) / 5e0 * CASE WHEN coalesce(env, 0) > 0 AND coalesce(named, 0) = 0 THEN 0.2e0 ELSE 1e0 END) * CASE WHEN coalesce(procs, 0) > 0 THEN 1.5e0 ELSE 1e0 END, 1e0), 6) AS score
FROM pa LEFT JOIN inb USING (file_hash) LEFT JOIN g USING (file_hash) WHERE NOT {_any('lower(file)', pred.SUPPLY_PARTS)}""")
def isolation_of_files(spark, d):
    nodes, edges, changed = _danger(spark, d)
    return ops.isolation_of(nodes, edges, changed)


def _danger(spark, d):
    kind = F.when(F.col("edge_type") == "references", "reads_env").when(F.col("edge_type") == "imports", "executes_process").otherwise(F.col("edge_type"))
    edges = load(spark, d, "links").filter("target_id % 3 = 0 or edge_type = 'calls'").select("source_hash", "target_hash", kind.alias("edge_type"))
    nodes = load(spark, d, "symbols").select("node_hash", "file_hash", F.when(F.col("id") % 4 == 0, "/usr/bin/node").otherwise(F.col("qualified_name")).alias("qualified_name"))
    return nodes, edges, load(spark, d, "files").filter(F.substring("path", 10, 1).isin("r", "h")).select("file_hash")


@query(f"WITH {sql('links', 'files')}, {DANGER} SELECT DISTINCT a.source_hash, a.target_hash AS env, b.target_hash AS process FROM dg a JOIN dg b USING (source_hash) WHERE a.edge_type = 'reads_env' AND b.edge_type = 'executes_process'")
def capability_pairs(spark, d):
    return ops.capability_pairs(_danger(spark, d)[1])
