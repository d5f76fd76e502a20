"""Queries on communities of the store's call graph and of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import communities as com
from graphloom.plans import derived
from graphloom.plans.lineage import cut
from graphloom.plans.store import load, sql
from graphloom.registry import NOW, query

#: Members by the symbols' numbers, so that SQL has the same ones.
MEM = "nodes AS (SELECT node_hash, qualified_name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS package, (id * id) % 61 AS c FROM symbols), e AS (SELECT DISTINCT source_hash AS u, target_hash AS v FROM links WHERE edge_type = 'calls' AND target_hash IN (SELECT node_hash FROM nodes))"


def _parts(spark, d):
    s = load(spark, d, "symbols")
    nodes = s.select("node_hash", "qualified_name", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("package"))
    members = s.select("node_hash", (F.col("id") * F.col("id") % 61).alias("community"))
    edges = load(spark, d, "links").filter("edge_type = 'calls'").select(F.col("source_hash").alias("u"), F.col("target_hash").alias("v")).distinct()
    return nodes, members, cut(edges.join(s.select(F.col("node_hash").alias("v")), "v", "left_semi").select("u", "v"), "edges")


@query(f"""WITH {sql('links')}, {MEM}, b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), d AS (SELECT u, count(*) AS a, count(*) FILTER (x.c = y.c) AS i FROM b JOIN nodes x ON x.node_hash = u JOIN nodes y ON y.node_hash = v GROUP BY 1),
m AS (SELECT n.*, coalesce(a, 0) AS a, coalesce(i, 0) AS i FROM nodes n LEFT JOIN d ON u = node_hash), g AS (SELECT c, count(*) AS size, round(coalesce(sum(i) / nullif(sum(a), 0), 0), 2) AS cohesion FROM m GROUP BY 1), t AS (SELECT c, string_agg(qualified_name, ',' ORDER BY k) AS top FROM (SELECT c, qualified_name, row_number() OVER (PARTITION BY c ORDER BY i DESC, qualified_name) AS k FROM m) WHERE k <= 5 GROUP BY 1),
p AS (SELECT c, min_by(package, ROW(-n, package)) AS dominant_package, string_agg(package, ',' ORDER BY package) AS packages, sha256(string_agg(sha256(package), '' ORDER BY package)) AS root FROM (SELECT c, package, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT *, row_number() OVER (ORDER BY size DESC, c) - 1 AS id FROM g JOIN t USING (c) JOIN p USING (c))
SELECT CAST(id AS INT) AS id, c AS community, size, cohesion, top, dominant_package, packages, root FROM l WHERE id < CASE WHEN (SELECT count(*) FROM l) > 20 THEN 19 ELSE 20 END UNION ALL SELECT 19, NULL, CAST(sum(size) AS BIGINT), 0.0, '', 'other', '', NULL FROM l WHERE id >= 19 AND (SELECT count(*) FROM l) > 20""")
def community_metadata(spark, d):
    out = com.describe(*_parts(spark, d), most=20)
    return out.select("id", "community", "size", "cohesion", F.array_join("top_symbols", ",").alias("top"), "dominant_package", F.array_join("packages", ",").alias("packages"), "root")


@query(f"WITH {sql('links')}, {MEM}, o AS (SELECT c FROM nodes JOIN symbols USING (node_hash) WHERE id = 7), i AS (SELECT node_hash FROM nodes WHERE c IN (FROM o)), b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e) SELECT c AS community, true AS own FROM o UNION ALL SELECT DISTINCT c, false FROM b JOIN nodes ON node_hash = v WHERE u IN (FROM i) AND c NOT IN (FROM o)")
def community_neighbours(spark, d):
    _, members, edges = _parts(spark, d)
    node = load(spark, d, "symbols").filter("id = 7").first()["node_hash"]
    return com.neighbours(members, edges, node)


@query(f"WITH {sql('symbols')} SELECT node_hash AS object_hash, CAST((id * id) % 61 AS VARCHAR) AS value FROM symbols WHERE id % 5 = 0 OR (id * id) % 61 <> (id * id) % 61 + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END")
def community_delta_save(spark, d):
    """Saved before: all but every fifth, and every seventh with another number."""
    s = load(spark, d, "symbols")
    c = F.col("id") * F.col("id") % 61
    saved = s.filter("id % 5 > 0").select("node_hash", (c + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("community"))
    return com.changed_notes(s.select("node_hash", c.alias("community")), com.as_notes(saved, NOW - 1), NOW).select("object_hash", "value")


@query(f"WITH {sql('symbols')} SELECT node_hash, CAST((id * id) % 61 AS BIGINT) AS community FROM symbols WHERE id % 6 > 0")
def community_load(spark, d):
    s = load(spark, d, "symbols")
    notes = com.as_notes(s.select("node_hash", F.when(F.col("id") % 6 == 0, "n/a").otherwise((F.col("id") * F.col("id") % 61).cast("string")).alias("community")), NOW)
    return com.from_notes(notes)


@query()
def louvain_fine(spark, d):
    return com.detect(derived.next_user_edges(spark, d), "louvain-fine")


@query()
def louvain_incremental(spark, d):
    """From the communities of all events, users below 10 move anew."""
    from graphloom.operators import iterative

    edges = cut(derived.next_user_edges(spark, d), "edges")
    former = cut(iterative.louvain(edges), "former")
    return iterative.louvain(edges, former=former, changed=former.filter("node < 10"))


def _incremental_sql(rounds: int) -> str:
    steps = ["l0 AS (SELECT DISTINCT u AS node, u % 5 AS label FROM sym)", "fr AS (SELECT DISTINCT u AS node FROM sym WHERE u < 30)"]
    for k in range(1, rounds + 1):
        steps.append(f"b{k} AS (SELECT node, label FROM (SELECT u AS node, label, row_number() OVER (PARTITION BY u ORDER BY sum(w) DESC, label) AS k FROM sym JOIN l{k - 1} ON v = node WHERE u IN (SELECT node FROM fr) GROUP BY u, label) WHERE k = 1)")
        steps.append(f"l{k} AS (SELECT l.node, coalesce(b.label, l.label) AS label FROM l{k - 1} l LEFT JOIN b{k} b ON b.node = l.node)")
    return f"WITH {derived.NEXT_USER_SQL}, sym AS (SELECT u, v, sum(w) AS w FROM (SELECT u, v, w FROM ue UNION ALL SELECT v, u, w FROM ue) GROUP BY 1, 2), {', '.join(steps)} SELECT * FROM l{rounds}"


@query(_incremental_sql(4))
def label_propagation_incremental(spark, d):
    edges = cut(derived.next_user_edges(spark, d), "edges")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return com.propagate_from(edges, nodes.select("node", (F.col("node") % 5).alias("label")), nodes.filter("node < 30"), 4)
