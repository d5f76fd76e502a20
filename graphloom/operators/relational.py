"""Lookups, joins and aggregates over node, edge, file, event and route tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import identity
from graphloom.plans.lineage import cut

DAY = 86_400


def name_search(nodes: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive prefix search; a leading % makes it `contains`."""
    return nodes.filter(F.col("qualified_name").ilike(pattern + "%"))


def nodes_in_paths(nodes: DataFrame, files: DataFrame, paths: list[str]) -> DataFrame:
    return nodes.join(files.filter(F.col("path").isin(paths)).select("file_hash", "path"), "file_hash")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node_hash").alias("target_hash")), "target_hash", "left_anti")


def stale_edges(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose source lies in a file of which another content exists under the same repository and path."""
    moved = files.groupBy("repo_hash", "path").agg(F.min("content_hash").alias("a"), F.max("content_hash").alias("b")).filter("a <> b").select("repo_hash", "path")
    stale = files.join(moved, ["repo_hash", "path"], "left_semi").select("file_hash")
    sources = nodes.join(stale, "file_hash", "left_semi").select(F.col("node_hash").alias("source_hash")).distinct()
    return edges.join(sources, "source_hash", "left_semi")


def fsck_counts(nodes: DataFrame, edges: DataFrame, snapshots: DataFrame, known: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """One row: edges without source, without target, snapshots whose parent is missing, edges and nodes that don't re-hash.

    known and ends may hold nodes and edges with shorter ids in the place of hashes, for the joins. Edges are counted by end
    before they are joined."""
    ids = (nodes if known is None else known).select(F.col("node_hash").alias("node"))
    ends = edges if ends is None else ends
    sides = F.explode(F.array(F.struct(F.lit(True).alias("source"), F.col("source_hash").alias("node")), F.struct(F.lit(False).alias("source"), F.col("target_hash").alias("node"))))
    counted = ends.select(sides.alias("s")).groupBy("s.source", "s.node").agg(F.count("*").alias("n")).join(ids, "node", "left_anti")
    lost = lambda side: F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0).cast("long"))
    dangling = counted.agg(lost(F.col("source")).alias("dangling_source"), lost(~F.col("source")).alias("dangling_target"))
    chain = snapshots.filter("parent_hash is not null").alias("s").join(snapshots.select(F.col("snapshot_hash").alias("p")), F.col("parent_hash") == F.col("p"), "left_anti").agg(F.count("*").alias("broken_chain"))
    bad = edges.agg(F.count_if(identity.edge_hash(F.col("source_hash"), F.col("target_hash"), F.col("edge_type"), F.col("provenance")) != F.col("edge_hash")).alias("bad_edges"))
    bad_nodes = nodes.agg(F.count_if(identity.node_hash(F.col("repo_url"), F.col("package_path"), F.col("name"), F.col("kind")) != F.col("node_hash")).alias("bad_nodes"))
    return dangling.join(chain).join(bad).join(bad_nodes)


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def repo_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and outgoing edges of each repository."""
    own = nodes.groupBy("repo_url").agg(F.count("*").alias("node_count"))
    out = edges.groupBy("source_hash").agg(F.count("*").alias("n")).join(nodes.select(F.col("node_hash").alias("source_hash"), "repo_url"), "source_hash").groupBy("repo_url").agg(F.sum("n").alias("edge_count"))
    return own.join(out, "repo_url", "left").select("repo_url", "node_count", F.coalesce("edge_count", F.lit(0).cast("long")).alias("edge_count"))


def hotspots(edges: DataFrame) -> DataFrame:
    """Nodes with more incoming edges than the mean of those with any."""
    degree = edges.groupBy("target_hash").agg(F.count("*").alias("in_degree"))
    return degree.join(F.broadcast(degree.agg(F.avg("in_degree").alias("mean")))).filter("in_degree > mean").select("target_hash", "in_degree")


def runtime_by_service(runtime: DataFrame, service: str, route: str | None = None) -> DataFrame:
    found = runtime.filter(F.col("service_name") == service)
    return found if route is None else found.filter(F.col("route_pattern").like(route))


def dead_routes(routes: DataFrame, runtime: DataFrame, before: int) -> DataFrame:
    """Routes with no observed edge, or any that was last seen before `before`."""
    seen = runtime.select("service_name", "route_pattern", "last_observed")
    return routes.join(seen, ["service_name", "route_pattern"], "left").filter(F.col("last_observed").isNull() | (F.col("last_observed") < before)).dropDuplicates(["service_name", "route_pattern"]).select("service_name", "route_pattern")


def age_days(last: Column, now: int) -> Column:
    return (F.lit(now) - last) / DAY


def feedback_report(feedback: DataFrame, least: int) -> DataFrame:
    return feedback.groupBy("symbol_hash").agg(F.sum("useful").alias("useful"), F.count("*").alias("total"), F.countDistinct("session_id").alias("sessions")).filter(F.col("total") >= least).withColumn("rate", F.round(F.col("useful") / F.col("total"), 6))


def majority(votes: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the least."""
    counts = votes.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("b")).select(key, f"b.{value}", "b.n")


def keep_latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert: of each key the row with the largest version."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), version).alias("r")).select(key, "r.*")


def ownership(files: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """path and owner of the last rule (a regular expression) that a path matches; one row an owner."""
    owners = F.lit(None).cast("array<string>")
    for pattern, names in rules:
        owners = F.when(F.col("path").rlike(pattern), F.array(*map(F.lit, names))).otherwise(owners)
    return files.select("path", F.explode(owners).alias("owner"))


def contains_edges(nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Container and member, both ways, by the member's qualified name without its last part."""
    parents = nodes.filter(F.col("kind").isin(*kinds)).select(F.col("node_hash").alias("p"), F.col("qualified_name").alias("pq"))
    found = nodes.select("node_hash", identity.parent_name(F.col("qualified_name")).alias("pq")).join(parents, "pq")
    down = found.select(F.col("p").alias("source_hash"), F.col("node_hash").alias("target_hash"), F.lit("contains").alias("edge_type"))
    return down.unionByName(found.select(F.col("node_hash").alias("source_hash"), F.col("p").alias("target_hash"), F.lit("member_of").alias("edge_type")))


def interface_hints(hints: DataFrame, implements: DataFrame) -> DataFrame:
    """(source, target): hints (source, t) of an interface reach each of its implementors (target, t), each pair once."""
    return hints.distinct().join(implements.distinct(), "t").select("source", "target").distinct()


def co_tested(tests: DataFrame, most: int = 20) -> DataFrame:
    """Pairs of targets (a < b) of one test, of its first `most` targets and pairs, each pair once."""
    ranked = tests.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("test").orderBy("target"))).filter(F.col("rank") <= most)
    pairs = ranked.alias("x").join(ranked.alias("y"), (F.col("x.test") == F.col("y.test")) & (F.col("x.rank") < F.col("y.rank"))).select(F.col("x.test").alias("test"), F.col("x.target").alias("a"), F.col("y.target").alias("b"))
    first = pairs.withColumn("k", F.row_number().over(Window.partitionBy("test").orderBy("a", "b"))).filter(F.col("k") <= most)
    return first.select("a", "b").distinct()


def retarget(edges: DataFrame, nodes: DataFrame, repos: DataFrame) -> DataFrame:
    """Dangling edges whose target is a node's hash under another repository's name; ties to the least node.

    Only dangling targets are joined to, and the candidates are nodes times the few repositories, hashed in place.
    """
    wrong = nodes.join(F.broadcast(repos.select(F.col("repo_url").alias("other")))).filter("other <> repo_url").select(identity.node_hash(F.col("other"), F.col("package_path"), F.col("name"), F.col("kind")).alias("target_hash"), F.col("node_hash").alias("real"))
    return dangling_edges(edges, nodes).join(wrong, "target_hash").groupBy("edge_hash").agg(F.min("real").alias("new_target"))


def similar_pairs(docs: DataFrame, group: str, key: str, tokens: str, least: float) -> DataFrame:
    """Pairs of one group whose token sets overlap more than `least`, through shared tokens and not all pairs.

    Rows of equal sets are a class: classes are compared, and their pairs are expanded to rows at the end, as are the pairs
    within a class. Prefix filtering: two sets of Jaccard over t share one of each other's rarest |x| - ceil(t |x|) + 1 tokens.
    """
    rows = docs.select(group, key, F.sort_array(tokens).alias("set")).filter(F.size("set") > 0).withColumn("c", F.md5(F.array_join("set", "\0").cast("binary")))
    members = cut(rows.select(group, "c", key), "members")
    sets = cut(rows.groupBy(group, "c").agg(F.first("set").alias("set")).withColumn("n", F.size("set")), "sets")
    token = sets.select(group, "c", "n", F.explode("set").alias("t"))
    freq = token.groupBy(group, "t").agg(F.count("*").alias("df"))
    ranked = token.join(freq, [group, "t"]).withColumn("r", F.row_number().over(Window.partitionBy(group, "c").orderBy("df", "t")))
    prefix = cut(ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(group, "c", "n", "t"), "prefix")
    a, b = prefix.alias("a"), prefix.alias("b")
    on = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.c") < F.col("b.c")) & (F.col("b.n") >= F.col("a.n") * least) & (F.col("a.n") >= F.col("b.n") * least)
    cand = a.join(b, on).select(F.col(f"a.{group}").alias(group), F.col("a.c").alias("ca"), F.col("b.c").alias("cb")).distinct()
    left, right = (sets.select(group, F.col("c").alias(f"c{k}"), F.col("set").alias(f"t{k}")) for k in "ab")
    linked = cand.join(left, [group, "ca"]).join(right, [group, "cb"]).withColumn("jaccard", F.round(identity.jaccard(F.col("ta"), F.col("tb")), 6))
    linked = cut(linked.filter(F.col("jaccard") > least).select(group, "ca", "cb", "jaccard"), "linked")
    x, y = (members.select(group, F.col("c").alias(f"c{k}"), F.col(key).alias(f"k{k}")) for k in "ab")
    across = linked.join(x, [group, "ca"]).join(y, [group, "cb"]).filter("ka <> kb").select(F.least("ka", "kb").alias("x"), F.greatest("ka", "kb").alias("y"), "jaccard")
    if least >= 1:
        return across
    within = x.join(y.withColumnRenamed("cb", "ca"), [group, "ca"]).filter("ka < kb").select(F.col("ka").alias("x"), F.col("kb").alias("y"), F.lit(1.0).alias("jaccard"))
    return across.unionByName(within)


def similar_in_groups(docs: DataFrame, group: str, key: str, tokens: str, least: float, most: int = 500) -> DataFrame:
    """similar_pairs with its group, as the reference forms edges of it: sets of three tokens or more, in groups of two to
    `most` of them; larger groups give none there, and so none here."""
    rows = docs.filter(F.size(tokens) >= 3)
    sizes = rows.groupBy(group).agg(F.count("*").alias("size")).filter(F.col("size").between(2, most))
    rows = rows.join(sizes.select(group), group, "left_semi")
    pairs = similar_pairs(rows, group, key, tokens, least)
    return pairs.join(rows.select(F.col(key).alias("x"), F.col(group).alias("grp")), "x").select("grp", "x", "y", "jaccard")


def isolation(calls: DataFrame) -> DataFrame:
    """Score of each file from its inbound edges and dangerous outbound ones; `hooked` raises it by half."""
    quiet = 1 - F.least(F.col("inbound"), F.lit(10)) / 10 * 0.7
    danger = F.least(F.col("outbound"), F.lit(5)) / 5 * F.when(F.col("env_only"), 0.2).otherwise(1.0)
    score = quiet * danger * F.when(F.col("hooked"), 1.5).otherwise(1.0)
    return calls.withColumn("score", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6))


def verdicts(scored: DataFrame, key: str, at: float = 0.3) -> DataFrame:
    """suspicious with two files at the threshold and a tenth of all; review with one; else clean."""
    g = scored.groupBy(key).agg(F.count_if(F.col("score") >= at).alias("flagged"), F.count("*").alias("files"))
    return g.withColumn("verdict", F.when((F.col("flagged") >= 2) & (F.col("flagged") / F.col("files") >= 0.1), "suspicious").when(F.col("flagged") >= 1, "review").otherwise("clean"))


def decay_confidence(runtime: DataFrame, now: int) -> DataFrame:
    c = identity.confidence_of_count(F.col("observation_count"))
    return runtime.withColumn("confidence", identity.decayed(c, age_days(F.col("last_observed"), now)))


def retrieval_metrics(ranked: DataFrame, k: int = 10) -> DataFrame:
    """Precision, recall, NDCG at k and reciprocal rank of each query; ranked: query, rank from 1, relevant 0/1, total."""
    top = F.col("rank") <= k
    gain = F.sum(F.when(top & (F.col("relevant") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    g = ranked.groupBy("query").agg(F.sum(F.when(top, F.col("relevant")).otherwise(0)).alias("hits"), F.max("total").alias("total"), gain.alias("dcg"), F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("total"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return g.select("query", F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.try_divide(F.col("hits"), F.col("total")), 6).alias("recall"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))
