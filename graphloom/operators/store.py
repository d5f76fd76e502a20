"""Lookups, counts and changes of the store's tables. A change is a new table computed from the old one: Spark rewrites
what sources.tables.Store then puts in its place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import identity
from graphloom.functions import predicates as pred

DAY = 86_400


# ---------------------------------------------------------------- lookups


def by_keys(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is among keys: the batched form of every lookup. Missing keys give no row."""
    names = [on] if isinstance(on, str) else on
    return rows.join(keys.select(*names).distinct(), names, "left_semi")


def integers_of(notes: DataFrame, keys: DataFrame, note_key: str) -> DataFrame:
    """object_hash and the whole number noted under note_key; values that are none are passed over."""
    found = by_keys(notes.filter(F.col("note_key") == note_key), keys, "object_hash")
    return found.select("object_hash", F.expr("try_cast(value as int)").alias("number")).filter("number is not null")


def by_provenance(edges: DataFrame, prefix: str) -> DataFrame:
    """Edges whose provenance begins with prefix. A LIKE over `otel_%` takes `_` for any character; so does this."""
    return edges.filter(F.col("provenance").like(prefix + "%"))


def runtime_of(edges: DataFrame, routes: DataFrame, service: str = "", pattern: str = "", most: int = 0) -> DataFrame:
    """Runtime edges onto a service's routes, a row a route, or with a pattern alone onto any matching route, once each.
    `most` takes the first by edge hash."""
    found = by_provenance(edges, "otel_")
    to = routes.withColumnRenamed("node_hash", "target_hash")
    if pattern:
        to = to.filter(F.col("route_pattern").like(pattern))
    if service:
        found = found.join(to.filter(F.col("service_name") == service).select("target_hash", "service_name", "route_pattern"), "target_hash")
    elif pattern:
        found = by_keys(found, to, "target_hash")
    return found.orderBy("edge_hash").limit(most) if most > 0 else found


def snapshot_ref(snapshots: DataFrame, ref: str) -> DataFrame:
    """The snapshot that `@latest`, `@first`, `@prev`, `@N` (N before the latest) or a hash names; ties to the larger id."""
    if not ref.startswith("@"):
        return snapshots.filter(F.col("snapshot_hash") == ref)
    name = "1" if ref == "@prev" else ref[1:]
    if name == "first":
        return snapshots.orderBy("made_at", "id").limit(1)
    if name != "latest" and not name.isdecimal():
        raise ValueError(f"unknown reference {ref}")
    return snapshots.orderBy(F.desc("made_at"), F.desc("id")).offset(0 if name == "latest" else int(name)).limit(1)


# ---------------------------------------------------------------- counts


def table_counts(tables: dict[str, DataFrame], feedback: DataFrame) -> DataFrame:
    """(what, n): rows of each table, and of feedback the total, both marks, symbols, and those bound to a root."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, t in tables.items()]
    f = feedback.agg(
        F.count("*").alias("feedback"), F.count_if(F.col("useful") == 1).alias("useful"), F.count_if(F.col("useful") == 0).alias("not_useful"),
        F.countDistinct("symbol_hash").alias("feedback_symbols"), F.count("neighborhood_root").alias("merkleized"),
    )
    parts.append(f.unpivot([], ["feedback", "useful", "not_useful", "feedback_symbols", "merkleized"], "what", "n"))
    return reduce(DataFrame.unionByName, parts)


def latest_age(snapshots: DataFrame, now: int) -> DataFrame:
    """Seconds since the latest snapshot; of an empty table, since 0."""
    return snapshots.agg((F.lit(now) - F.coalesce(F.max("made_at"), F.lit(0))).cast("long").alias("age"))


def feedback_stats(feedback: DataFrame, by: str | list[str] = "symbol_hash") -> DataFrame:
    """useful, not_useful, total and score of each symbol, or of each cluster (null is one)."""
    names = [by] if isinstance(by, str) else by
    g = feedback.groupBy(*names).agg(F.sum("useful").alias("useful"), F.count("*").alias("total"))
    return g.select(*names, "useful", (F.col("total") - F.col("useful")).alias("not_useful"), "total", F.round(F.col("useful") / F.col("total"), 6).alias("score"))


def weighted(useful: Column, total: Column, mode: str) -> Column:
    """Share of useful marks, drawn to the neutral 0.5 where marks are few: none, linear, asym (only bad ones), sqrt."""
    raw = useful / total
    if mode == "none":
        return raw
    sure = 1 - 1 / (1 + (total if mode == "linear" else F.sqrt(total)))
    drawn = 0.5 + (raw - 0.5) * sure
    return F.when(raw >= 0.5, raw).otherwise(drawn) if mode == "asym" else drawn


def feedback_boosts(feedback: DataFrame, mode: str = "none", roots: DataFrame | None = None, cluster: str | None = None) -> DataFrame:
    """symbol_hash and boost. With roots (symbol_hash, root) marks made under another root no longer count, those under
    none do; with a cluster only its marks count. Symbols without marks that count have no row."""
    if cluster is not None:
        feedback = feedback.filter(F.col("keyword_cluster") == cluster)
    if roots is not None:
        feedback = feedback.join(roots.select("symbol_hash", "root"), "symbol_hash", "left").filter(F.col("neighborhood_root").isNull() | (F.col("neighborhood_root") == F.col("root")))
    g = feedback.groupBy("symbol_hash").agg(F.sum("useful").alias("u"), F.count("*").alias("n"))
    return g.select("symbol_hash", F.round(weighted(F.col("u"), F.col("n"), mode), 6).alias("boost"))


def runtime_stats(edges: DataFrame, now: int) -> DataFrame:
    """(what, n) of runtime edges: all, by type, and overlapping ages; a time of 0 is never stale."""
    rows, last = by_provenance(edges, "otel_"), F.col("last_observed")
    ages = rows.agg(F.count("*").alias("total"), F.count_if(last >= now - 7 * DAY).alias("active"), F.count_if((last > 0) & (last < now - 30 * DAY)).alias("stale"), F.count_if((last > 0) & (last < now - 90 * DAY)).alias("collectable"))
    return ages.unpivot([], ages.columns, "what", "n").unionByName(rows.groupBy(F.concat(F.lit("type:"), "edge_type").alias("what")).agg(F.count("*").alias("n")))


def trace_stats(edges: DataFrame, now: int) -> DataFrame:
    """(bucket, n): whole days since the last sight up to 7, over 90, over 30; days 8 to 30 are in none, as ever."""
    rows, days = by_provenance(edges, "otel_"), F.floor((F.lit(now) - F.col("last_observed")) / DAY)
    bucket = F.when(days <= 7, "active").when(days > 90, "collectable").when(days > 30, "stale")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter("bucket is not null")


def dominant_language(symbols: DataFrame, most: int = 500) -> DataFrame:
    """The language of most of about `most` symbols taken at even steps in order of name; ties to the lesser name.

    The order's places come from counts of ranges, so that no task numbers all rows.
    """
    spark = symbols.sparkSession
    from graphloom.plans.lineage import cut

    ranged = cut(symbols.select("qualified_name").repartitionByRange("qualified_name").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number a partition
    total, begin, at = sum(sizes.values()), [], 0
    for part in sorted(sizes):
        begin.append((part, at))
        at += sizes[part]
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("part").orderBy("qualified_name")) - 1
    rows = ranged.withColumn("k", place).join(F.broadcast(spark.createDataFrame(begin, "part int, begin long")), "part")
    taken = rows.filter((F.col("k") + F.col("begin")) % max(1, total // most) == 0)
    counts = taken.groupBy(pred.language(F.col("qualified_name")).alias("language")).agg(F.count("*").alias("n")).filter("language is not null")
    return counts.orderBy(F.desc("n"), "language").limit(1)


def dangling_classes(edges: DataFrame, nodes: DataFrame, others: DataFrame | None = None, stdlib: tuple[str, ...] = ()) -> DataFrame:
    """(class, n) of edges whose target is unknown: cross_repo if another store has it (others: node_hash), stdlib for what
    is thrown and for imports whose first part is of the library, else truly_dangling."""
    lost = edges.join(nodes.select(F.col("node_hash").alias("target_hash")), "target_hash", "left_anti")
    if others is not None:
        lost = lost.join(others.select(F.col("node_hash").alias("target_hash"), F.lit(True).alias("elsewhere")).distinct(), "target_hash", "left")
    else:
        lost = lost.withColumn("elsewhere", F.lit(None).cast("boolean"))
    where = F.coalesce(F.col("callsite_file"), F.lit("")) if "callsite_file" in edges.columns else F.lit("")
    library = (F.col("edge_type") == "throws") | ((F.col("edge_type") == "imports") & F.substring_index(where, "/", 1).isin(*stdlib)) if stdlib else F.col("edge_type") == "throws"
    return lost.groupBy(F.when(F.col("elsewhere"), "cross_repo").when(library, "stdlib").otherwise("truly_dangling").alias("class")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- snapshots' changes


def diff_added(events: DataFrame, edges: DataFrame, snapshot: str) -> DataFrame:
    """Edges that this snapshot's events added and that are still there."""
    own = events.filter((F.col("snapshot_hash") == snapshot) & (F.col("event_type") == "added")).select("event_id", "edge_hash")
    return own.join(edges, "edge_hash").select("event_id", "edge_hash", "source_hash", "target_hash", "edge_type", "confidence", "provenance")


def diff_removed(events: DataFrame, edges: DataFrame, snapshot: str) -> DataFrame:
    """Edges that its events removed, as the events say or else as the edge still says."""
    own = events.filter((F.col("snapshot_hash") == snapshot) & (F.col("event_type") == "removed"))
    e = edges.select("edge_hash", *(F.col(c).alias("e_" + c) for c in ("source_hash", "target_hash", "edge_type", "confidence", "provenance")))
    j = own.join(e, "edge_hash", "left")
    return j.select(
        "event_id", "edge_hash", F.coalesce("source_hash", "e_source_hash").alias("source_hash"), F.coalesce("target_hash", "e_target_hash").alias("target_hash"),
        F.coalesce("edge_type", "e_edge_type", F.lit("")).alias("edge_type"), F.coalesce("e_confidence", F.lit(1.0)).alias("confidence"), F.coalesce("e_provenance", F.lit("unknown")).alias("provenance"),
    )


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the qualified names of their ends, null where there is no node."""
    n = nodes.select("node_hash", "qualified_name")
    out = edges.join(n.toDF("source_hash", "source_name"), "source_hash", "left")
    return out.join(n.toDF("target_hash", "target_name"), "target_hash", "left")


def modified_nodes(added: DataFrame, removed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sources of changed edges: node_hash, qualified_name (empty if unknown), how many edges came and went."""
    rows = added.select("source_hash", F.lit(1).alias("a"), F.lit(0).alias("r")).unionByName(removed.select("source_hash", F.lit(0).alias("a"), F.lit(1).alias("r")))
    g = rows.groupBy(F.col("source_hash").alias("node_hash")).agg(F.sum("a").alias("edges_added"), F.sum("r").alias("edges_removed"))
    return g.join(nodes.select("node_hash", "qualified_name"), "node_hash", "left").withColumn("qualified_name", F.coalesce("qualified_name", F.lit("")))


# ---------------------------------------------------------------- changes


def upsert(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """base with rows in place of those of the same key; of several new rows of a key the greatest stays."""
    rest = [c for c in base.columns if c not in keys]
    new = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*base.columns)
    return base.join(new.select(*keys), keys, "left_anti").select(*base.columns).unionByName(new)


def append_events(base: DataFrame, rows: DataFrame) -> DataFrame:
    return base.unionByName(rows, allowMissingColumns=True)


def count_up(base: DataFrame, seen: DataFrame, keys: list[str], count: str, last: str) -> DataFrame:
    """base with each key's sightings added to its count and its last time moved on; new keys begin."""
    both = base.select(*keys, count, last).unionByName(seen.select(*keys, F.lit(1).cast(base.schema[count].dataType).alias(count), last))
    return both.groupBy(*keys).agg(F.sum(count).cast("long").alias(count), F.max(last).alias(last))


def update(base: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with columns set as rows say for their keys; other rows, and keys that base lacks, stay as they are."""
    new = rows.dropDuplicates([key]).select(key, *(F.col(c).alias("new_" + c) for c in columns), F.lit(True).alias("hit"))
    j = base.join(new, key, "left")
    return j.select(*(F.when(F.col("hit"), F.col("new_" + c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def decay(edges: DataFrame, now: int) -> DataFrame:
    """Runtime edges seen last over 30 days ago (and seen at all) fall to confidence 0.2."""
    old = F.col("provenance").like("otel_%") & (F.col("last_observed") > 0) & (F.col("last_observed") < now - 30 * DAY) & (F.col("confidence") > 0.2)
    return edges.withColumn("confidence", F.when(old, 0.2).otherwise(F.col("confidence")))


def delete_keys(base: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return base.join(keys.select(on).distinct(), on, "left_anti")


def keep_keys(base: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return base.join(keys.select(on).distinct(), on, "left_semi")


def delete_by_source_file(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Edges without those whose source lies in one of the files."""
    gone = by_keys(nodes, files, "file_hash").select(F.col("node_hash").alias("source_hash"))
    return delete_keys(edges, gone, "source_hash")


def evict(tables: dict[str, DataFrame], repo_hash: str) -> dict[str, DataFrame]:
    """The store without one repository: its files, their nodes, and what hangs on those nodes, and its snapshots."""
    files = tables["files"].filter(F.col("repo_hash") == repo_hash).select("file_hash")
    nodes = by_keys(tables["nodes"], files, "file_hash").select("node_hash")
    own = {"edges": ("source_hash", "target_hash"), "edge_events": ("source_hash", "target_hash"), "feedback": ("symbol_hash",), "task_memory": ("symbol_hash",), "notes": ("object_hash",)}
    out = dict(tables)
    for name, columns in own.items():
        if name in out:
            for c in columns:
                out[name] = delete_keys(out[name], nodes.withColumnRenamed("node_hash", c), c)
    out["nodes"] = delete_keys(tables["nodes"], files, "file_hash")
    for name in ("files", "snapshots"):
        if name in out:
            out[name] = tables[name].filter(~F.equal_null(F.col("repo_hash"), F.lit(repo_hash)))
    return out


def reachable(edges: DataFrame, nodes: DataFrame, repo_url: str) -> tuple[DataFrame, DataFrame]:
    """What a sweep keeps: nodes named of a repository, edges from them, and those edges' ends."""
    own = nodes.filter(F.col("qualified_name").startswith(repo_url)).select("node_hash")
    kept = by_keys(edges, own.withColumnRenamed("node_hash", "source_hash"), "source_hash")
    ends = kept.select(F.col("source_hash").alias("node_hash")).unionByName(kept.select(F.col("target_hash").alias("node_hash")))
    return own.unionByName(ends).distinct(), kept.select("edge_hash").distinct()


def real_nodes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """How many nodes lie in a known file."""
    return by_keys(nodes, files, "file_hash").agg(F.count("*").alias("n"))


def incoming_confidence(edges: DataFrame) -> DataFrame:
    """Of each target the best confidence of its edges, 0.5 at least, and when any was last observed."""
    return edges.groupBy("target_hash").agg(F.greatest(F.max("confidence"), F.lit(0.5)).alias("confidence"), F.max("last_observed").alias("last_observed"))


def learned(vocab: DataFrame, words: list[str], least: int, roots: DataFrame | None = None) -> DataFrame:
    """Associations of the words seen `least` times or more. With roots (symbol_hash, root) those made under another root
    of a symbol that still has one are passed over."""
    found = vocab.filter(F.col("keyword").isin(*words) & (F.col("seen") >= least))
    if roots is not None:
        found = found.join(roots.select("symbol_hash", "root"), "symbol_hash", "left").filter(F.col("subgraph_root").isNull() | F.col("root").isNull() | (F.col("root") == F.col("subgraph_root")))
    weight = 0.3 + 0.5 * F.least(F.greatest((F.col("seen") - 2) / 8, F.lit(0.0)), F.lit(1.0))
    return found.select("keyword", "symbol_name", "symbol_hash", "seen", F.round(weight, 6).alias("weight"))


# ---------------------------------------------------------------- derived edges


def inherits(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each `extends` edge onto a known type, edges to the methods of the type of that name, by names alone: of
    several types of a name the one with the largest hash stands for it."""
    name = F.substring_index("qualified_name", ".", -1)
    types = nodes.filter("kind = 'type'").groupBy(name.alias("owner")).agg(F.max("node_hash").alias("target_hash"))
    owner = F.regexp_extract("qualified_name", r"([^.]*)\.[^.]*$", 1)
    methods = nodes.filter("kind = 'method'").select(owner.alias("owner"), F.col("node_hash").alias("method"))
    found = edges.filter("edge_type = 'extends'").select("source_hash", "target_hash").join(types, "target_hash").join(methods, "owner")
    found = found.select("source_hash", F.col("method").alias("target_hash")).distinct()
    return _made(found, "inherits", "ast_resolved", 0.9)


def _made(pairs: DataFrame, kind: str, provenance: str, confidence: float) -> DataFrame:
    h = identity.edge_hash(F.col("source_hash"), F.col("target_hash"), F.lit(kind), F.lit(provenance))
    return pairs.select(h.alias("edge_hash"), "source_hash", "target_hash", F.lit(kind).alias("edge_type"), F.lit(confidence).alias("confidence"), F.lit(provenance).alias("provenance"))


def overrides(implements: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges from a type's method to the like-named one of the type that it implements; implements: impl, iface; methods:
    owner, name, node_hash."""
    a = methods.select(F.col("owner").alias("impl"), "name", F.col("node_hash").alias("source_hash"))
    b = methods.select(F.col("owner").alias("iface"), "name", F.col("node_hash").alias("target_hash"))
    found = implements.select("impl", "iface").distinct().filter("impl <> iface").join(a, "impl").join(b, ["iface", "name"])
    return _made(found.select("source_hash", "target_hash").distinct(), "overrides", "structural", 0.9)


def hints_retargeted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dangling type hints whose target is a known symbol's hash as of kind `type` while it is of another kind: old_hash
    and the edge onto the real one."""
    typed = nodes.filter(F.col("kind").isin("type", "interface", "trait", "class", "struct")).select(
        identity.node_hash(F.col("repo_url"), F.col("package_path"), F.col("name"), F.lit("type")).alias("target_hash"), F.col("node_hash").alias("real"))
    typed = typed.filter("target_hash <> real").groupBy("target_hash").agg(F.min("real").alias("real"))
    lost = edges.filter("edge_type = 'type_hint_of'").join(nodes.select(F.col("node_hash").alias("target_hash")), "target_hash", "left_anti")
    found = lost.join(typed, "target_hash").select(F.col("edge_hash").alias("old_hash"), "source_hash", F.col("real").alias("target_hash"))
    return found.join(_made(found, "type_hint_of", "type_hint_resolved", 0.8).distinct(), ["source_hash", "target_hash"]).select("old_hash", "edge_hash", "source_hash", "target_hash", "edge_type", "confidence", "provenance")


def owned(files: DataFrame, rules: DataFrame) -> DataFrame:
    """path and owner of the last rule that a path matches, a row an owner. rules: line, regex, owners: a small table, as
    a CODEOWNERS file is; it is counted before it is broadcast."""
    few = rules.limit(100_001).count() <= 100_000
    hit = files.select("path").distinct().join(F.broadcast(rules) if few else rules, F.expr("path rlike regex"))
    return hit.groupBy("path").agg(F.max_by("owners", "line").alias("owners")).select("path", F.explode("owners").alias("owner"))


def isolation_of(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Of each changed file that is no test: edges in from unchanged nodes, dangerous ones out, and the score.

    Reading the environment and running a process are dangerous, but not a well-known process; a process of another or
    unknown name is a hook.
    """
    own = by_keys(nodes, changed, "file_hash").select("node_hash", "file_hash", "qualified_name")
    path = own.groupBy("file_hash").agg(F.min("qualified_name").alias("file"))
    inside = own.select(F.col("node_hash").alias("source_hash"))
    into = edges.join(inside, "source_hash", "left_anti").join(own.select(F.col("node_hash").alias("target_hash"), "file_hash"), "target_hash").groupBy("file_hash").agg(F.count("*").alias("inbound"))
    out = edges.filter(F.col("edge_type").isin("reads_env", "executes_process")).join(own.select(F.col("node_hash").alias("source_hash"), "file_hash"), "source_hash")
    out = out.join(nodes.select(F.col("node_hash").alias("target_hash"), F.col("qualified_name").alias("to")), "target_hash", "left")
    env, good = F.col("edge_type") == "reads_env", pred.benign_process(F.coalesce("to", F.lit("")))
    proc = (F.col("edge_type") == "executes_process") & ~good
    out = out.groupBy("file_hash").agg(F.count_if(env | proc).alias("outbound"), F.count_if(env & F.col("to").isNotNull()).alias("env"), F.count_if(proc & F.col("to").isNotNull()).alias("named"), F.count_if(proc).alias("procs"))
    rows = path.filter(~pred.supply_test(F.col("file"))).join(into, "file_hash", "left").join(out, "file_hash", "left").fillna(0)
    quiet = 1 - F.least(F.col("inbound"), F.lit(10)) / 10 * 0.7
    danger = F.least(F.col("outbound"), F.lit(5)) / 5 * F.when((F.col("env") > 0) & (F.col("named") == 0), 0.2).otherwise(1.0)
    score = F.least(quiet * danger * F.when(F.col("procs") > 0, 1.5).otherwise(1.0), F.lit(1.0))
    return rows.select("file", "inbound", "outbound", (F.col("procs") > 0).alias("hooked"), F.round(score, 6).alias("score"))


def capability_pairs(edges: DataFrame) -> DataFrame:
    """Of each source the variables it reads with the processes it runs, every two: as many as a file names, no more."""
    of = lambda kind, name: edges.filter(F.col("edge_type") == kind).select("source_hash", F.col("target_hash").alias(name)).distinct()
    return of("reads_env", "env").join(of("executes_process", "process"), "source_hash")


def similar_capped(pairs: DataFrame, most: int = 5):
    """Pairs (grp, x, y, jaccard) best first, none whose end has `most` already: in order, so a group at a time (groups
    hold 500 nodes at most, since similar_pairs passes over larger ones as it should)."""
    import pandas as pd

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["jaccard", "x", "y"], ascending=[False, True, True], kind="stable")
        used: dict = {}
        keep = []
        for x, y in zip(pdf["x"], pdf["y"], strict=True):
            ok = used.get(x, 0) < most and used.get(y, 0) < most
            keep.append(ok)
            if ok:
                used[x], used[y] = used.get(x, 0) + 1, used.get(y, 0) + 1
        return pdf[keep]

    return pairs.groupBy("grp").applyInPandas(take, pairs.schema)
