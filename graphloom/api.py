"""The tools that an agent or a person calls, by name, over one store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import identity
from graphloom.functions import text as T
from graphloom.operators import communities as com
from graphloom.operators import context as ctx
from graphloom.operators import iterative, merkle, relational, search
from graphloom.operators import store as ops
from graphloom.plans.lineage import cut
from graphloom.sources import code
from graphloom.sources.tables import Store

DAY = 86_400


class Engine:
    """Tools over a store at `root`. Each returns a table, but for proofs and plans, which are single values."""

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], int]):
        self.spark, self.now, self.store = spark, now, Store(spark, root)
        self._index: tuple[int, search.Index] | None = None

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def tools(self) -> list[str]:
        hidden = {"table", "tools", "call", "text_index"}
        return sorted(n for n in dir(self) if not n.startswith("_") and callable(getattr(self, n)) and n not in hidden)

    def call(self, tool: str, **arguments):
        if tool not in self.tools():
            raise ValueError(f"unknown tool {tool}")
        return getattr(self, tool)(**arguments)

    def _named(self, symbol: str) -> DataFrame:
        return self.table("nodes").filter(F.col("qualified_name") == symbol).select(F.col("node_hash").alias("start"))

    def _calls(self) -> DataFrame:
        return self.table("edges").filter("edge_type = 'calls'")

    def _with_repo(self) -> DataFrame:
        return self.table("nodes").withColumn("repo_url", F.substring_index("qualified_name", "://", 1))

    # ---------------------------------------------------------------- indexing

    def index_repo(self, repo_url: str, path: str, commit: str = "") -> DataFrame:
        """Index a tree: unchanged files are kept, others' symbols and edges replaced, events and a snapshot written; its row."""
        repo_hash = self.spark.range(1).select(F.sha2(F.lit(repo_url), 256)).first()[0]
        old_files = cut(self.table("files").filter(F.col("repo_hash") == repo_hash), "old")
        tree = cut(code.walk(self.spark, path), "tree")
        new = {k: cut(v, k) for k, v in code.index(tree, repo_url, old_files).items()}
        gone = cut(old_files.join(tree.select("path", "content_hash"), ["path", "content_hash"], "left_anti").select("file_hash"), "gone")
        nodes, edges, now = self.table("nodes"), self.table("edges"), self.now()
        lost = cut(ops.by_keys(edges, ops.by_keys(nodes, gone, "file_hash").withColumnRenamed("node_hash", "source_hash"), "source_hash"), "lost")
        fill = lambda df, like, **more: df.select(*(more[c].alias(c) if c in more else F.col(c) if c in df.columns else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns))
        left = cut(ops.delete_keys(edges, lost, "edge_hash"), "left")
        self.store.write("edges", ops.upsert(left, fill(new["edges"], edges, observation_count=F.lit(0).cast("long"), last_observed=F.lit(0).cast("long"), indexed_at=F.lit(now).cast("long")), ["edge_hash"]))
        self.store.write("nodes", ops.upsert(ops.delete_keys(nodes, gone, "file_hash"), fill(new["nodes"], nodes, coverage_pct=F.lit(-1.0), indexed_at=F.lit(now).cast("long"), last_commit_at=F.lit(0).cast("long")), ["node_hash"]))
        self.store.write("files", ops.delete_keys(self.table("files"), gone, "file_hash").unionByName(new["files"]))
        self.store.put("repos", self.spark.createDataFrame([(repo_hash, repo_url, commit, now)], "repo_hash string, repo_url string, last_commit string, last_indexed long"))
        own = self.table("nodes").filter(F.col("qualified_name").startswith(repo_url + "://")).select(F.col("node_hash").alias("source_hash"), identity.package_of(F.col("qualified_name")).alias("package_path"))
        inputs = cut(self.table("edges").join(own, "source_hash").select("edge_hash", "edge_type", "source_hash", "target_hash", F.coalesce("package_path", F.lit("")).alias("package_path")), "inputs")
        snaps = self.table("snapshots").filter(F.col("repo_hash") == repo_hash).withColumn("made_at", F.col("timestamp"))
        row = cut(merkle.snapshot_row(inputs, snaps, repo_hash, now), "snapshot")
        listed = row.select("snapshot_hash", "parent_hash", "repo_hash", F.lit(commit).alias("commit_hash"), F.col("made_at").cast("long").alias("timestamp"), "node_count", "edge_count", "generation")
        self.store.put("snapshots", listed)
        snap = row.first()["snapshot_hash"]
        added = ops.delete_keys(new["edges"], edges, "edge_hash")
        events = self.table("edge_events")
        said = lambda df, what: fill(df.select("edge_hash", "source_hash", "target_hash", "edge_type", "confidence", "provenance"), events, event_type=F.lit(what), snapshot_hash=F.lit(snap), source_commit=F.lit(commit), timestamp=F.lit(now).cast("long"), event_id=F.xxhash64("edge_hash", F.lit(snap), F.lit(what)))
        self.store.write("edge_events", events.unionByName(said(added, "added")).unionByName(said(ops.delete_keys(lost, new["edges"], "edge_hash"), "removed")))
        return listed

    def untrack_repo(self, repo_url: str) -> DataFrame:
        """Forget a repository and all that hangs on it; rows left in each table."""
        h = self.spark.range(1).select(F.sha2(F.lit(repo_url), 256)).first()[0]
        names = ("files", "nodes", "edges", "edge_events", "feedback", "task_memory", "notes", "snapshots")
        for name, rows in ops.evict({n: self.table(n) for n in names}, h).items():
            self.store.write(name, cut(rows, "kept"))
        self.store.change("repos", lambda r: cut(r.filter(F.col("repo_hash") != h), "kept"))
        return ops.table_counts({n: self.table(n) for n in names}, self.table("feedback"))

    # ---------------------------------------------------------------- graph

    def cross_repo_callers(self, symbol: str) -> DataFrame:
        return iterative.closure(self._calls(), self._named(symbol), 5, reverse=True).join(self._with_repo().select(F.col("node_hash").alias("node"), "qualified_name", "repo_url"), "node")

    def graph_query(self, pattern: str) -> DataFrame:
        return relational.name_search(self.table("nodes"), pattern).orderBy("qualified_name")

    def repo_graph(self, repo_url: str) -> DataFrame:
        return self.table("files").filter(F.col("repo_hash") == F.sha2(F.lit(repo_url), 256)).orderBy("path")

    def blast_radius(self, symbol: str) -> DataFrame:
        return iterative.blast_radius(iterative.closure(self._calls(), self._named(symbol), 5, reverse=True), self._with_repo())

    def trace_dataflow(self, symbol: str, depth: int = 5) -> DataFrame:
        return iterative.closure(self._calls(), self._named(symbol), depth)

    def stale_edges(self) -> DataFrame:
        return relational.stale_edges(self.table("edges"), self.table("nodes"), self.table("files"))

    def flow_between(self, source: str, target: str) -> DataFrame:
        ends = [self._named(x).first() for x in (source, target)]
        if None in ends:
            raise ValueError("no such symbol")
        return iterative.paths(self.table("edges"), ends[0]["start"], ends[1]["start"])

    def test_scope(self, files: list[str], repo_url: str, depth: int = 3) -> DataFrame:
        """Test functions that reach a symbol of the files in so many calls, by name, with their path."""
        own = self.table("files").filter((F.col("repo_hash") == F.sha2(F.lit(repo_url), 256)) & F.col("path").isin(files))
        start = ops.by_keys(self.table("nodes"), own, "file_hash").select(F.col("node_hash").alias("start"))
        near = iterative.reached(self._calls(), start, depth, reverse=True)
        from graphloom.functions.predicates import test_function

        tests = self.table("nodes").filter(test_function(F.col("kind"), F.col("qualified_name")))
        found = tests.join(near.withColumnRenamed("node", "node_hash"), "node_hash", "left_semi")
        return found.join(self.table("files").select("file_hash", "path"), "file_hash", "left").select("qualified_name", "path").orderBy("qualified_name")

    def communities(self, algorithm: str = "louvain") -> DataFrame:
        calls = self._calls().select(F.col("source_hash").alias("u"), F.col("target_hash").alias("v")).distinct()
        nodes = self.table("nodes")
        known = ops.by_keys(ops.by_keys(calls, nodes.select(F.col("node_hash").alias("u")), "u"), nodes.select(F.col("node_hash").alias("v")), "v")
        ids = cut(nodes.select("node_hash", F.xxhash64("node_hash").alias("n")), "ids")
        e = cut(known.join(ids.toDF("u", "a"), "u").join(ids.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1.0).alias("w")), "numbers")
        members = cut(com.detect(e, algorithm).join(ids, F.col("node") == F.col("n")).select("node_hash", "community"), "members")
        named = nodes.select("node_hash", "qualified_name", F.coalesce(identity.package_of(F.col("qualified_name")), F.lit("")).alias("package"))
        return com.describe(named, members, cut(known.select("u", "v"), "known"))

    # ---------------------------------------------------------------- snapshots

    def snapshot_diff(self, snapshot: str) -> DataFrame:
        events, edges = self.table("edge_events"), self.table("edges")
        a, b = ops.diff_added(events, edges, snapshot), ops.diff_removed(events, edges, snapshot)
        return a.withColumn("change", F.lit("added")).unionByName(b.withColumn("change", F.lit("removed")))

    def semantic_diff(self, snapshot: str) -> DataFrame:
        return ops.named_edges(self.snapshot_diff(snapshot), self.table("nodes"))

    def pr_impact(self, snapshot: str) -> DataFrame:
        """Changed symbols, callers (five calls), callees (three) and edges of a snapshot's changes, and the risk."""
        changes = cut(self.snapshot_diff(snapshot), "changes")
        start = cut(ops.by_keys(self.table("nodes"), changes.select(F.col("source_hash").alias("node_hash")), "node_hash").select(F.col("node_hash").alias("start")), "start")
        up, down = (iterative.reached(self._calls(), start, n, reverse=r).agg(F.count("*").alias(c)) for n, r, c in ((5, True, "callers"), (3, False, "callees")))
        out = start.agg(F.countDistinct("start").alias("symbols")).join(up).join(down).join(changes.agg(F.count("*").alias("edges")))
        return out.withColumn("risk", identity.confidence_bucket(F.col("callers")))

    def _inputs(self) -> DataFrame:
        package = F.coalesce(identity.package_of(F.col("qualified_name")), F.lit(""))
        own = self.table("nodes").select(F.col("node_hash").alias("source_hash"), package.alias("package_path"))
        return cut(self.table("edges").join(own, "source_hash").select("edge_hash", "package_path", "edge_type"), "inputs")

    def prove(self, edge_hash: str, package: str, edge_type: str) -> dict:
        return merkle.prove(self._inputs(), edge_hash, package, edge_type)

    def prove_absent(self, edge_hash: str, package: str, edge_type: str) -> dict:
        return merkle.prove_absence(self._inputs(), edge_hash, package, edge_type)

    def fsck(self) -> DataFrame:
        return ops.dangling_classes(self.table("edges"), self.table("nodes"))

    # ---------------------------------------------------------------- owners, traffic

    def ownership(self, repo_url: str) -> DataFrame:
        """Files with how many symbols each has, and their authors."""
        f = self.repo_graph(repo_url).select("file_hash", "path").join(self.table("nodes").select("file_hash", "node_hash", "last_author"), "file_hash", "left")
        return f.groupBy("path").agg(F.count("node_hash").alias("symbols"), F.sort_array(F.collect_set("last_author")).alias("authors")).orderBy("path")

    def ownership_query(self, symbol: str) -> DataFrame:
        n = self.table("nodes").select("node_hash", "file_hash", "qualified_name")
        own = n.filter(F.col("qualified_name") == symbol)
        e = self.table("edges").filter(F.col("edge_type").isin("owned_by", "authored_by"))
        to = n.select(F.col("node_hash").alias("target_hash"), F.col("qualified_name").alias("name"))
        keys = own.select(F.col("node_hash").alias("source_hash")).unionByName(own.select(F.col("file_hash").alias("source_hash")))
        return ops.by_keys(e, keys, "source_hash").join(to, "target_hash").select("edge_type", "name").distinct()

    def runtime_traffic(self, service: str, pattern: str = "") -> DataFrame:
        return ops.runtime_of(self.table("edges"), self.table("route_symbols"), service, pattern, 100)

    def dead_routes(self, days: int = 30) -> DataFrame:
        """Routes onto whose symbol no runtime edge was seen in so many days, or ever."""
        since = self.now() - days * DAY
        seen = ops.by_provenance(self.table("edges"), "otel_").select(F.col("target_hash").alias("node_hash"), "last_observed")
        j = self.table("route_symbols").join(seen, "node_hash", "left").filter(F.col("last_observed").isNull() | (F.col("last_observed") < since))
        return j.dropDuplicates(["service_name", "route_pattern", "mapping_type"]).drop("last_observed")

    def trace_stats(self) -> DataFrame:
        return ops.runtime_stats(self.table("edges"), self.now())

    # ---------------------------------------------------------------- context

    def text_index(self) -> search.Index:
        """Built anew when the symbols changed."""
        version = self.store.versions("nodes")[-1]
        if self._index is None or self._index[0] != version:
            self._index = (version, search.Index(search.documents(self.table("nodes"), self.table("files")), "node_hash"))
        return self._index[1]

    def _tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in ("nodes", "files", "edges")}

    def context_for_task(self, task: str, budget: int = 4000, repo_url: str = "", classes: list[dict] = (), thesaurus: dict | None = None) -> DataFrame:
        words = T.keywords(task).all
        learned = ops.learned(self.table("vocab"), [w.lower() for w in words], 2)
        return ctx.context_for_task(task, self._tables(), self.text_index(), budget, self.now(), repo_url, classes, thesaurus, boosts=ops.feedback_boosts(self.table("feedback")), vocab=learned)

    def context_for_files(self, files: list[str], repo_url: str, budget: int = 50_000) -> DataFrame:
        """The files' symbols and their direct callers, ranked and packed."""
        own = ops.by_keys(self.table("nodes"), self.repo_graph(repo_url).filter(F.col("path").isin(files)), "file_hash").select("node_hash")
        calls = ops.by_keys(self._calls(), own.withColumnRenamed("node_hash", "target_hash"), "target_hash")
        direct = calls.groupBy(F.col("target_hash").alias("node_hash")).agg(F.count("*").alias("callers"), F.greatest(F.max("confidence"), F.lit(0.5)).alias("confidence"), F.max("last_observed").alias("last_observed"))
        mine = own.join(direct, "node_hash", "left").select("node_hash", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "last_observed", F.lit(0).alias("distance"))
        others = calls.groupBy(F.col("source_hash").alias("node_hash")).agg(F.lit(0).cast("long").alias("callers"), F.max("confidence").alias("confidence"), F.max("last_observed").alias("last_observed")).withColumn("distance", F.lit(1))
        rows = mine.unionByName(others.join(own, "node_hash", "left_anti")).join(self.table("nodes"), "node_hash")
        rows = cut(rows.withColumns({"symbol": F.col("node_hash"), "feedback": F.lit(0.0), "session": F.lit(0.0), "is_test": F.lit(False)}), "inputs")
        ranked = ctx.rank(rows, self.now())
        cost = ctx.token_cost(F.col("qualified_name"), F.col("kind"), F.coalesce("signature", F.lit("")))
        wide = rows.select("symbol", "qualified_name", "distance", F.col("file_hash").alias("file"), cost.alias("cost"), F.lit(1.0).alias("rwr"), F.lit(False).alias("external")).join(ranked.select("symbol", "score"), "symbol")
        return ctx.pack(wide, budget).select("symbol", "score", "cost").join(wide.select("symbol", "qualified_name", "distance"), "symbol").orderBy(F.desc("score"), "symbol")

    def context_for_pr(self, snapshot: str, budget: int = 8000) -> DataFrame:
        """What a walk from a snapshot's changed symbols reaches (scores of 0.05 and more), packed."""
        changed = cut(self.snapshot_diff(snapshot).select(F.col("source_hash").alias("node_hash")).distinct(), "changed")
        n = max(1, changed.count())
        near = cut(ctx.bounded(self.table("edges"), self.table("nodes"), changed), "near")
        scores = ctx.walk(near, changed.select(F.col("node_hash").alias("node"), F.lit(1.0 / n).alias("s"))).filter("score >= 0.05")
        rows = scores.withColumnRenamed("node", "node_hash").join(self.table("nodes"), "node_hash")
        cost = ctx.token_cost(F.col("qualified_name"), F.col("kind"), F.coalesce("signature", F.lit("")))
        wide = cut(rows.select(F.col("node_hash").alias("symbol"), F.col("file_hash").alias("file"), "score", cost.alias("cost"), F.col("score").alias("rwr"), F.lit(False).alias("external"), "qualified_name"), "wide")
        return ctx.pack(wide, budget).select("symbol", "score", "cost").join(wide.select("symbol", "qualified_name"), "symbol").orderBy(F.desc("score"), "symbol")

    def explain_symbol(self, symbol: str, task: str) -> DataFrame:
        """Where a symbol stands in each channel for a task: (channel, rank), rank null where it does not."""
        node = self._named(symbol).first()
        if node is None:
            raise ValueError("no such symbol")
        asked, nodes = T.keywords(task), self.table("nodes")
        channels = {"tiered": search.tiered(nodes, asked.primary, asked.components), "bm25": self.text_index().search(T.text_query(asked, T.path_terms(task)), 200)}
        rows = []
        for name, c in channels.items():
            hit = c.filter(F.col("node_hash") == node["start"]).first()
            rows.append((name, hit["rank"] if hit else None))
        return self.spark.createDataFrame(rows, "channel string, rank int")

    def feedback(self, marks: DataFrame | None = None) -> DataFrame:
        """Record marks (symbol_hash, session_id, useful, and, if known, neighborhood_root, keyword_cluster); the report."""
        if marks is not None:
            base = self.table("feedback")
            now = F.lit(self.now()).cast("long")
            more = marks.withColumns({c: F.lit(None).cast("string") for c in ("neighborhood_root", "keyword_cluster") if c not in marks.columns})
            self.store.write("feedback", base.unionByName(more.withColumns({"timestamp": now, "id": F.xxhash64("symbol_hash", "session_id", now), "useful": F.col("useful").cast("int")}).select(*base.columns)))
        return ops.feedback_stats(self.table("feedback"))

    def plan_turn(self, task: str) -> list[str]:
        return T.plan(task)

    # ---------------------------------------------------------------- reports

    def report(self) -> DataFrame:
        return ops.table_counts({n: self.table(n) for n in ("nodes", "edges", "files", "repos", "snapshots", "notes")}, self.table("feedback"))

    def schema(self) -> DataFrame:
        return self.spark.createDataFrame([(t, f.name, f.dataType.simpleString()) for t in ("nodes", "edges", "files", "repos", "snapshots", "notes", "feedback") for f in self.table(t).schema], "table string, column string, type string")

    def export(self, path: str, form: str = "json") -> None:
        """Nodes and edges as JSON lines, or the whole as one graph in DOT's language by partitions of text."""
        if form == "json":
            self.table("nodes").write.json(path + "/nodes")
            self.table("edges").write.json(path + "/edges")
        elif form == "dot":
            quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
            n = self.table("nodes").select(F.concat(F.lit("  "), quote("node_hash"), F.lit(" [label="), quote("qualified_name"), F.lit("];")).alias("value"))
            e = self.table("edges").select(F.concat(F.lit("  "), quote("source_hash"), F.lit(" -> "), quote("target_hash"), F.lit(" [label="), quote("edge_type"), F.lit("];")).alias("value"))
            n.unionByName(e).write.text(path)
        else:
            raise ValueError("json or dot")

    def audit(self) -> DataFrame:
        """The compliance report as rows: (what, n) of tables, integrity, and runtime ages."""
        return self.report().unionByName(self.fsck().select(F.concat(F.lit("dangling:"), "class").alias("what"), "n")).unionByName(self.trace_stats())
