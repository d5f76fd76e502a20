"""A store on shared storage: each table a folder of versions, a version a folder of Parquet files that Spark committed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables and their columns, as created when a store is opened.
SCHEMAS = {
    "repos": "repo_hash string, repo_url string, last_commit string, last_indexed long",
    "files": "file_hash string, repo_hash string, path string, content_hash string",
    "nodes": "node_hash string, file_hash string, qualified_name string, kind string, line int, signature string, doc string, last_author string, last_commit_at long, coverage_pct double, indexed_at long",
    "edges": "edge_hash string, source_hash string, target_hash string, edge_type string, confidence double, provenance string, callsite_line int, callsite_col int, callsite_file string, observation_count long, last_observed long, indexed_at long",
    "edge_events": "event_id long, edge_hash string, event_type string, snapshot_hash string, source_commit string, timestamp long, source_hash string, target_hash string, edge_type string, confidence double, provenance string",
    "snapshots": "snapshot_hash string, parent_hash string, repo_hash string, commit_hash string, timestamp long, node_count long, edge_count long, generation int",
    "route_symbols": "service_name string, route_pattern string, node_hash string, mapping_type string, created_at long",
    "feedback": "id long, symbol_hash string, session_id string, useful int, timestamp long, neighborhood_root string, keyword_cluster string",
    "task_memory": "id long, keywords string, symbol_hash string, score double, timestamp long",
    "notes": "object_hash string, note_key string, value string, updated_at long",
    "vocab": "keyword string, symbol_name string, symbol_hash string, seen long, last_seen long, subgraph_root string",
    "embeddings": "node_hash string, model string, vector array<float>",
}
KEYS = {"repos": ["repo_hash"], "files": ["file_hash"], "nodes": ["node_hash"], "edges": ["edge_hash"], "snapshots": ["snapshot_hash"], "route_symbols": ["service_name", "route_pattern", "mapping_type"], "notes": ["object_hash", "note_key"], "vocab": ["keyword", "symbol_hash"], "embeddings": ["node_hash", "model"]}


class Store:
    """Reads see the last whole version; a change writes the next one and never the one that is read. One writer a table:
    a version that is there already makes a second writer fail."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path
        for name, schema in SCHEMAS.items():
            if not self.versions(name):
                self.write(name, spark.createDataFrame([], schema))

    def versions(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return []
        found = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(x[1:]) for x in found if x[0] == "v" and self._fs.exists(self._path(f"{self.root}/{name}/{x}/_SUCCESS")))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        at = self.versions(name)[-1] if version is None else version
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/v{at}")

    def write(self, name: str, rows: DataFrame) -> int:
        have = [x[0] for x in SCHEMAS[name].replace(", ", "\n").split("\n") for x in [x.split(" ")]]
        number = (self.versions(name) or [0])[-1] + 1
        rows.select(*have).write.mode("error").parquet(f"{self.root}/{name}/v{number}")
        return number

    def change(self, name: str, how: Callable[[DataFrame], DataFrame]) -> int:
        return self.write(name, how(self.read(name)))

    def put(self, name: str, rows: DataFrame) -> int:
        """Upsert by the table's key; events and marks, which have none, are appended."""
        from graphloom.operators import store

        keys = KEYS.get(name)
        return self.change(name, lambda base: store.upsert(base, rows.select(*base.columns), keys) if keys else base.unionByName(rows.select(*base.columns)))

    def truncate(self, *names: str) -> None:
        for name in names or ("nodes", "edges", "files", "edge_events", "snapshots"):
            self.write(name, self.spark.createDataFrame([], SCHEMAS[name]))

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Remove all but the last `keep` versions; how many went."""
        old = self.versions(name)[: -max(1, keep)]
        for v in old:
            self._fs.delete(self._path(f"{self.root}/{name}/v{v}"), True)
        return len(old)
