"""The store's versions, the tools over an indexed tree, sources, and streams into a store."""

import os
import time

import pytest
from pyspark.sql import functions as F

from graphloom.api import Engine
from graphloom.sources import code, ownership, traces
from graphloom.sources.tables import SCHEMAS, Store
from graphloom.streaming import spans

TREE = {
    "app/core.py": "import os\nclass Base:\n    def run(self):\n        return helper()\n\nclass Child(Base):\n    '''A child.'''\n    def go(self):\n        self.run()\n\ndef helper():\n    return os.getcwd()\n",
    "app/core_test.py": "from app.core import helper\ndef TestHelper():\n    helper()\n\ndef helper2():\n    TestHelper()\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n)\n\ntype Server struct {\n}\n\nfunc (s *Server) Start(port int) error {\n}\n\nfunc main() {\n}\n',
    "vendor/x.py": "def no(): pass\n", ".hidden/y.py": "def no(): pass\n", "api.pb.go": "package x\n", "broken.py": "def (:\n", "notes.txt": "text",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(root)


def test_walk_and_extract(spark, tree):
    found = {r["path"] for r in code.walk(spark, tree).collect()}
    assert found == {"app/core.py", "app/core_test.py", "cmd/main.go", "broken.py"}
    parts = code.index(code.walk(spark, tree), "r")
    names = {r["qualified_name"]: r for r in parts["nodes"].collect()}
    assert {"r://app/core.py.Child.go", "r://app/core.py.helper", "r://cmd/main.go.Server.Start", "r://cmd/main.go.main"} <= set(names)
    assert names["r://app/core.py.Child"]["doc"] == "A child." and names["r://app/core.py.Base.run"]["line"] == 3
    known = {r["node_hash"] for r in names.values()}
    edges = {(r["edge_type"], r["source_hash"], r["target_hash"]) for r in parts["edges"].collect()}
    h = lambda n: names["r://app/core.py." + n]["node_hash"]
    assert ("extends", h("Child"), h("Base")) in edges and ("calls", h("Base.run"), h("helper")) in edges and ("calls", h("Child.go"), h("Base.run")) in edges
    assert any(t == "imports" and b not in known for t, _, b in edges)
    again = code.index(code.walk(spark, tree), "r", parts["files"])
    assert again["files"].count() == again["nodes"].count() == again["edges"].count() == 0


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    row = lambda v, c: spark.createDataFrame([("h", "k", v, c)], SCHEMAS["notes"])
    s.put("notes", row("a", 1))
    s.put("notes", row("b", 2))
    assert [tuple(r) for r in s.read("notes").collect()] == [("h", "k", "b", 2)]
    assert [tuple(r) for r in s.read("notes", s.versions("notes")[1]).collect()] == [("h", "k", "a", 1)]
    os.makedirs(tmp_path / "store/notes/v99")  # a writer that died: not committed, so not read
    assert s.read("notes").count() == 1 and s.versions("notes")[-1] == 3
    assert s.vacuum("notes") == 1 and s.versions("notes") == [2, 3]
    s.truncate("notes")
    assert s.read("notes").count() == 0
    assert Store(spark, str(tmp_path / "store")).versions("notes")[-1] == 4


def test_tools(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), lambda: 1_735_689_600)
    first = e.index_repo("r", tree, "c1").first()
    assert first["parent_hash"] is None and first["generation"] == 0 and first["edge_count"] > 0
    assert [r["qualified_name"] for r in e.graph_query("%helper").collect()] == ["r://app/core.py.helper", "r://app/core_test.py.TestHelper", "r://app/core_test.py.helper2"]
    assert [r["path"] for r in e.repo_graph("r").collect()] == ["app/core.py", "app/core_test.py", "broken.py", "cmd/main.go"]
    assert [(r["repo_url"], r["affected"]) for r in e.blast_radius("r://app/core.py.helper").collect()] == [("r", 2)]
    assert {r["depth"] for r in e.trace_dataflow("r://app/core.py.Child.go").collect()} >= {1, 2}
    flow = e.flow_between("r://app/core.py.Child.go", "r://app/core.py.helper").collect()
    assert flow and flow[0]["hops"] == 2
    added = e.snapshot_diff(first["snapshot_hash"])
    assert {r["change"] for r in added.collect()} == {"added"} and added.count() == e.table("edges").count()
    edge = e._inputs().filter("edge_type = 'calls'").first()
    found = e.prove(edge["edge_hash"], edge["package_path"], "calls")
    from graphloom.operators import merkle

    assert merkle.verify_proof(found)
    with open(os.path.join(tree, "app/core.py"), "a") as f:
        f.write("\ndef extra():\n    helper()\n")
    second = e.index_repo("r", tree, "c2").first()
    assert second["parent_hash"] == first["snapshot_hash"] and second["generation"] == 1
    changes = e.snapshot_diff(second["snapshot_hash"]).collect()
    assert [r["change"] for r in changes] == ["added"]
    assert e.pr_impact(second["snapshot_hash"]).first()["symbols"] == 1
    third = e.index_repo("r", tree, "c2").first()
    assert third["snapshot_hash"] == second["snapshot_hash"]
    assert e.report().filter("what = 'files'").first()["n"] == 4
    names = [r["qualified_name"] for r in e.context_for_files(["app/core.py"], "r").collect()]
    assert "r://app/core.py.helper" in names
    assert e.plan_turn("find unused code") == ["stale_edges"] and "blast_radius" in e.tools() and len(e.tools()) >= 28
    with pytest.raises(ValueError):
        e.call("rm")
    e.export(str(tmp_path / "dot"), "dot")
    assert spark.read.text(str(tmp_path / "dot")).count() == e.table("nodes").count() + e.table("edges").count()
    node = e.table("nodes").filter("qualified_name like '%.helper'").first()["node_hash"]
    marks = spark.createDataFrame([(node, "s", True)], "symbol_hash string, session_id string, useful boolean")
    assert [r["score"] for r in e.feedback(marks).collect()] == [1.0]
    e.untrack_repo("r")
    assert e.table("nodes").count() == e.table("edges").count() == e.table("feedback").count() == 0


OTLP = '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"web"}}]},"scopeSpans":[{"spans":[{"traceId":"AB%d","spanId":"01","name":"op","startTimeUnixNano":"1700000000000000000","endTimeUnixNano":"1700000000000000500","attributes":[{"key":"http.method","value":{"stringValue":"GET"}},{"key":"http.route","value":{"stringValue":"/r"}},{"key":"n","value":{"doubleValue":3}}]}]}]}]}'


def test_stream_into_store(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "a.json").write_text("\n".join(OTLP % k for k in range(3)))
    s = Store(spark, str(tmp_path / "store"))
    routes = spark.createDataFrame([("web", "GET /r", "http_route", "n1")], "service_name string, route_pattern string, mapping_type string, node_hash string")
    told = []
    run = lambda: spans.start(traces.read_otlp(spark, str(files), stream=True), routes, s, str(tmp_path / "cp"), once=True, after=told.append).awaitTermination(120)
    run()
    (files / "b.json").write_text("\n".join(OTLP % k for k in range(3, 12)))
    run()
    rows = s.read("edges").collect()
    assert [(r["edge_type"], r["target_hash"], r["observation_count"], r["confidence"]) for r in rows] == [("runtime_calls", "n1", 12, 0.7)]
    assert rows[0]["provenance"].startswith('otel_trace:{"trace_ids":["ab0') and s.read("edge_events").count() == 1 and told == [0, 1]
    first = traces.read_otlp(spark, str(files)).first()
    assert first["attributes"]["n"] == "3" and first["duration_ns"] == 500 and first["start_time"].year == 2023


def test_blame_and_roster(spark, tmp_path):
    a, b = "a" * 40, "b" * 40
    text = [f"{a} 1 1 2", "author Ann", "author-time 5", "\tx", f"{a} 2 2", "\ty", f"{b} 1 3 1", "author Bob", "author-time 7", "\tz"]
    lines = spark.createDataFrame([("f", k, t) for k, t in enumerate(text)], "path string, no int, text string")
    got = sorted(tuple(r) for r in ownership.blame(lines).collect())
    assert got == [("f", 1, "Ann", 5), ("f", 2, "Ann", 5), ("f", 3, "Bob", 7)]
    r = code.Roster(spark, str(tmp_path / "roster"))
    assert r.list().count() == 0
    r.add("x", "/s/x", "/src/x")
    r.add("y", "/s/y", "/src/x/deep")
    assert r.root_of("/src/x/deep/a.go") == "/s/y" and r.root_of("/src/xy") is None
    assert r.remove("x") and not r.remove("x") and [z["name"] for z in r.list().collect()] == ["y"]
    mods = spark.createDataFrame([("u1", "module a.b/c\n\ngo 1"), ("u0", "// x\nmodule a.b/c"), ("u2", "nothing")], "repo_url string, content string")
    assert [tuple(x) for x in code.modules(mods).collect()] == [("a.b/c", "u0")]


def test_watch(spark, tree, tmp_path):
    seen = []
    code.watch(spark, tree, seen.extend, str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert any(p.endswith("main.go") for p in seen)
    time.sleep(1.1)
    with open(os.path.join(tree, "late.py"), "w") as f:
        f.write("x = 1\n")
    seen.clear()
    code.watch(spark, tree, seen.extend, str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert [os.path.basename(p) for p in seen] == ["late.py"]


def test_sessions(spark):
    t = "session_id string, symbol string, at long"
    returned = spark.createDataFrame([("s", "a", 0), ("s", "b", 0), ("s", "c", 0), ("s", "a", 5000)], t)
    used = spark.createDataFrame([("s", "a", 600), ("s", "b", 601), ("z", "c", 1)], t)
    got = {(r["symbol"], r["at"]): r["useful"] for r in spans.implicit_feedback(returned, used).collect()}
    assert got == {("a", 0): 1, ("b", 0): 0, ("c", 0): 0, ("a", 5000): 0}
    rows = spark.createDataFrame([("s", "a", 100, k) for k in range(30)] + [("s", "b", 100 - 180, 31), ("s", "c", -9999, 32)], "session_id string, symbol string, at long, id int")
    got = {r["symbol"]: r["boost"] for r in spans.session_boosts(rows, 100).collect()}
    assert got == {"a": 2.0, "b": 0.5}
    h = spans.Health(2)
    assert h.report(True) == "stopped" and not h.started() and h.report(False) == "connected" and h.report(False) == "failed" and h.report(True) == "connected"


def test_windows_drop_late_rows(spark, tmp_path):
    rows = [("e", k * 60) for k in range(30)]
    at = lambda rows: spark.createDataFrame(rows, "edge_hash string, s long").select("edge_hash", F.timestamp_seconds("s").alias("start_time"))
    at(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spans.windows(spark.readStream.schema("edge_hash string, start_time timestamp").parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    stream().awaitTermination(120)
    at([("e", 30), ("e", 4000)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream().awaitTermination(120)
    got = {r["window"]["start"].minute: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == 5 and all(n == 5 for n in got.values())
