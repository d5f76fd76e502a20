"""Small graphs and trees: folds, proofs, closures, streams against batches."""

import itertools

import pytest
from pyspark.sql import functions as F

from graphloom.operators import iterative, merkle
from graphloom.streaming import spans


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_proofs_hold_and_tampering_shows(n):
    leaves = [bytes([k]) * 32 for k in range(n)]
    for single in (False, True):
        root = merkle.fold(leaves[::-1], single)
        assert root == merkle.fold(leaves, single)
        for leaf in leaves:
            steps = merkle.proof(leaves, leaf, single)
            assert merkle.verify(leaf, steps, root)
            assert not merkle.verify(b"x" * 32, steps, root)
    with pytest.raises(ValueError):
        merkle.proof(leaves, b"x" * 32)


def test_closure_keeps_depths_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "source_hash string, target_hash string")
    got = {tuple(r)[1:] for r in iterative.closure(edges, spark.createDataFrame([("a",)], "start string"), 3).collect()}
    assert got == {("b", 1), ("c", 1), ("c", 2), ("a", 2), ("a", 3), ("b", 3), ("c", 3)}
    near = {r["node"]: r["depth"] for r in iterative.reach(edges, spark.createDataFrame([("a",)], "start string"), 3).collect()}
    assert near == {"a": 0, "b": 1, "c": 1}
    paths = [r["path"] for r in iterative.paths(edges, "a", "c").collect()]
    assert paths == ["a>c", "a>b>c"]


def test_louvain_finds_cliques(spark):
    rows = [(a, b, 1.0) for g in (0, 10) for a, b in itertools.combinations(range(g, g + 5), 2)] + [(0, 10, 1.0)]
    got = {r["node"]: r["community"] for r in iterative.louvain(spark.createDataFrame(rows, "u long, v long, w double")).collect()}
    assert len({got[k] for k in range(5)}) == 1 and len(set(got.values())) == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [("t", str(k), f"s{k % 3}", "op", "", {"http.method": "GET", "http.route": f"/r{k % 4}"}, k) for k in range(60)] + [("t", "60", "s1", "once", "s2", {}, 60)]
    batch = spark.createDataFrame(rows, "trace_id string, span_id string, service_name string, operation_name string, peer_service string, attributes map<string,string>, k long")
    batch = batch.withColumn("start_time", F.timestamp_seconds(F.col("k") * 60)).withColumn("duration_ns", F.col("k")).drop("k")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    routes = spark.createDataFrame([("s0", "GET /r0", "http_route", "known")], "service_name string, route_pattern string, mapping_type string, node_hash string")
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = spans.observe(spans.resolve(stream, routes)).writeStream.outputMode("complete").format("memory").queryName("observed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, spans.observe(spans.resolve(batch, routes)).collect()))
    assert sorted(map(tuple, spark.sql("select * from observed").collect())) == want
    # an edge seen five times is as sure as its count says, one seen once as its resolver
    assert {(r[6], r[4]) for r in want} == {(5, 0.5), (1, 0.3)} and "known" in {r[2] for r in want}
