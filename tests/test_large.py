"""What must not grow with the graph: tables that are written for a query, and limits that refused large inputs."""

import datetime
import os
import random
import tempfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import communities, context, iterative, relational
from graphloom.plans import derived
from graphloom.plans.lineage import shared_dir
from graphloom.queries import retrieval


def _written(spark):
    return {d for d in os.listdir(shared_dir(spark).removeprefix("file://")) if d.startswith("graphloom-")}


@pytest.mark.parametrize("name", ["all_edges", "blast_radius", "transitive_callers", "transitive_callees", "test_scope", "pr_impact_risk", "flow_between_paths", "bfs_distance", "repo_node_edge_counts", "dangling_edges_anti", "bfs_distance_whole", "stale_edges_exists", "fsck_counts"])
def test_graph_is_not_written(spark, tables, tmp_path, name):
    """Three hashes an edge took 20 times the tables' room."""
    (tmp_path / "in").symlink_to(tables)  # a path of its own: nothing that another test left is read
    before = _written(spark)
    assert catalog.QUERIES[name](spark, str(tmp_path / "in")).count() > 0
    assert not {d for d in _written(spark) - before if d.startswith(("graphloom-edges", "graphloom-nodes"))}


def test_numbers_are_hashed_as_keys_are(spark):
    keys = [0, 7, -3, 123456789012, None]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for prefix in derived.ENTITIES:
        got = derived.hashed(rows.select(derived.number(prefix, "k").alias("n"), derived.node_id(prefix, "k").alias("h")), "n").collect()
        assert all(r["n"] == r["h"] for r in got) and len({r["h"] for r in got}) == len(keys)


def test_frontiers_in_slices_and_shuffled(spark, monkeypatch):
    """A frontier beyond the rows that are broadcast gives the same nodes, as do fronts from both ends for paths."""
    rows = [(k, (k * 7 + j) % 500) for k in range(500) for j in range(3)] * 2
    edges = spark.createDataFrame(rows, "source_hash long, target_hash long")
    seeds = spark.createDataFrame([(k,) for k in range(5)], "start long")
    found = lambda: sorted(map(tuple, iterative.distances(edges, seeds, 4).collect()))
    ways = [tuple(r) for r in iterative.paths(edges, 0, 3, 4, 30).collect()]
    want, level = dict.fromkeys(range(5), 0), set(range(5))
    for d in range(1, 5):
        level = {y for a, b in rows for x, y in ((a, b), (b, a)) if x in level} - set(want)
        want |= dict.fromkeys(level, d)
    assert found() == sorted(want.items())
    monkeypatch.setattr(iterative, "NEAR", 40)
    assert found() == sorted(want.items())
    monkeypatch.setattr(iterative, "SLICES", 1)
    assert found() == sorted(want.items())
    out, front = [], [(0,)]
    for _ in range(4):
        front = [(*p, b) for p in front for a, b in sorted(set(rows)) if a == p[-1]]
        out += [(len(p) - 1, ">".join(map(str, p))) for p in front if p[-1] == 3]
        front = [p for p in front if p[-1] != 3]
    assert ways == sorted(out)[:30]


def test_similar_copies_are_a_class(spark):
    """300 copies of 2 texts are 2 classes: one pair of classes is compared, and not all 89700 pairs of rows."""
    rows = [("g", k, ["a", "b", "c"] if k % 2 else ["d", "c", "b", "a"]) for k in range(300)] + [("h", 300, ["a", "b", "c"])]
    docs = spark.createDataFrame(rows, "g string, k long, t array<string>")
    got = relational.similar_pairs(docs, "g", "k", "t", 0.5)
    assert sorted(map(tuple, got.collect())) == [(x, y, 1.0 if x % 2 == y % 2 else 0.75) for x in range(300) for y in range(x + 1, 300)]
    sizes = [spark.read.parquet(f"{shared_dir(spark)}/{d}").count() for d in sorted(_written(spark), key=lambda d: os.path.getmtime(f"{shared_dir(spark).removeprefix('file://')}/{d}")) if d.startswith("graphloom-linked")]
    assert sizes[-1:] == [1]


def test_walk_reads_the_edges_of_its_nodes(spark):
    """Steps of nodes that the walk never gives on from are not written; links by id give what links by hash do."""
    rows = [(k, k + 1, 1.0) for k in range(3)] + [(k, k + 1, 1.0) for k in range(100, 400)]
    before = _written(spark)
    edges = spark.createDataFrame(rows, "source_hash long, target_hash long, w double")
    got = context.walk(edges, spark.createDataFrame([(0, 1.0)], "node long, s double"), rounds=3, settled=0.0)
    assert {r["node"] for r in got.collect()} == {0, 1, 2, 3}
    assert sum(spark.read.parquet(f"{shared_dir(spark)}/{d}").count() for d in _written(spark) - before if d.startswith("graphloom-step")) <= 6


def _louvain_by_dicts(rows, resolution=1.0, passes=20, former=None, changed=None):
    near = {}
    for u, v, w in rows:
        for a, b in ((u, v), (v, u)):
            near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + w
    order = sorted(near)
    degree = {a: sum(near[a].values()) for a in order}
    double, mass = sum(degree.values()), {}
    home = {a: (("old", former[a]) if a in former else ("new", a)) if former else a for a in order}
    for a in order:
        mass[home[a]] = mass.get(home[a], 0.0) + degree[a]
    for _ in range(passes):
        moved = False
        for a in order if not former else [a for a in order if a in changed]:
            links = {}
            for b, w in sorted(near[a].items()):
                if b != a:
                    links[home[b]] = links.get(home[b], 0.0) + w
            mass[home[a]] -= degree[a]
            gain = {c: links.get(c, 0.0) - resolution * degree[a] * mass[c] / double for c in {*links, home[a]}}
            best = min(gain, key=lambda c: (-gain[c], str(c) if former else c))
            if gain[best] > gain[home[a]] + 1e-12:
                home[a], moved = best, True
            mass[home[a]] += degree[a]
        if not moved:
            break
    number = {}
    return {a: number.setdefault(home[a], len(number)) for a in order}


@pytest.mark.parametrize("batch", [10_000, 7])
def test_louvain_is_that_of_plain_python(spark, batch):
    """Whole and from a former result, with self-links, repeats and nodes whose edges are cut by batches."""
    rng = random.Random(batch)
    rows = [(rng.randrange(80) * 3 - 50, rng.randrange(80) * 3 - 50, float(rng.randrange(1, 4))) for _ in range(500)] + [(900, 901, 1.0), (902, 902, 2.0)]
    df = spark.createDataFrame(rows, "u long, v long, w double")
    former, changed = {n: n * n % 12 - 3 for n in range(-50, 120, 6)} | {5000: 1}, {*range(-50, 190, 4), 900, 7777}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for resolution in (1.0, 0.3):
            assert {r["node"]: r["community"] for r in iterative.louvain(df, resolution).collect()} == _louvain_by_dicts(rows, resolution)
        assert {r["node"]: r["community"] for r in iterative.louvain(df, former=former, changed=changed).collect()} == _louvain_by_dicts(rows, former=former, changed=changed)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_louvain_takes_over_two_million_edges(spark):
    """Such graphs were refused. Two groups of 1500 nodes, all linked, and a link between them."""
    k = F.col("id")
    edges = spark.range(2 * 1500 * 1500).select((F.floor(k / 1500)).alias("u"), (k % 1500 + F.when(k >= 1500 * 1500, 1500).otherwise(0)).alias("v"), F.lit(1.0).alias("w"))
    got = {r["node"]: r["community"] for r in iterative.louvain(edges.unionByName(spark.createDataFrame([(0, 1500, 1.0)], "u long, v long, w double"))).collect()}
    assert got == {n: n // 1500 for n in range(3000)}


def test_incremental_louvain_takes_a_table(spark, tmp_path):
    """The former result stays a table: it was collected as a dictionary."""
    users = [k * k % 97 for k in range(400)]
    spark.createDataFrame([(k, datetime.datetime(2024, 1, 1), u) for k, u in enumerate(users)], "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    rows = [(u, v, 1.0) for u, v in zip(users, users[1:])]
    former = _louvain_by_dicts(rows)
    before = _written(spark)
    got = {r["node"]: r["community"] for r in catalog.QUERIES["louvain_incremental"](spark, str(tmp_path)).collect()}
    assert got == _louvain_by_dicts(rows, former=former, changed={n for n in former if n < 10})
    assert any(d.startswith("graphloom-former") for d in _written(spark) - before)


@pytest.fixture
def some_parts(spark, tables, tmp_path):
    """Tables in which some links leave unknown symbols, and some stand twice."""
    for name in os.listdir(tables):
        if name not in ("part.parquet", "lineitem.parquet"):
            (tmp_path / name).symlink_to(f"{tables}/{name}")
    part, line = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("part", "lineitem"))
    part.filter("p_partkey % 5 <> 1").write.parquet(f"{tmp_path}/part.parquet")
    line.unionByName(line.filter("l_linenumber < 3").withColumn("l_shipdate", F.expr("l_shipdate - interval 9 days"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["weighted_walk", "context_for_task"])
def test_links_are_read_where_they_lie(spark, some_parts, monkeypatch, name):
    """Links by id are not written, and give what links by hash do."""
    before = _written(spark)
    got = sorted(map(tuple, catalog.QUERIES[name](spark, some_parts).collect()))
    kinds = {d.removeprefix("graphloom-").rsplit("-", 1)[0] for d in _written(spark) - before}
    assert not kinds & {"store-ends", "store-links", "store-feedback", "edges", "steps", "near"}
    monkeypatch.setattr(retrieval, "numbered_links", lambda *_: None)
    assert got and got == sorted(map(tuple, catalog.QUERIES[name](spark, some_parts).collect()))


def test_fine_louvain_takes_over_two_million_edges(spark):
    """Four groups of 800 nodes, all linked, and links from each to the next."""
    k = F.col("id")
    edges = spark.range(4 * 800 * 800).select((F.floor(k / 800)).alias("u"), (F.floor(k / 640_000) * 800 + k % 800).alias("v"), F.lit(1.0).alias("w"))
    rows = edges.unionByName(spark.createDataFrame([(g * 800, g * 800 + 800, 1.0) for g in range(3)], "u long, v long, w double"))
    assert {r["node"]: r["community"] for r in communities.detect(rows, "louvain-fine").collect()} == {n: n // 800 for n in range(3200)}


def test_louvain_takes_nodes_in_any_order(monkeypatch):
    """Parts are sorted one after the other, so nodes come in no order; the task's files hold two numbers a row, not three."""
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(1, 4))) for _ in range(300)]
    near = {}
    for a, b, w in [*rows, *((v, u, w) for u, v, w in rows)]:
        near.setdefault(a, Counter())[b] += w
    order = sorted(near, key=lambda a: (a * 7 % 5, a))
    flat = [(a, b, near[a][b]) for a in order for b in sorted(near[a])]
    files, new = [], tempfile.TemporaryFile

    def kept():
        files.append(os.dup((f := new()).fileno()))
        return f

    monkeypatch.setattr(tempfile, "TemporaryFile", kept)
    for size in (1000, 7):
        batches = [pa.RecordBatch.from_pydict(dict(zip("uvw", map(list, zip(*flat[k : k + size]))))) for k in range(0, len(flat), size)]
        got = [x for b in iterative._local_moving(iter(batches), 0.3, 20, False) for x in zip(*b.to_pydict().values())]
        assert got == sorted(_louvain_by_dicts(rows, 0.3).items())
        assert sum(os.fstat(f).st_size for f in files) == 16 * len(flat)
        while files:
            os.close(files.pop())


def test_louvain_sorts_in_parts(spark):
    """The one task took all rows through one exchange and sorted them at once, which spilled."""
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 3, 1.0)], "u long, v long, w double")
    plan = communities.detect(edges, "louvain-fine")._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 1" in plan and "SinglePartition" not in plan and "Union" not in plan


def test_user_pairs_are_written_without_their_times(spark, tmp_path):
    """Events were written with time and number and shuffled again; users may be null, and ranges and batches end anywhere."""
    users = [None if k % 11 == 5 else k * k % 23 for k in range(400)]
    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k // 3), u) for k, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").repartition(5, F.rand(1)).write.parquet(f"{tmp_path}/events.parquet")
    before = _written(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = derived.next_user_edges(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = Counter((u, v) for u, v in zip(users, users[1:]) if u is not None and v is not None)
    assert {(r["u"], r["v"]): r["w"] for r in got} == want
    (made,) = (d for d in _written(spark) - before if d.startswith("graphloom-events"))
    table = spark.read.parquet(f"{shared_dir(spark)}/{made}")
    assert table.columns == ["part", "u", "v"] and table.count() == 400 and table.filter("part is not null").count() > 1
