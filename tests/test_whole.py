"""Queries on whole inputs: no ids folded or left out, the reference's rounds and stopping rules."""

import datetime
import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import iterative, retrieval
from graphloom.operators import iterative
from graphloom.plans import derived


def test_interface_hints_keep_all_ids(spark, tmp_path):
    rows = [(1, 7, 3), (640, 7, 25), (640, 107, 4), (2, 107, 99), (2, 107, 99)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted({(a, c) for a, b, _ in rows for _, t, c in rows if b == t})
    assert sorted(map(tuple, catalog.QUERIES["interface_hints_whole"](spark, str(tmp_path)).collect())) == want


def _events(spark, path, users):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=k // 3), u, "click" if k % 2 else "view") for k, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").repartition(5, F.rand(1)).write.parquet(f"{path}/events.parquet")
    return rows


def test_user_graph_keeps_all_users(spark, tmp_path):
    users = [k * k % 1201 for k in range(3000)] + [3, 503, 1003]
    _events(spark, tmp_path, users)
    want = sorted((u, v, float(n)) for (u, v), n in Counter(zip(users, users[1:])).items())
    assert sorted(map(tuple, derived.next_user_edges(spark, str(tmp_path)).collect())) == want
    got = {r["node"]: r["community"] for r in catalog.QUERIES["louvain"](spark, str(tmp_path)).collect()}
    assert set(got) == set(users) and {503, 1003} <= set(got)
    assert set(got) == {r["node"] for r in catalog.QUERIES["hits_whole"](spark, str(tmp_path)).collect()}


def test_runtime_edges_keep_all_users(spark, tmp_path):
    rows = _events(spark, tmp_path, [k % 450 for k in range(2000)])
    want = Counter((f"svc{u % 20}", f"/u/{u}/{kind}") for _, _, u, kind in rows)
    assert {tuple(r)[:2]: r[2] for r in derived.runtime_edges(spark, str(tmp_path)).collect()} == want
    assert catalog.QUERIES["span_ingest_runtime_edges"](spark, str(tmp_path)).count() == len(want)


def _chain(n):
    """A long path with light shortcuts: far from settled after three or five rounds."""
    rng = random.Random(4)
    return [(k, k + 1, 3.0 + k % 4) for k in range(n)] + [(rng.randrange(n), rng.randrange(n), 1.0) for _ in range(n // 4)]


def _both(rows):
    near = defaultdict(Counter)
    for u, v, w in rows:
        near[u][v] += w
        near[v][u] += w
    return near


def _walk(near, seeds, rounds=20):
    p, best, same = dict(seeds), None, 0
    for k in range(1, rounds + 1):
        q = {s: 0.2 * w for s, w in seeds.items()}
        for u, x in p.items():
            total = sum(near[u].values())
            for v, w in near[u].items():
                q[v] = q.get(v, 0.0) + 0.8 * x * w / total
        delta = sum(abs(q.get(u, 0.0) - p.get(u, 0.0)) for u in {*p, *q})
        p = q
        if delta < 1e-3:
            break
        top = sorted(p, key=lambda u: (-round(p[u], 12), u))[:10]
        same = same + 1 if top == best else 0
        if same >= 2:
            break
        best = top
    return k, {u: x / max(p.values()) for u, x in p.items()}


@pytest.mark.parametrize("n", [3, 14, 40])
def test_walk_ends_when_settled(spark, monkeypatch, n):
    rows, rounds = _chain(n), []
    cut = iterative.cut
    monkeypatch.setattr(iterative, "cut", lambda df, name="t": (rounds.append(name), cut(df, name))[1])
    seeds = spark.createDataFrame([(0, 0.5), (1, 0.5)], "node long, s double")
    got = {r["node"]: r["score"] for r in iterative.random_walk(spark.createDataFrame(rows, "u long, v long, w double"), seeds, 20, settled=1e-3).collect()}
    k, want = _walk(_both(rows), {0: 0.5, 1: 0.5})
    assert rounds.count("walk") == k and got == pytest.approx(want, abs=2e-6)


def test_labels_until_stable(spark):
    rows = _chain(40)
    near, label, rounds = _both(rows), {}, 0
    label = {u: u for u in near}
    while rounds < 50:
        votes = {u: Counter() for u in near}
        for u in near:
            for v, w in near[u].items():
                votes[u][label[v]] += w
        new = {u: min(c, key=lambda x: (-c[x], x)) for u, c in votes.items()}
        rounds += 1
        if new == label:
            break
        label = new
    edges = spark.createDataFrame(rows, "u long, v long, w double")
    assert rounds > 4
    assert {r["node"]: r["label"] for r in iterative.label_propagation(edges, 50, stable=True).collect()} == label


def test_registered_rounds(spark, tables, monkeypatch):
    calls = []
    for name in ("distances", "random_walk", "hits", "label_propagation"):
        monkeypatch.setattr(iterative, name, lambda *a, _n=name, **b: calls.append((_n, *a[1 + (_n in ("distances", "random_walk")) :], b)))
    for name in ("bfs_distance_whole", "rwr_whole", "hits_whole", "lpa_whole"):
        catalog.QUERIES[name](spark, tables)
    assert calls == [("distances", 4, {}), ("random_walk", 20, {"settled": 1e-3}), ("hits", 10, {}), ("label_propagation", 50, {"stable": True})]


def test_pack_takes_dense_symbols_of_low_score(spark):
    rng = random.Random(6)
    rows = [(f"long{k}", 1.0 + k % 7, 9 + k % 3) for k in range(20_500)] + [(f"s{k}", 0.9, 1 + k % 2) for k in range(30)] + [("huge", 99.0, 500)]
    rng.shuffle(rows)
    for budget in (5, 40, 200):
        left, want = budget, []
        for symbol, score, cost in sorted(rows, key=lambda r: (-r[1] / r[2], r[0])):
            if cost <= left:
                want.append((symbol, score, cost))
                left -= cost
        want.sort(key=lambda r: (-r[1], r[0]))
        assert list(map(tuple, retrieval.pack(spark.createDataFrame(rows, "symbol string, score double, cost long"), budget).collect())) == want
