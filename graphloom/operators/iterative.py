"""Bounded closures, paths, distances and fixed-point rankings as loops of joins, cut at every round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.lineage import cut


#: Rows of a frontier that are broadcast at once: of numbers, and an eighth of it of hashes.
NEAR = 1 << 20
#: A frontier of so many times NEAR is taken in slices, one after the other; a larger one is shuffled.
SLICES = 8


def _onward(front: DataFrame, edges: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """Distinct (keep, node) that a written frontier (keep, node) leads to. Edges are read where they lie: none is written or
    shuffled unless most of the graph is at hand."""
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next"))
    go = lambda part: part.select(*keep, "node").join(step, "node").select(*keep, F.col("next").alias("node")).distinct()
    most = NEAR if all(front.schema[c].dataType.simpleString() == "bigint" for c in (*keep, "node")) else NEAR // 8
    slices = -(-front.count() // most)
    if slices > SLICES:
        return go(front)
    if slices < 2:
        return go(F.broadcast(front))
    found = [cut(go(F.broadcast(front.filter(F.pmod(F.xxhash64(*keep, "node"), F.lit(slices)) == k))), "slice") for k in range(slices)]
    return reduce(DataFrame.unionByName, found).distinct()


def reached(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """Each node that some start reaches in 1 to `depth` steps, once; a start only if a cycle leads back to one."""
    a, b = ("target_hash", "source_hash") if reverse else ("source_hash", "target_hash")
    front, out = cut(seeds.select(F.col("start").alias("node")).distinct(), "reached"), None
    for _ in range(depth):
        found = _onward(front, edges, a, b)
        front = cut(found if out is None else found.join(out, "node", "left_anti"), "reached")
        out = front if out is None else out.unionByName(front)
    return out


def closure(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(start, node, depth), each once: a node reached at two depths stands twice, the start again through a cycle.

    edges: source_hash, target_hash; seeds: start. A round joins the frontier only, so paths never multiply.
    """
    a, b = ("target_hash", "source_hash") if reverse else ("source_hash", "target_hash")
    front = cut(seeds.select("start", F.col("start").alias("node")), "closure")
    out = None
    for d in range(1, depth + 1):
        front = cut(_onward(front, edges, a, b, "start"), "closure")
        level = front.withColumn("depth", F.lit(d))
        out = level if out is None else out.unionByName(level)
    return out


def blast_radius(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Affected nodes of each start by repository, with the least depth."""
    found = closed.join(nodes.select(F.col("node_hash").alias("node"), "repo_url"), "node", "left")
    return found.groupBy("start", F.coalesce("repo_url", F.lit("unknown")).alias("repo_url")).agg(F.countDistinct("node").alias("affected"), F.min("depth").alias("nearest"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int, stop: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """(start, node, depth) with each node once, at its least depth, 0 for the start; nodes in `stop` are not passed."""
    a, b = ("target_hash", "source_hash") if reverse else ("source_hash", "target_hash")
    seen = cut(seeds.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")), "reach")
    front = seen
    for d in range(1, depth + 1):
        go = front if stop is None else front.join(stop, "node", "left_anti")
        found = _onward(go, edges, a, b, "start")
        front = cut(found.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d)), "reach")
        seen = seen.unionByName(front)
    return seen


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("source_hash", "target_hash").unionByName(edges.select(F.col("target_hash").alias("source_hash"), F.col("source_hash").alias("target_hash")))


def distances(edges: DataFrame, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """Least hops from any of the seeds, either way along edges."""
    both = undirected(edges)
    seen = cut(seeds.select(F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "bfs")
    front = seen
    for d in range(1, depth + 1):
        found = _onward(front, both, "source_hash", "target_hash")
        front = cut(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "bfs")
        seen = seen.unionByName(front)
    return seen


def between(edges: DataFrame, source, target, depth: int) -> DataFrame:
    """Distinct edges, among them all those of walks of at most `depth` edges from source to target: the fronts from both
    ends grow by one step at a time, the smaller one first, until they have made `depth` steps together. The k-th edge of a
    walk leaves a node that the first front met, or else enters one that the other did."""
    spark, kind = edges.sparkSession, edges.schema["source_hash"].dataType.simpleString()
    ends = edges.select("source_hash", "target_hash")
    seen = [cut(spark.createDataFrame([(x,)], f"node {kind}"), "front") for x in (source, target)]
    front, size, found = list(seen), [1, 1], []
    for _ in range(depth):
        k = 0 if size[0] <= size[1] else 1
        a, b = ("source_hash", "target_hash") if k == 0 else ("target_hash", "source_hash")
        near = F.broadcast(front[k]) if size[k] <= (NEAR if kind == "bigint" else NEAR // 8) else front[k]
        found.append(cut(ends.join(near.withColumnRenamed("node", a), a, "left_semi").select("source_hash", "target_hash").distinct(), "between"))
        front[k] = cut(found[-1].select(F.col(b).alias("node")).distinct().join(seen[k], "node", "left_anti"), "front")
        seen[k], size[k] = seen[k].unionByName(front[k]), front[k].count()
    return cut(reduce(DataFrame.unionByName, found).distinct(), "between")


def walks(edges: DataFrame, source, target, depth: int = 5) -> DataFrame:
    """(hops, path): walks from source to target of at most `depth` edges that stop at the target, as arrays of nodes.

    A walk is only lengthened into nodes from which the target can be reached in what is left.
    """
    spark, kind = edges.sparkSession, edges.schema["source_hash"].dataType.simpleString()
    step = between(edges, source, target, depth)
    near = reach(step, spark.createDataFrame([(target,)], f"start {kind}"), depth, reverse=True).select("node", F.col("depth").alias("left"))
    near = cut(near, "near")
    step = step.select(F.col("source_hash").alias("node"), F.col("target_hash").alias("next"))
    front = spark.createDataFrame([(source, [source])], f"node {kind}, path array<{kind}>")
    out = None
    for d in range(1, depth + 1):
        front = cut(front.join(step, "node").select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")).join(near.filter(F.col("left") <= depth - d), "node").drop("left"), "paths")
        done = front.filter(F.col("node") == F.lit(target)).select(F.lit(d).alias("hops"), "path")
        out = done if out is None else out.unionByName(done)
        front = front.filter(F.col("node") != F.lit(target))
    return out


def first_paths(found: DataFrame, most: int = 10) -> DataFrame:
    """The shortest of paths (hops, path as an array of hashes), ties by path, joined by `>`."""
    return found.select("hops", F.array_join("path", ">").alias("path")).orderBy("hops", "path").limit(most)


def paths(edges: DataFrame, source, target, depth: int = 5, most: int = 10) -> DataFrame:
    """Walks from source to target of at most `depth` edges that stop at the target: shortest first, then by path."""
    return first_paths(walks(edges, source, target, depth), most)


def random_walk(edges: DataFrame, seeds: DataFrame, rounds: int = 5, alpha: float = 0.2, settled: float | None = None) -> DataFrame:
    """Random walk with restart over undirected weighted edges (u, v, w); seeds: node, s summing to 1.

    A node without weight gives its mass to the seeds; scores are divided by the largest. With `settled` the walk ends
    before `rounds` once a round moves less mass than that, or once the ten best have twice come out in the same order.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))
    total = both.groupBy("u").agg(F.sum("w").alias("total")).filter("total > 0")
    share = cut(both.join(total, "u").select(F.col("u").alias("node"), F.col("v").alias("next"), (F.col("w") / F.col("total")).alias("share")), "share")
    p = seeds.select("node", F.col("s").alias("p"))
    best, same = None, 0
    for _ in range(rounds):
        moved = p.join(share, "node").groupBy(F.col("next").alias("node")).agg((F.sum(F.col("p") * F.col("share")) * (1 - alpha)).alias("p"))
        lost = p.join(share.select("node").distinct(), "node", "left_anti").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("lost"))
        back = seeds.join(F.broadcast(lost)).select("node", (F.col("s") * (alpha + (1 - alpha) * F.col("lost"))).alias("p"))
        former, p = p, cut(moved.unionByName(back).groupBy("node").agg(F.sum("p").alias("p")), "walk")
        if settled is None:
            continue
        gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
        if p.join(former.select("node", F.col("p").alias("q")), "node", "full").agg(F.sum(gap)).first()[0] < settled:
            break
        top = [r["node"] for r in p.orderBy(F.desc(F.round("p", 12)), "node").limit(10).collect()]
        same = same + 1 if top == best else 0
        if same >= 2:
            break
        best = top
    return p.join(F.broadcast(p.agg(F.max("p").alias("top")))).select("node", F.round(F.col("p") / F.col("top"), 6).alias("score"))


def hits(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Hub and authority scores, authorities first in each round, of length 1 over all nodes."""
    links = edges.select("u", "v")
    nodes = cut(links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct(), "nodes")

    def normed(df: DataFrame) -> DataFrame:
        norm = df.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        return df.join(F.broadcast(norm)).select("node", F.coalesce(F.try_divide(F.col("x"), F.col("norm")), F.lit(0.0)).alias("x"))

    hub, auth = nodes.withColumn("x", F.lit(1.0)), None
    for _ in range(rounds):
        auth = cut(normed(links.join(hub.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.sum("x").alias("x"))), "auth")
        hub = cut(normed(links.join(auth.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("x").alias("x"))), "hub")
    zero = F.lit(0.0)
    return nodes.join(auth.withColumnRenamed("x", "authority"), "node", "left").join(hub.withColumnRenamed("x", "hub"), "node", "left").select("node", F.round(F.coalesce("authority", zero), 6).alias("authority"), F.round(F.coalesce("hub", zero), 6).alias("hub"))


def label_propagation(edges: DataFrame, rounds: int = 3, stable: bool = False) -> DataFrame:
    """Synchronous: each node takes the label of most weight among its neighbours, ties to the least.

    With `stable` it ends before `rounds` once no label changes.
    """
    both = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w")), "both")
    labels = both.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u", "label").agg(F.sum("w").alias("w"))
        former, labels = labels, cut(votes.groupBy(F.col("u").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label")), "labels")
        if stable and labels.exceptAll(former).isEmpty():
            break
    return labels


def louvain(edges: DataFrame, resolution: float = 1.0, passes: int = 20, former: DataFrame | dict | None = None, changed: DataFrame | set | None = None) -> DataFrame:
    """Local moving of single nodes in order of id until no move gains: sequential by nature, so one task at any size. It
    reads each node's edges in order from a file of its own, in every pass, and holds only some numbers a node. From a
    former result (node, community) only the changed nodes (node) move; new nodes begin alone."""
    spark = edges.sparkSession
    ends = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    pairs = edges.filter("u is not null and v is not null").groupBy(*ends).agg(F.sum("w").cast("double").alias("w"))
    ways = "CASE WHEN u = v THEN array(struct(u, v, w * 2 AS w)) ELSE array(struct(u, v, w), struct(v AS u, u AS v, w)) END"
    rows = pairs.select(F.inline(F.expr(ways)))
    none = F.lit(None)
    if isinstance(former, dict):
        former = spark.createDataFrame(list(former.items()), "node long, community long") if former else None
    if isinstance(changed, set):
        changed = spark.createDataFrame([(n,) for n in changed], "node long")
    if former is not None and former.isEmpty():
        former = None
    if former is not None:
        # a row without v stands ahead of a node's edges and tells of its former community and whether it moves
        known = former.select(F.col("node").alias("u"), F.col("community").cast("long").alias("was"), F.lit(False).alias("moves"))
        asked = known.limit(0) if changed is None else changed.select(F.col("node").alias("u"), none.cast("long").alias("was"), F.lit(True).alias("moves"))
        told = known.unionByName(asked).groupBy("u").agg(F.max("was").alias("was"), F.max("moves").alias("moves"))
        told = told.select("u", none.cast("long").alias("v"), none.cast("double").alias("w"), "was", "moves")
        rows = rows.select("u", "v", "w", none.cast("long").alias("was"), none.cast("boolean").alias("moves")).unionByName(told)
    seeded = former is not None
    # a node's rows lie in one of many parts; the task sorts these one after the other, which takes little memory and no spill
    one = rows.repartition("u").sortWithinPartitions(F.asc("u"), F.asc_nulls_first("v")).coalesce(1)
    return one.mapInArrow(lambda batches: _local_moving(batches, resolution, passes, seeded), "node long, community long")


#: Edges that a louvain task reads at once.
BLOCK = 1 << 20


def _local_moving(batches, resolution: float, passes: int, seeded: bool):
    """Louvain's one task: rows (u, v, w), with seeds also (was, moves); those of a u stand together, in order of v."""
    import tempfile

    import numpy as np
    import pyarrow as pa

    with tempfile.TemporaryFile() as ends, tempfile.TemporaryFile() as weights:
        nodes, sizes, degrees, told = [], [], [], []
        for batch in batches:
            u, v = batch.column(0), batch.column(1)
            link = v.is_valid().to_numpy(zero_copy_only=False)
            ids = u.to_numpy(zero_copy_only=False).astype(np.int64)
            w = batch.column(2).to_numpy(zero_copy_only=False)[link].astype(np.float64)
            v.filter(pa.array(link)).to_numpy(zero_copy_only=False).astype(np.int64).tofile(ends)
            w.tofile(weights)
            if seeded and not link.all():
                was, moves = (batch.column(k).filter(pa.array(~link)) for k in (3, 4))
                told.append((ids[~link], was.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), was.is_valid().to_numpy(zero_copy_only=False), moves.to_numpy(zero_copy_only=False).astype(bool)))
            ids = ids[link]
            first = np.flatnonzero(np.concatenate([np.ones(min(len(ids), 1), bool), ids[1:] != ids[:-1]]))
            own, count = ids[first], np.diff(first, append=len(ids))
            if len(own):
                total = np.add.reduceat(w, first)
                if nodes and nodes[-1][-1] == own[0]:  # a node's edges go on from the batch before
                    sizes[-1][-1] += count[0]
                    degrees[-1][-1] += total[0]
                    own, count, total = own[1:], count[1:], total[1:]
                if len(own):
                    nodes.append(own), sizes.append(count), degrees.append(total)
        if not nodes:
            return
        node, size, degree = map(np.concatenate, (nodes, sizes, degrees))
        del nodes, sizes, degrees
        start, order = np.cumsum(size) - size, np.argsort(node)
        node, size, degree, start = node[order], size[order], degree[order], start[order]
        n, double = len(node), float(degree.sum())
        home, moving, old = np.arange(n), np.ones(n, bool), np.empty(0, np.int64)
        if seeded:
            ids, was, has, moves = (np.concatenate(x) for x in zip(*told)) if told else (np.empty(0, np.int64),) * 4
            at = np.minimum(np.searchsorted(node, ids), n - 1)
            here = node[at] == ids  # what is told of nodes without edges is passed over
            at, was, has, moves = at[here], was[here], has[here].astype(bool), moves[here].astype(bool)
            old = np.unique(was[has])
            home += len(old)
            home[at[has]] = np.searchsorted(old, was[has])
            moving[:] = False
            moving[at] = moves
        mass = np.bincount(home, degree, len(old) + n)
        links = np.zeros(len(old) + n)
        # ends become places of nodes, in the same file
        ends.flush(), weights.flush()
        to, weight = np.asarray(np.memmap(ends, np.int64, "r+")), np.asarray(np.memmap(weights, np.float64, "r"))
        for k in range(0, len(to), BLOCK):
            to[k : k + BLOCK] = np.searchsorted(node, to[k : k + BLOCK])

        def name(c: int) -> str:
            return f"('old', {old[c]})" if c < len(old) else f"('new', {node[c - len(old)]})"

        turn = np.flatnonzero(moving).tolist() if double > 0 else []
        begin, end, degree_of = start.tolist(), (start + size).tolist(), degree.tolist()
        for _ in range(passes):
            moved = False
            for a in turn:
                lo, hi = begin[a], end[a]
                near, w = to[lo:hi], weight[lo:hi]
                if (near == a).any():
                    near, w = near[near != a], w[near != a]
                mine, mass_a = home[a], degree_of[a]
                mass[mine] -= mass_a
                homes = home[near]
                np.add.at(links, homes, w)
                per = resolution * mass_a
                gains = links[homes] - per * mass[homes] / double
                stay = links[mine] - per * mass[mine] / double
                links[homes] = 0.0
                top = gains.max() if len(gains) else stay
                if top > stay + 1e-12:
                    best = np.unique(homes[gains == top]).tolist()
                    mine = min(best, key=name) if seeded else best[0]
                    home[a], moved = mine, True
                mass[mine] += mass_a
            if not moved:
                break
        # communities are numbered as they come up in order of id
        _, first, back = np.unique(home, return_index=True, return_inverse=True)
        number = np.empty(len(first), np.int64)
        number[np.argsort(first)] = np.arange(len(first))
        community = number[back]
        for k in range(0, n, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(node[k : k + BLOCK]), pa.array(community[k : k + BLOCK])], ["node", "community"])


def chain(snapshots: DataFrame, head: str) -> DataFrame:
    """Snapshots from `head` along parents, newest first, to the end. The walk is doubled: after k rounds each row knows its
    ancestor 2^k up. A hash is of what came before it, so a chain has no cycle."""
    jump = snapshots.select("snapshot_hash", F.col("parent_hash").alias("up"))
    found = snapshots.sparkSession.createDataFrame([(head, 0)], "snapshot_hash string, at int")
    step, size = jump, 1
    while True:
        more = found.join(step, "snapshot_hash").filter("up is not null").select(F.col("up").alias("snapshot_hash"), (F.col("at") + size).alias("at"))
        more = cut(more, "chain")
        if not more.limit(1).count():
            break
        found = cut(found.unionByName(more), "chain")
        step = cut(step.alias("a").join(step.alias("b"), F.col("a.up") == F.col("b.snapshot_hash")).select("a.snapshot_hash", "b.up"), "chain")
        size *= 2
    return found.join(snapshots.select("snapshot_hash"), "snapshot_hash", "left_semi")
